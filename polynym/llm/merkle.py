"""A Merkle manifest of a dataset: leaves, subroots per language, one root, and a proof for every document.

Leaves are numbered within their group without gathering it: they are sorted by
range, and each partition starts where the ones before it end. Runs of
``WIDTH`` nodes become one node; ``LEVELS`` levels of runs make an aligned block
of ``WIDTH ** LEVELS`` leaves, which one task handles. The roots of all blocks
are the leaves of the next, far smaller table, until each group has one node;
these subroots are the leaves of the last tree, whose node is the root.

Proofs are then made from the top down. A block gets the proof of its own root
(appended to every proof inside it) and goes through its leaves by a fractal
traversal: for each level it keeps the run that the current leaf lies in (the
existing subtree) and builds the next one (the desired subtree) by one leaf for
each proof that it emits, so beside the digests of the block it holds a run or
two for each level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polynym.operators.materialize import materialize

#: Nodes in a run, and levels of runs in a block.
WIDTH, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A proof: for each level the place within the run, and the digests of the others. Digests are 32 bytes here.
Step = tuple[int, list[bytes]]


def combine(digests: list[bytes]) -> bytes:
    """The digest of a run: SHA-256 of the digests as hex text, one after the other."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(values[c]) for c in FIELDS)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """``(group, doc_id, digest, other)``: ``other`` is the digest after tampering, null where it is not tampered with.

    ``group`` orders as languages do, null first and else by bytes. Other columns are not read.
    """
    values = {c: F.col(c) for c in FIELDS}
    tampered = values | {"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)}
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lang = F.col("lang").cast("string")
    return docs.select(F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang)).alias("group"), "doc_id", leaf(values).alias("digest"), F.when(chosen, leaf(tampered)).alias("other"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, their place within their ``group`` by ``order``, and ``n``, the group's size."""
    placed = rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "ordered").withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("group", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # A row for each partition and group.
    whole = Window.partitionBy("group")
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    starts = parts.select("group", "_part", "_first", before.alias("_before"), F.sum("_n").over(whole).alias("n"))
    return placed.join(starts, ["group", "_part"]).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("pos"), "n")


class Run:
    """Nodes of one level below one parent, built from leaves in order; holds one unfinished run for each level below."""

    def __init__(self, level: int):
        self.open: list[list[bytes]] = [[] for _ in range(level + 1)]

    @property
    def nodes(self) -> list[bytes]:
        return self.open[-1]

    def take(self, digest: bytes) -> None:
        self.open[0].append(digest)
        for low, up in zip(self.open, self.open[1:], strict=False):
            if len(low) < WIDTH:
                break
            up.append(combine(low))
            low.clear()

    def close(self) -> None:
        """Shorter last runs become nodes too."""
        for low, up in zip(self.open, self.open[1:], strict=False):
            if low:
                up.append(combine(low))
                low.clear()


def depth(n: int, levels: int) -> int:
    """Levels of runs in a block of a group of ``n``: until one node is left, or the block is one node."""
    k = 0
    while n > 1 and k < levels:
        n, k = -(-n // WIDTH), k + 1
    return k


def block_root(digests: list[bytes], levels: int) -> bytes:
    run = Run(levels)
    for d in digests:
        run.take(d)
    run.close()
    return run.nodes[0]


def traverse(digests: list[bytes], levels: int) -> Iterator[list[Step]]:
    """The proof of each leaf of a block, in order, level by level up to the block's root."""

    def built(level: int, start: int) -> Run:
        run = Run(level)
        for d in digests[start : start + WIDTH ** (level + 1)]:
            run.take(d)
        run.close()
        return run

    existing = [built(k, 0) for k in range(levels)]
    desired = [Run(k) for k in range(levels)]
    for at in range(len(digests)):
        for k in range(levels):
            span = WIDTH ** (k + 1)
            if at and at % span == 0:
                desired[k].close()
                existing[k], desired[k] = desired[k], Run(k)
            if at + span < len(digests):
                desired[k].take(digests[at + span])
        yield [((at // WIDTH**k) % WIDTH, [d for j, d in enumerate(run.nodes) if j != (at // WIDTH**k) % WIDTH]) for k, run in enumerate(existing)]


def fold(digest: bytes, proof: list[Step]) -> bytes:
    for place, others in proof:
        digest = combine([*others[:place], digest, *others[place:]])
    return digest


def packed(proof: list[Step]) -> bytes:
    return b"".join(bytes([place, len(others)]) + b"".join(others) for place, others in proof)


def unpacked(data: bytes) -> list[Step]:
    out, at = [], 0
    while at < len(data):
        place, n = data[at], data[at + 1]
        out.append((place, [data[at + 2 + 32 * j : at + 34 + 32 * j] for j in range(n)]))
        at += 2 + 32 * n
    return out


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (group, pos, n, digest) with their aligned ``block``."""
    return nodes.withColumn("block", F.floor(F.col("pos") / WIDTH**levels))


def _sorted(part: pa.Table) -> tuple[pa.Table, list[bytes], int]:
    part = part.sort_by("pos")
    return part, part["digest"].to_pylist(), part["n"][0].as_py()


def lifted(nodes: DataFrame, levels: int) -> DataFrame:
    """The roots of the nodes' blocks, as nodes."""

    def run(part: pa.Table) -> pa.Table:
        _, digests, n = _sorted(part)
        root = block_root(digests, depth(n, levels))
        return pa.table({"group": part["group"][:1], "pos": part["block"][:1], "n": pa.array([-(-n // WIDTH**levels)], pa.int64()), "digest": pa.array([root], pa.binary())})

    return _blocks(nodes.select("group", "pos", "n", "digest"), levels).groupBy("group", "block").applyInArrow(run, "group string, pos long, n long, digest binary")


def tiers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` and all tables of block roots above them; a group ends with the table in which it has one node (``n`` = 1)."""
    out = [nodes]
    while not (rest := out[-1].where("n > 1")).isEmpty():
        out.append(materialize(lifted(rest, levels), "merkle-nodes"))
    return out


def with_proofs(nodes: DataFrame, above: DataFrame, levels: int, finish: Callable[[pa.Table, list[bytes], list[list[Step]], list[Step], pa.Table], pa.Table], schema: str) -> DataFrame:
    """``finish`` over every block of ``nodes`` (group, pos, n, digest, ...), which gets the block's nodes, digests and proofs, and its root's proof and row of ``above`` (group, pos, proof, ...)."""

    def run(part: pa.Table, header: pa.Table) -> pa.Table:
        part, digests, n = _sorted(part)
        return finish(part, digests, traverse(digests, depth(n, levels)), unpacked(header["proof"][0].as_py()), header)

    top = above.withColumnRenamed("pos", "block")
    return _blocks(nodes, levels).groupBy("group", "block").cogroup(top.groupBy("group", "block")).applyInArrow(run, schema)


def node_proofs(tables: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """``(group, pos, proof, subroot)`` of the nodes of the last but lowest table; ``tops`` (group, proof, subroot) has it for the groups' last nodes."""

    def finish(part: pa.Table, digests: list[bytes], proofs, upper: list[Step], header: pa.Table) -> pa.Table:
        out = [packed([*p, *upper]) for p in proofs]
        return pa.table({"group": part["group"], "pos": part["pos"], "proof": pa.array(out, pa.binary()), "subroot": pa.array([header["subroot"][0].as_py()] * len(out), pa.binary())})

    schema = "group string, pos long, proof binary, subroot binary"
    known: DataFrame | None = None
    for nodes in reversed(tables):
        ended = nodes.where("n = 1").select("group", "pos").join(tops, "group").select("group", "pos", "proof", "subroot")
        inner = with_proofs(nodes.where("n > 1"), known, levels, finish, schema) if known is not None else None
        known = materialize(ended if inner is None else ended.union(inner), "merkle-proofs")
    return known


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, one row for each row of ``docs``; digests as hex.

    A leaf digests doc_id, source, lang, n_chars and text. Leaves of a language
    ascend by ``doc_id`` (null first; rows with the same id by digest, so repeated
    rows have equal digests and places of their own). Every ``WIDTH`` nodes become
    one until one is left; a single leaf is its own subroot. Subroots, by
    language, become the root in the same way. ``proof_sha256`` digests the other
    nodes of every run on the way up, as hex text. ``folded_root`` is recomputed
    from them and the leaf as it is after tampering: the text's A-Z lower-cased
    where 3 divides the CRC-32 of the decimal id, never where id or text is null.
    Empty texts are digested as such, texts of any length whole. No rows give no
    rows. ``doc_id`` may be of any type that has an order. Other columns are not
    read. Results do not depend on ``levels``.
    """
    read = materialize(leaves(docs), "leaves")
    rows = materialize(numbered(read, "doc_id", "digest"), "numbered")
    low = tiers(rows.select("group", "pos", "n", "digest"), levels)
    subroots = low[0].where("n = 1").select("group", "digest")
    for t in low[1:]:
        subroots = subroots.union(t.where("n = 1").select("group", "digest"))
    named = subroots.select(F.lit("").alias("group"), F.col("group").alias("lang_group"), "digest")
    tops = materialize(numbered(named, "lang_group"), "subroots")
    high = tiers(tops.select("group", "pos", "n", "digest"), levels)
    last = high[-1].select("group", F.lit(b"").alias("proof"), F.col("digest").alias("subroot"))  # one row, the root
    proven = node_proofs(high, last, levels).select("pos", "proof", F.col("subroot").alias("root"))
    upper = materialize(tops.join(proven, "pos").select(F.col("lang_group").alias("group"), "proof", F.col("digest").alias("subroot"), "root"), "upper-proofs")
    above = node_proofs(low[1:], upper, levels) if len(low) > 1 else None

    id_type = dict(docs.select("doc_id").dtypes)["doc_id"]
    schema = f"doc_id {id_type}, leaf string, proof_sha256 string, folded_root string, group string"

    def finish(part: pa.Table, digests: list[bytes], proofs, over: list[Step], header: pa.Table) -> pa.Table:
        tail = "".join(d.hex() for _, others in over for d in others).encode()
        shas, folded = [], []
        for digest, other, proof in zip(digests, part["other"].to_pylist(), proofs, strict=True):
            h = hashlib.sha256("".join(d.hex() for _, others in proof for d in others).encode())
            h.update(tail)
            shas.append(h.hexdigest())
            folded.append(fold(other or digest, [*proof, *over]).hex())
        return pa.table({"doc_id": part["doc_id"], "leaf": pa.array([d.hex() for d in digests], pa.string()), "proof_sha256": pa.array(shas, pa.string()), "folded_root": pa.array(folded, pa.string()), "group": part["group"]})

    # A language with one document has a proof above it only.
    single = upper.join(rows.where("n = 1").select("group"), "group").select("group", F.lit(0).cast("long").alias("pos"), "proof")
    found = with_proofs(rows.where("n = 1"), single, levels, finish, schema)
    if above is not None:
        found = with_proofs(rows.where("n > 1"), above, levels, finish, schema).union(found)
    hexed = upper.select("group", F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("root")).alias("root"))
    return found.join(hexed, "group").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle(heights: tuple[int, int] = (6, 3)) -> str:
    """DuckDB SQL of ``manifest`` over documents, for up to ``WIDTH ** heights`` documents of a language and languages."""
    number = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    row = lambda text: "sha256(" + " || ".join(number(text if c == "text" else c) for c in FIELDS) + ")"
    bit = "lambda x, z: xor(x >> 1, 3988292384 * (x & 1))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], {bit})), 4294967295)"
    parts = [
        "named AS (SELECT *, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g FROM documents)",
        f"read AS (SELECT g, doc_id, {row('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {row(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE leaf END AS fold FROM named)",
        "a0 AS (SELECT g, leaf AS d, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, doc_id, fold FROM read)",
    ]

    def tree(t: str, height: int) -> None:
        for k in range(height):
            parts.append(f"{t}r{k} AS (SELECT g, pos // {WIDTH} AS run, list(d ORDER BY pos) AS ds, max(n) AS n FROM {t}{k} GROUP BY ALL)")
            parts.append(f"{t}{k + 1} AS (SELECT g, run AS pos, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d, (n + {WIDTH - 1}) // {WIDTH} AS n FROM {t}r{k})")

    def climb(t: str, height: int, start: str) -> str:
        for k in range(height):
            at = f"x.pos // {WIDTH**k} % {WIDTH}"
            sides = f"array_to_string(ds[1:{at}], '') AS l, array_to_string(ds[{at} + 2:], '') AS r"
            parts.append(f"{t}c{k} AS (SELECT x.* EXCLUDE (proof, fold), proof || l || r AS proof, CASE WHEN y.n = 1 THEN fold ELSE sha256(l || fold || r) END AS fold FROM (SELECT x.*, y.n AS yn, {sides} FROM {start} x JOIN {t}r{k} y ON x.g = y.g AND x.pos // {WIDTH ** (k + 1)} = y.run) x JOIN (SELECT g AS yg, max(n) AS n FROM {t}r{k} GROUP BY 1) y ON x.g = y.yg)".replace("x.* EXCLUDE (proof, fold)", "x.* EXCLUDE (proof, fold, l, r, yn)"))
            start = f"{t}c{k}"
        return start

    tree("a", heights[0])
    parts.append(f"b0 AS (SELECT '' AS g, g AS of, d, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM a{heights[0]})")
    tree("b", heights[1])
    parts.append("s0 AS (SELECT *, '' AS proof FROM a0)")
    last = climb("a", heights[0], "s0")
    parts.append(f"s1 AS (SELECT doc_id, leaf, subroot, fold, proof, '' AS g, b0.pos FROM (SELECT doc_id, d AS leaf, fold, proof, g AS of FROM {last}) JOIN (SELECT of, d AS subroot, pos FROM b0) b0 USING (of))")
    last = climb("b", heights[1], "s1")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = d AS verified FROM {last}, b{heights[1]}"
