"""SimHash near-duplicates with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polynym.llm import shingle_sets
from polynym.operators.components import connected_components
from polynym.operators.materialize import materialize

BITS = 64
SEED = 42


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of the ``width``-word shingles of one text, as a signed 64-bit number.

    ASCII letters are lower-cased and words are runs of anything but ASCII white
    space. A bit is set if it is set in over half the shingles' XXH64 values.
    Fewer than ``width`` words make one shingle; no word makes zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(words) - width + 1)
    stop = end[width - 1 :] if len(words) >= width else end[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), stop.tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = [fingerprint(t.as_py() or b"", width) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


def segments(max_diff: int) -> list[tuple[int, int]]:
    """(first bit, width) of the ``max_diff + 1`` segments of the ring."""
    m = max_diff + 1
    cut = [BITS * i // m for i in range(m + 1)]
    return [(cut[i], cut[i + 1] - cut[i]) for i in range(m)]


def _bits(fp: Column, parts: list[tuple[int, int]]) -> Column:
    """The given bit ranges of a fingerprint, side by side in one long."""
    out, at = F.lit(0).cast("long"), 0
    for first, width in parts:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long")), at))
        at += width
    return out


def chain_keys(fp: Column, max_diff: int) -> Column:
    """The join keys of a fingerprint, one for each way a chain can begin.

    With ``t`` differences over ``t + 1`` segments in a ring, some segment starts
    a chain whose first ``l`` segments differ in at most ``l*t/(t+1)`` bits,
    i.e. ``l - 1``, for every ``l``. So that segment agrees, and the two after it
    differ in at most two bits together: cut in three, one third agrees too.
    """
    seg, keys = segments(max_diff), []
    m = len(seg)
    for i in range(m):
        following = [(f + k, 1) for j in range(1, min(3, m)) for f, w in [seg[(i + j) % m]] for k in range(w)]
        thirds = min(3, m)
        for p in range(thirds):
            own = following[len(following) * p // thirds : len(following) * (p + 1) // thirds]
            keys.append(F.xxhash64(F.lit(i * 3 + p), _bits(fp, [seg[i]]), _bits(fp, _runs(own))))
    return F.array(*keys)


def _runs(bits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for f, w in bits:
        if out and out[-1][0] + out[-1][1] == f:
            out[-1] = (out[-1][0], out[-1][1] + w)
        else:
            out.append((f, w))
    return out


def pigeonring(x: np.ndarray, max_diff: int) -> np.ndarray:
    """Which XORed pairs pass: a viable chain exists and the whole distance is within ``max_diff``."""
    seg = segments(max_diff)
    m = len(seg)
    count = [np.bitwise_count((x >> np.uint64(f)) & np.uint64((1 << w) - 1)) for f, w in seg]
    passed = np.zeros(len(x), dtype=bool)
    for i in range(m):
        ok, total = np.ones(len(x), dtype=bool), np.zeros(len(x), dtype=np.uint8)
        for step in range(m):
            total = total + count[(i + step) % m]
            ok &= total <= (step + 1) * max_diff // m
        passed |= ok
    return passed & (np.bitwise_count(x) <= max_diff)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b: at most one row per node."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = where[: len(a)], where[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def link_cells(max_diff: int, pairs_at_once: int = 1 << 20):
    """Compare the fingerprints within each cell; rows arrive sorted by cell.

    Emits a spanning forest of the links, so the output is linear in the rows.
    """

    def flush(key, a, b, side, fp) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        for n in np.unique(size[size > 1]):
            at = first[size == n]
            p, q = np.triu_indices(n, 1)
            step = max(1, pairs_at_once // len(p))
            for k in range(0, len(at), step):
                i, j = (at[k : k + step, None] + p).ravel(), (at[k : k + step, None] + q).ravel()
                cross = (a[i] == b[i]) | (side[i] != side[j])
                i, j = i[cross], j[cross]
                ok = pigeonring((fp[i] ^ fp[j]).view(np.uint64), max_diff)
                if ok.any():
                    u, v = _forest(fp[i[ok]], fp[j[ok]])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            if not len(cols[0]):
                continue
            key, a, b = cols[:3]
            last = np.flatnonzero((key != key[-1]) | (a != a[-1]) | (b != b[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from flush(*(c[:cut] for c in cols))
            kept = [c[cut:] for c in cols]
        if kept is not None and len(kept[0]):
            yield from flush(*kept)

    return run


def link_fingerprints(fps: DataFrame, max_diff: int = 4, block: int = 512) -> DataFrame:
    """Links ``(src, dst)`` that connect all fingerprints ``fp`` within ``max_diff`` bits.

    The rows connect exactly what all links would connect, without listing every
    pair of a dense group. A bucket of more than ``block`` fingerprints is dealt
    out in squares of two blocks each, so no bucket is ever one task's work.
    """
    keyed = fps.select("fp").where("fp is not null").distinct().select("fp", F.explode(chain_keys(F.col("fp"), max_diff)).alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = (
        keyed.join(shared, "key")
        .withColumn("s", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int"))
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), (F.col("s") > F.col("t")).cast("int").alias("side"), "fp")
    )
    cells = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return cells.mapInArrow(link_cells(max_diff), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, max_diff: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    Fingerprints link at ``max_diff`` or fewer differing bits; ``component_id`` is
    the smallest ``doc_id`` reachable, itself included. Equal fingerprints are one
    node, so a group of copies costs one row. Null or empty text: fingerprint
    zero, linked like any other. Null ``doc_id``: the row keeps its fingerprint
    and takes the component of that fingerprint (null if no row has an id).
    ``doc_id`` may be of any type that has an order.
    Repeated rows give repeated rows; other columns are not read.
    """
    hashed = materialize(fingerprints(docs, width, id_col, text_col), "simhash")
    nodes = hashed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    reached = connected_components(link_fingerprints(nodes, max_diff))
    joined = nodes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    lowest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(lowest, "component").select("fp", "component_id")
    return hashed.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, max_diff: int = 4, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group, its smallest ``doc_id`` stays.

    Groups by SimHash go first: fingerprints of ``width``-word shingles that link
    at ``max_diff`` bits, which settles exact and closest copies however many
    there are. A SimHash of 64 bits can't tell a similarity of 0.8 from none, so
    of the rest, groups with a Jaccard similarity of ``similarity`` or more of their
    shingles go too (see ``shingle_sets``). ``doc_id`` may be of any type that has an
    order. Rows that repeat one ``doc_id`` are one document and share its fate; rows
    without ``doc_id`` stay. All columns are returned as they were.
    """
    gone = near_duplicates(docs, width, max_diff).where("doc_id <> component_id").select("doc_id").distinct()
    left = materialize(docs.join(gone, "doc_id", "left_anti").select(docs.columns), "simhash-left")
    return shingle_sets.keep_one(left, width, similarity)
