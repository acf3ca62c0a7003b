"""Embedding near-duplicates by epsilon grid order.

Unit vectors are put in grid cells of side epsilon along leading principal
directions and sorted by cell. Blocks of the sequence are joined recursively;
parts whose boxes lie more than epsilon apart along any direction cannot hold a
link and are skipped. The directions are orthonormal, so distances along them
never exceed true distances and nothing is lost, however they were fitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polynym.operators.components import connected_components
from polynym.operators.materialize import materialize

Batches = Iterator[pa.RecordBatch]
LEAF = 48


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor zero and all its components are finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each vector length in a list column."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(ends)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, flat[ends[rows][:, None] + np.arange(d)]


def directions(classes: DataFrame, leading: int, sample: int) -> np.ndarray:
    """Principal directions (dim x leading) of at most ``sample`` vectors, those whose ids hash lowest.

    Vectors of the most common length in the sample count; no rows, no directions.
    """
    got = classes.select("rep", "vector").orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()
    sizes = [len(r.vector) for r in got]
    if not sizes:
        return np.zeros((0, 0))
    dim = max(set(sizes), key=sizes.count)
    u = _units(np.array([r.vector for r in got if len(r.vector) == dim], dtype=np.float64))
    u = u - u.mean(axis=0)
    return np.linalg.eigh(u.T @ u)[1][:, ::-1][:, :leading].copy()


def _project(u: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates along the directions; vectors of another length all lie at the origin."""
    return u @ basis if u.shape[1] == len(basis) else np.zeros((len(u), basis.shape[1]))


def cell_batches(basis: np.ndarray, epsilon: float):
    """Adds the grid cell of each vector."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            cells = np.zeros((len(b), basis.shape[1]), dtype=np.int32)
            column = b.column("vector")
            for rows, m in _groups(column):
                cells[rows] = np.floor(_project(_units(m), basis) / epsilon)
            k = basis.shape[1]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * k), pa.array(cells.ravel()))
            yield b.append_column("cell", listed)

    return run


def block_batches(most: int):
    """Cuts each partition's sequence into blocks of one label and vector length, ``most`` rows at most."""
    names = ["block", "label", "lo", "hi", "dim", "reps", "times", "vectors"]

    def run(batches: Batches) -> Batches:
        made, held = 0, None
        base = TaskContext.get().partitionId() << 32

        def emit(part: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = part.num_rows
            cells = part["cell"].combine_chunks().flatten().to_numpy().reshape(rows, -1)
            flat = part["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ints = [pa.array([part[c].to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("rep", "times")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + made]), pa.array([part["label"][0].as_py()], part["label"].type), pa.array([cells.min(axis=0).tolist()], pa.list_(pa.int32())), pa.array([cells.max(axis=0).tolist()], pa.list_(pa.int32())), pa.array([len(flat) // rows], pa.int32()), *ints, pa.array([flat.tobytes()], pa.binary())], names
            )
            made += 1

        for b in batches:
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new])
            bounds = cuts(held, False)
            for x, y in bounds:
                yield from emit(held.slice(x, y - x))
            held = held.slice(bounds[-1][1]) if bounds else held
        if held is not None:
            for x, y in cuts(held, True):
                yield from emit(held.slice(x, y - x))

    def cuts(t: pa.Table, last: bool) -> list[tuple[int, int]]:
        """Bounds of the whole blocks; at the end, of all."""
        label, size = t["label"].to_numpy(), t["dim"].to_numpy()
        change = np.flatnonzero((label[1:] != label[:-1]) | (size[1:] != size[:-1])) + 1
        out = []
        for a, b in zip([0, *change.tolist()], [*change.tolist(), t.num_rows], strict=True):
            out += [(x, min(x + most, b)) for x in range(a, b, most) if x + most <= b or b < t.num_rows or last]
        return out

    return run


def _intervals(ya: np.ndarray, yb: np.ndarray, epsilon: float, same: bool) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of short intervals of two sequences whose boxes lie within epsilon."""
    stack = [(0, len(ya), 0, len(yb))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if same and b1 <= a0:
            continue
        p, q = ya[a0:a1], yb[b0:b1]
        if p.shape[1] and ((p.min(axis=0) - q.max(axis=0) > epsilon) | (q.min(axis=0) - p.max(axis=0) > epsilon)).any():
            continue
        na, nb = a1 - a0, b1 - b0
        if max(na, nb) <= LEAF:
            yield a0, a1, b0, b1
            continue
        am, bm = (a0 + a1) // 2, (b0 + b1) // 2
        left = [(a0, am), (am, a1)] if na > LEAF else [(a0, a1)]
        right = [(b0, bm), (bm, b1)] if nb > LEAF else [(b0, b1)]
        stack += [(*x, *y) for x in left for y in right]


def join_batches(basis: np.ndarray, epsilon: float, threshold: float):
    """Pairs of blocks to (node, links, other): links counted for each node, and edges of a spanning forest."""
    names = ["node", "links", "other"]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for r in range(len(batch)):
                row = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                same = row["block"] == row["block_b"]
                side = []
                for tail in ("", "_b"):
                    m = np.frombuffer(row["vectors" + tail]).reshape(-1, row["dim"])
                    u = _units(m)
                    side.append((np.frombuffer(row["reps" + tail], dtype=np.int64), np.frombuffer(row["times" + tail], dtype=np.int64), m, u))
                (ra, ta, ma, ua), (rb, tb, mb, ub) = side
                na, nb = (np.sqrt((m * m).sum(axis=1)) for m in (ma, mb))
                ya, yb = _project(ua, basis), _project(ub, basis)
                count_a, count_b = np.zeros(len(ra), dtype=np.int64), np.zeros(len(rb), dtype=np.int64)
                root = np.arange(len(ra) + (0 if same else len(rb)))
                for a0, a1, b0, b1 in _intervals(ya, yb, epsilon, same):
                    ok = ma[a0:a1] @ mb[b0:b1].T / (na[a0:a1, None] * nb[None, b0:b1]) >= threshold
                    if same:
                        ok &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
                    i, j = np.nonzero(ok)
                    if len(i):
                        np.add.at(count_a, a0 + i, tb[b0 + j])
                        np.add.at(count_b, b0 + j, ta[a0 + i])
                        _unite(root, a0 + i, b0 + j + (0 if same else len(ra)))
                reps = ra if same else np.concatenate([ra, rb])
                links = count_a + count_b if same else np.concatenate([count_a, count_b])
                some, own = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(links[some]), pa.nulls(len(some), pa.int64())], names)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(reps[own]), pa.nulls(len(own), pa.int64()), pa.array(reps[root[own]])], names)

    return run


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of each i and j; ``root`` stays flat."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, leading: int = 6, sample: int = 4000, block: int = 512) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Rows link when their labels are equal and their cosine, in double precision,
    is ``threshold`` (over zero) or more. Null labels and ids, and vectors that
    are null, zero or hold null or non-finite components link with nothing: such
    a row is a component of its own. Equal vectors of a label are one node with
    a count, and a block pair gives counts and a spanning forest, so no group is
    listed pair by pair. Vectors of different lengths never link. Rows that
    repeat a ``vec_id`` are counted as vectors, and are one node. Directions are
    fitted on at most ``sample`` vectors; this affects speed only. ``vec_id`` is an
    integer, or text that is one. Other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    epsilon = math.sqrt(2 - 2 * threshold) * (1 + 1e-9) + 1e-7
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), "label")
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("vector"))
    classes = materialize(rows.where(fine).groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")), "vector-classes")
    basis = directions(classes, leading, sample)
    k = basis.shape[1]
    kinds = dict(classes.dtypes)
    placed = classes.mapInArrow(cell_batches(basis, epsilon), f"label {kinds['label']}, vector {kinds['vector']}, rep long, times long, cell array<int>").withColumn("dim", F.size("vector"))
    order = ["label", "dim", *(F.get("cell", F.lit(j)) for j in range(k)), "rep"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"block long, label {kinds['label']}, lo array<int>, hi array<int>, dim int, reps binary, times binary, vectors binary"
    blocks = materialize(ordered.mapInArrow(block_batches(block), schema), "vector-blocks")

    meta = blocks.select("block", "label", "dim", "lo", "hi")
    low, high = (F.get("lo", F.lit(0)), F.get("hi", F.lit(0))) if k else (F.lit(0), F.lit(0))
    one = meta.select("*", F.explode(F.sequence(low, high)).alias("stripe"))
    two = meta.select(*(F.col(c).alias(f"{c}_b") for c in ("block", "lo", "hi")), "label", "dim", F.explode(F.sequence(low - 1, high + 1)).alias("stripe"))
    close = F.lit(True)
    for j in range(k):
        close &= (F.get("lo", F.lit(j)) <= F.get("hi_b", F.lit(j)) + 1) & (F.get("lo_b", F.lit(j)) <= F.get("hi", F.lit(j)) + 1)
    pairs = one.join(two, ["label", "dim", "stripe"]).where((F.col("block") <= F.col("block_b")) & close).select("block", "block_b").distinct()
    payload = blocks.select("block", "dim", "reps", "times", "vectors")
    other = payload.select(*(F.col(c).alias(f"{c}_b") for c in ("block", "reps", "times", "vectors")))
    joined = pairs.join(payload, "block").join(other, "block_b").repartition("block", "block_b")
    found = materialize(joined.mapInArrow(join_batches(basis, epsilon, threshold), "node long, links long, other long"), "vector-links")

    counts = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    reached = connected_components(found.where("other is not null").select("node", "other"), "node", "other")
    named = classes.select("label", "vector", "rep", "times").join(counts.withColumnRenamed("node", "rep"), "rep", "left").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("label", "vector", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.where(fine).join(named, ["label", "vector"]).select("vec_id", "links", "component")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long"), "vec_id")
    return out.union(alone).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


def oracle(threshold: float) -> str:
    """DuckDB SQL of ``near_duplicates`` over embeddings, by comparing all pairs of a label."""
    fine = "label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return f"""WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE {fine}),
l AS (SELECT a.vec_id AS s, b.vec_id AS d FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
reach AS (SELECT vec_id AS n, vec_id AS r FROM embeddings UNION SELECT reach.n, l.d FROM reach JOIN l ON l.s = reach.r),
roots AS (SELECT n, min(r) AS component_id FROM reach GROUP BY 1), links AS (SELECT s, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN roots ON n = vec_id LEFT JOIN links ON s = vec_id"""
