"""Whitening of embeddings by a compensated covariance.

Entries become whole numbers, so counts and sums are exact. Outer products of
centred vectors are accumulated in double-double (an unevaluated sum of a high
and a low double): products and sums are error-free transformations, so nothing
of the 53 bits is lost however many rows there are. Each task sends the high
and low parts of its upper triangle, which are merged in two steps.

The eigenvectors come from LAPACK's ``syevd`` (``numpy.linalg.eigh``): reduction
to a tridiagonal matrix, then divide and conquer. The leading ones are then
refined against the double-double covariance.

What the driver holds is the covariance, the square of the vectors' length;
it does not grow with the rows.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polynym.operators.materialize import materialize

Batches = Iterator[pa.RecordBatch]
Pair = tuple[np.ndarray, np.ndarray]
#: Entries are scaled, rounded down and shifted to whole numbers.
SCALE, SHIFT = 1024, 100_000
#: Rows whose products are formed at once, a power of two.
ROWS = 256
#: Groups in which tasks' sums are merged first.
SALTS = 32
SPLIT = 134217729.0  # 2**27 + 1


# -- error-free transformations ------------------------------------------------


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> Pair:
    """The number as a sum of two of 26 bits, whose products are exact."""
    t = SPLIT * a
    high = t - (t - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray, ha: Pair, hb: Pair) -> Pair:
    """The rounded product and its error; ``ha`` and ``hb`` are the halves."""
    p = a * b
    return p, ((ha[0] * hb[0] - p) + ha[0] * hb[1] + ha[1] * hb[0]) + ha[1] * hb[1]


def add(a: Pair, b: Pair) -> Pair:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(values: Pair) -> Pair:
    """The sum along the first axis, whose length is a power of two."""
    while len(values[0]) > 1:
        half = len(values[0]) // 2
        values = add((values[0][:half], values[1][:half]), (values[0][half:], values[1][half:]))
    return values[0][0], values[1][0]


def as_pair(value: Fraction) -> tuple[float, float]:
    high = float(value)
    return high, float(value - Fraction(high))


# -- rows ------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Whether a vector is not null, has entries, and none of them is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, whole numbers as doubles) for each length of the vectors in a list column."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(ends)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        x = np.floor(flat[ends[rows][:, None] + np.arange(d)] * SCALE) + SHIFT
        if (np.abs(x) >= 2.0**52).any():
            raise ValueError(f"an entry is too large: {SCALE} times it has to stay below 2**52")
        yield rows, x


def sum_batches(batches: Batches) -> Batches:
    """Rows (size, dim, n, total): each length's count and exact sums of a task."""
    held: dict[int, list] = {}
    for b in batches:
        for rows, x in matrices(b.column("vector")):
            whole = x.astype(np.int64)
            if np.abs(x).max() * len(x) >= 2.0**62:
                whole = whole.astype(object)
            mine = held.setdefault(x.shape[1], [0, [0] * x.shape[1]])
            mine[0] += len(rows)
            mine[1] = [s + int(t) for s, t in zip(mine[1], whole.sum(axis=0), strict=True)]
    for d, (n, sums) in held.items():
        columns = [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(decimal.Decimal, sums), pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["size", "dim", "n", "total"])


@dataclass(frozen=True)
class Moments:
    """Count and sums, exact, and the mean as a double-double."""

    n: int
    sums: tuple[int, ...]

    @property
    def mean(self) -> Pair:
        pairs = [as_pair(Fraction(s, self.n)) for s in self.sums]
        return np.array([p for p, _ in pairs]), np.array([q for _, q in pairs])

    def centred(self, x: np.ndarray, mean: Pair) -> Pair:
        s, e = two_sum(x, -mean[0])
        return two_sum(s, e - mean[1])

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Of each row the sum of the squares of ``n * x - sums``, exact; null beyond 38 digits."""
        if self.n * float(np.abs(x).max(initial=0)) < 2.0**61:
            apart = x.astype(np.int64) * self.n - np.array(self.sums, dtype=np.int64)
            if float(np.abs(apart).max(initial=0)) ** 2 * len(self.sums) < 2.0**62:
                return pa.array((apart * apart).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
            apart = apart.astype(object)
        else:
            apart = x.astype(np.int64).astype(object) * self.n - np.array(self.sums, dtype=object)
        return pa.array([decimal.Decimal(int(v)) if v < 10**38 else None for v in (apart * apart).sum(axis=1)], pa.decimal128(38, 0))


def moments(rows: DataFrame) -> Moments | None:
    """Of the vectors of the most common length, the larger one of two; None without any. A row for each dimension comes to the driver."""
    sums = rows.select("vector").mapInArrow(sum_batches, "size int, dim int, n long, total decimal(38,0)")
    found = sums.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    if not found:
        return None
    size = max((r.n, r["size"]) for r in found)[1]
    mine = sorted((r.dim, r.n, r.total) for r in found if r["size"] == size)
    return Moments(mine[0][1], tuple(int(t) for _, _, t in mine))


# -- covariance --------------------------------------------------------------------


def product_batches(of: Moments):
    """Rows (salt, i, high, low): each task's sums of the products of dimension i with i and all later ones."""

    def run(batches: Batches) -> Batches:
        d, mean = len(of.sums), of.mean
        high, low = np.zeros((d, d)), np.zeros((d, d))
        for b in batches:
            for rows, x in matrices(b.column("vector")):
                if x.shape[1] != d:
                    continue
                for k in range(0, len(rows), ROWS):
                    y, z = of.centred(x[k : k + ROWS], mean)
                    short = (1 << (len(y) - 1).bit_length()) - len(y)
                    y, z = (np.pad(v, ((0, short), (0, 0))) for v in (y, z))
                    h = halves(y)
                    for i in range(d):
                        one = slice(i, i + 1)
                        p, e = two_product(y[:, one], y[:, i:], (h[0][:, one], h[1][:, one]), (h[0][:, i:], h[1][:, i:]))
                        e += y[:, one] * z[:, i:] + z[:, one] * y[:, i:]
                        high[i, i:], low[i, i:] = add((high[i, i:], low[i, i:]), total(two_sum(p, e)))
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([pa.array([salt] * d, pa.int32()), pa.array(range(d), pa.int32()), *(pa.array([v[i, i:] for i in range(d)], pa.list_(pa.float64())) for v in (high, low))], ["salt", "i", "high", "low"])

    return run


def merged(part: pa.Table) -> pa.Table:
    """The rows of one dimension as one."""
    got: Pair | None = None
    for a, b in zip(part["high"].to_pylist(), part["low"].to_pylist(), strict=True):
        one = np.array(a), np.array(b)
        got = one if got is None else add(got, one)
    return pa.table({"salt": pa.array([0], pa.int32()), "i": part["i"][:1], "high": [got[0].tolist()], "low": [got[1].tolist()]})


def covariance(rows: DataFrame, of: Moments, tasks: int) -> Pair:
    """The covariance, divisor n, as a double-double matrix.

    Each of at most ``tasks`` tasks holds and sends one triangle, so what is merged grows with the cluster, not with the table.
    """
    schema = "salt int, i int, high array<double>, low array<double>"
    sums = rows.select("vector").coalesce(tasks).mapInArrow(product_batches(of), schema)
    found = sums.groupBy("salt", "i").applyInArrow(merged, schema).groupBy("i").applyInArrow(merged, schema).collect()
    d = len(of.sums)
    out = np.zeros((d, d)), np.zeros((d, d))
    for r in found:
        for j, (a, b) in enumerate(zip(r.high, r.low, strict=True), r.i):
            value = as_pair((Fraction(a) + Fraction(b)) / of.n)
            for v, part in zip(out, value, strict=True):
                v[r.i, j] = v[j, r.i] = part
    return out


@dataclass(frozen=True)
class Components:
    """Leading unit eigenvectors (columns), their eigenvalues, and the sum of all eigenvalues."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float


def times(matrix: Pair, x: np.ndarray) -> Pair:
    """The product of a double-double matrix and a vector of doubles, as a double-double."""
    d = 1 << (len(x) - 1).bit_length()
    rows = np.pad(matrix[0], ((0, 0), (0, d - len(x)))).T
    column = np.pad(x, (0, d - len(x)))[:, None]
    p, e = two_product(rows, column, halves(rows), halves(column))
    return add(total(two_sum(p, e)), (matrix[1] @ x, np.zeros(len(x))))


def components(matrix: Pair, most: int) -> Components:
    """Up to ``most`` components by falling eigenvalue; those without variance are left out.

    Of an eigenvector the part along each other one is corrected by its
    residual, computed in double-double, over the gap between the two. The
    largest entry of each is positive.
    """
    values, vectors = np.linalg.eigh(matrix[0])
    values, vectors = values[::-1].copy(), vectors[:, ::-1].copy()
    floor = len(values) * np.finfo(float).eps * abs(values[0])
    k = min(most, int((values > floor).sum()))
    for _ in range(2):
        better = vectors[:, :k].copy()
        for c in range(k):
            x = vectors[:, c]
            y = times(matrix, x)
            level = float(x @ y[0] + x @ y[1]) / float(x @ x)
            p, e = two_product(np.full(len(x), level), x, halves(np.full(len(x), level)), halves(x))
            rest = add(y, (-p, -e))
            gaps = level - values
            gaps[c] = np.inf
            gaps[np.abs(gaps) <= floor] = np.inf  # one eigenvalue: any basis of its space will do
            better[:, c] = x + vectors @ ((vectors.T @ (rest[0] + rest[1])) / gaps)
            better[:, c] /= np.linalg.norm(better[:, c])
            values[c] = level
        vectors[:, :k] = better
    lead = vectors[:, :k]
    if k:
        lead = lead * np.sign(lead[np.abs(lead).argmax(axis=0), np.arange(k)])
    return Components(lead, values[:k], float(sum(Fraction(a) + Fraction(b) for a, b in zip(np.diag(matrix[0]).tolist(), np.diag(matrix[1]).tolist(), strict=True))))


def whiten_batches(of: Moments, by: Components):
    def run(batches: Batches) -> Batches:
        mean, scaled = of.mean, by.vectors / np.sqrt(by.values)
        for b in batches:
            for rows, x in matrices(b.column("vector")):
                if x.shape[1] != len(of.sums):
                    continue
                y, z = of.centred(x, mean)
                white = y @ scaled + z @ scaled
                k = white.shape[1]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), pa.array(white.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), of.deviations(x), listed], ["vec_id", "deviation", "whitened"])

    return run


@dataclass(frozen=True)
class Whitened:
    """``rows``: vec_id, deviation decimal(38,0), whitened array<double>; and what they were made with."""

    rows: DataFrame
    moments: Moments | None
    components: Components
    identity_error: float | None


def whiten(vectors: DataFrame, most: int = 8, tasks: int | None = None) -> Whitened:
    """Vectors (vec_id, embedding) in up to ``most`` whitened components.

    Rows whose vector is null, empty, or holds null or non-finite entries go, and
    so do rows of another length than the most common one, which have no
    covariance with the others. ``vec_id`` may be of any type, null or repeated:
    every row counts. Components without variance are left out; without any
    (no rows, or all equal) the arrays are empty. Entries have to stay below
    2**42 for their whole numbers to be exact, else ``ValueError`` is raised in
    the task. Other columns are not read. ``tasks``: see ``covariance``.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    of = moments(rows)
    none = Components(np.zeros((0, 0)), np.zeros(0), 0.0)
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, deviation decimal(38,0), whitened array<double>"
    if of is None:
        return Whitened(spark.createDataFrame([], schema), None, none, None)
    by = components(covariance(rows, of, tasks or 4 * spark.sparkContext.defaultParallelism), most)
    out = materialize(rows.mapInArrow(whiten_batches(of, by), schema), "whitened")
    k = len(by.values)
    if not k:
        return Whitened(out, of, by, None)
    entry = lambda i: F.get("whitened", F.lit(i))
    spread = [F.abs(F.covar_pop(entry(i), entry(j)) - float(i == j)) for i in range(k) for j in range(i, k)]
    return Whitened(out, of, by, out.agg(F.greatest(*spread, F.lit(0.0)).alias("error")).first().error)


def whitened_components(vectors: DataFrame, most: int = 8) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row for each vector and component; see ``whiten``.

    ``deviation`` is null where it exceeds a long; ``Whitened.rows`` has it as a decimal.
    """
    found = whiten(vectors, most)
    explained = F.array(*(F.lit(float(v / found.components.trace)) for v in found.components.values)).cast("array<double>")
    rows = found.rows.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(found.moments.n if found.moments else None).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(found.identity_error).cast("double").alias("identity_error"))
