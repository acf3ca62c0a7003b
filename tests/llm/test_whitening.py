import math
import random
from fractions import Fraction

import numpy as np

from polynym.llm import whitening


def brute(rows, most=8):
    """(vec_id, deviation, whitened list), exact up to the eigenvectors, which are of numpy's doubles."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in fine]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    apart = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(a[i] * a[j] for a in apart), n**3)) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    white = np.array(apart, dtype=float) / n @ q / np.sqrt(e)
    return n, [(i, sum(a * a for a in r)) for (i, _), r in zip(fine, apart, strict=True)], white, e / np.trace(v), v


def vectors(n=300, d=12):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(n, d)) * np.linspace(3, 0.01, d)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000, None), (1001, []), (1002, [1.0] * (d - 1) + [None]), (1003, [float("nan")] * d), (1004, [float("inf")] + [0.0] * (d - 1)), (7, rows[7][1]), (7, rows[7][1]), (None, rows[9][1]), (1005, [0.0] * d)]
    return rows


def test_against_brute_force(spark):
    rows = vectors()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, whitened string, n int").repartition(7)
    found = whitening.whiten(df)
    n, deviation, white, explained, _ = brute(rows)
    assert found.moments.n == n
    got = found.rows.collect()
    assert sorted(((r.vec_id, int(r.deviation)) for r in got), key=str) == sorted(deviation, key=str)
    by = {(i, d): w for (i, d), w in zip(deviation, white, strict=True)}
    signs = None
    for r in got:
        want, have = by[(r.vec_id, int(r.deviation))], np.array(r.whitened)
        signs = np.sign(want) * np.sign(have) if signs is None else signs
        assert np.allclose(have * signs, want, rtol=1e-9, atol=1e-9)
    assert np.allclose(found.components.values / found.components.trace, explained, rtol=1e-12)
    assert found.identity_error < 1e-10
    table = whitening.whitened_components(df)
    assert table.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert table.count() == 8 * n


def test_covariance_keeps_what_doubles_lose(spark):
    """A large common part and a tiny spread: the exact covariance, to the last bit of its double."""
    rnd = random.Random(2)
    rows = [(i, [1e9 + rnd.randint(0, 3) / 1024, -1e9 - rnd.randint(0, 5) / 1024, rnd.randint(0, 10) * 1e8]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    of = whitening.moments(df.select("embedding").withColumnRenamed("embedding", "vector"))
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    assert of.sums == tuple(sum(r[j] for r in x) for j in range(3))
    high, low = whitening.covariance(df.select("embedding").withColumnRenamed("embedding", "vector"), of, 4)
    for i in range(3):
        for j in range(3):
            want = Fraction(sum((700 * r[i] - of.sums[i]) * (700 * r[j] - of.sums[j]) for r in x), 700**3)
            assert high[i, j] == float(want)
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - want) <= abs(want) * Fraction(1, 10**25) + Fraction(1, 10**12)


def test_close_eigenvalues_are_refined():
    """Eigenvectors of a matrix whose low part matters, against a far more precise solution."""
    rnd = np.random.default_rng(3)
    q = np.linalg.qr(rnd.normal(size=(6, 6)))[0]
    e = [5.0, 5.0 - 1e-7, 3.0, 2.0, 1.0, 0.5]
    exact = [[sum(Fraction(float(q[i, k])) * Fraction(v) * Fraction(float(q[j, k])) for k, v in enumerate(e)) for j in range(6)] for i in range(6)]
    pair = tuple(np.array(m) for m in zip(*[list(zip(*[whitening.as_pair(v) for v in row], strict=True)) for row in exact], strict=True))
    got = whitening.components(pair, 2)
    for c in range(2):
        x = [Fraction(float(v)) for v in got.vectors[:, c]]
        rest = [sum(exact[i][j] * x[j] for j in range(6)) - Fraction(float(got.values[c])) * x[i] for i in range(6)]
        assert max(abs(float(r)) for r in rest) < 4e-15
    assert abs(float(got.vectors[:, 0] @ got.vectors[:, 1])) < 1e-8


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whitened_components(spark.createDataFrame(rows, schema)).collect() == []
    assert whitening.whitened_components(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    out = whitening.whitened_components(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [9.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 12), r.deviation, r.explained) for r in out) == [(1, 1, 1.0, 1024**2, 1.0), (2, 1, 1.0, 1024**2, 1.0)]


def test_deviation_beyond_a_long():
    of = whitening.Moments(10**9, (10**9 * 5, 0))
    x = np.array([[5e9, -3e9]])
    assert int(of.deviations(x)[0].as_py()) == (10**9 * (5 * 10**9 - 5)) ** 2 + (10**9 * 3 * 10**9) ** 2
    assert whitening.Moments(10**12, (0, 0)).deviations(x).to_pylist() == [None]
