import numpy as np
import pytest

from polynym.llm import epsilon_grid as E


def brute(rows, threshold):
    ok = [i is not None and v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], dtype=np.float32).astype(np.float64) for k in (i, j))
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return sorted(((rows[i][0], links[i], c := (least.get(find(i)) if ok[i] else rows[i][0]), rows[i][0] is not None and rows[i][0] == c) for i in range(n)), key=str)


@pytest.mark.parametrize("threshold", [0.98, 0.9])
def test_against_brute_force(spark, threshold):
    rnd = np.random.default_rng(10)
    rows, n = [], 0
    for lab in (0, 1, None):
        centres = rnd.normal(size=(8, 12))
        for c in centres:
            for _ in range(12):
                rows.append((n * 7 % 1009, (c + rnd.normal(size=12) * rnd.choice([0, 0.05, 0.1])).astype(np.float32).tolist(), lab))
                n += 1
    rows += [(2000 + k, v, 1) for k, v in enumerate([None, [], [0.0] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 0.0], [2.0, 0.0], [1e-30] * 12, [3.0] * 12])]
    rows += [(None, [1.0] * 12, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = sorted((tuple(r) for r in E.near_duplicates(df, threshold, leading=3, sample=50, block=16).collect()), key=str)
    assert got == brute(rows, threshold)


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
