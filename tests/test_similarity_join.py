"""String joins against all pairs."""

import random

import numpy as np
import pytest

from polynym.functions.similarity import jaro_winkler_value, jaro_winkler_values
from polynym.operators import similarity_join as J


def strings(rnd, n, letters, longest):
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, longest))) for _ in range(n // 3)]
    out = []
    for _ in range(n):
        s = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randint(0, len(s))
            s[i : i + rnd.randint(0, 1)] = rnd.choice(letters) * rnd.randint(0, 2)
        out.append("".join(s))
    return sorted(set(out))


@pytest.mark.parametrize(("letters", "longest"), [("ab", 8), ("abcdefghij ", 14), ("ab\x00日𝒳", 9), ("abc", 120)])
def test_jaro_winkler_of_many_is_that_of_each(letters, longest):
    rnd = random.Random(longest)
    pool = strings(rnd, 150, letters, longest)
    a, b = ([rnd.choice(pool) for _ in range(1500)] for _ in range(2))
    for boost in (False, True):
        assert jaro_winkler_values(a, b, boost).tolist() == [jaro_winkler_value(x, y, boost) for x, y in zip(a, b)]
    assert jaro_winkler_values([], []).tolist() == []


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.7, 0.75, 0.85, 0.95, 1.0])
@pytest.mark.parametrize(("letters", "longest"), [("ab", 6), ("abcdefghijklmno", 12), ("abcdefgh", 30)])
def test_pairs_of_the_threshold_share_a_key(threshold, letters, longest):
    rnd = random.Random(longest)
    pool = [s for s in strings(rnd, 160, letters, longest) if s]
    often = {c: sum(c in s for s in pool) for c in letters}
    keys = {s: J.jaro_winkler_keys(s, threshold, often) for s in pool}
    found = 0
    for i, a in enumerate(pool):
        scores = jaro_winkler_values([a] * i, pool[:i])
        for b in np.flatnonzero(scores >= threshold):
            found += 1
            assert keys[a] & keys[pool[b]], (a, pool[b])
    assert found or threshold == 1.0


@pytest.mark.parametrize("most", [0, 1, 2, 5])
def test_edit_pairs(spark, most):
    from polynym.functions.similarity import levenshtein_within

    rnd = random.Random(most)
    pool = strings(rnd, 150, "abcde", 16)
    df = spark.createDataFrame([(s,) for s in pool], "t string")
    a, b = df.toDF("a"), df.toDF("b")
    want = {(r.a, r.b): r.d for r in a.crossJoin(b).withColumn("d", levenshtein_within(a.a, b.b, most)).where("d is not null").collect()}
    assert {(r.t, r.other): r.d for r in J.edit_pairs(df, "t", most).collect()} == want
    some = set(pool[::3])
    assert {(r.t, r.other): r.d for r in J.edit_pairs(df, "t", most, df.where(df.t.isin(list(some)))).collect()} == {k: d for k, d in want.items() if k[0] in some}


def test_edit_keys_prune():
    """Random strings of like length hardly ever meet."""
    rnd = random.Random(1)
    pool = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)) for _ in range(300)]
    made = [J.edit_keys(s, 3) for s in pool]
    assert sum(bool(set(o) & set(k)) for i, (o, _) in enumerate(made) for j, (_, k) in enumerate(made) if i != j) < 100
