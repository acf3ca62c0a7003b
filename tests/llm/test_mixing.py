import math
from collections import Counter

import duckdb
import pytest

from polynym.llm import mixing

W = {"a": 1.0, "b": 3.0}


def docs(spark):
    rows = [(i, f"text {i}", "a" if i % 10 else "b", 7) for i in range(3000)] + [(None, None, None, 1), (None, None, None, 1), (5, "x" * 100_000, "c", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")


def test_counts_invert_poisson_and_match_sql(spark, tmp_path):
    df = docs(spark)
    df.write.parquet(str(tmp_path / "d"))
    got = mixing.poisson_mix(df, W, 0.5, 1.0, 42)
    assert got.columns == ["doc_id", "text", "source", "copy"]
    con = duckdb.connect()
    con.execute(f"create view documents as select * exclude copy from '{tmp_path}/d/*.parquet'")
    want = con.sql(mixing.oracle(W, 0.5, 1.0, 42, "doc_id, text, source")).fetchall()
    rows = [tuple(r) for r in got.collect()]
    # the sql needs means up to LARGEST_MEAN; source c and the null source have 1 and 2 rows and larger means
    small = lambda x: Counter(r for r in x if r[2] in ("a", "b"))
    assert small(rows) == small(want)
    means = {r.mix_source: r.mean for r in mixing.rates(df, W, 0.5).collect()}
    assert math.isclose(sum(means[s] * n for s, n in (("a", 2700), ("b", 300), ("c", 1), ("", 2))), 3003)
    n = Counter(r[2] for r in rows)
    for s, size in (("a", 2700), ("b", 300), ("c", 1), (None, 2)):
        mean = means[s or ""] * size
        assert abs(n[s] - mean) < 6 * math.sqrt(mean * (2 if s is None else 1)), s
    assert Counter(rows) == Counter(tuple(r) for r in mixing.poisson_mix(df.repartition(7), W, 0.5, 1.0, 42).collect())


def test_edges(spark):
    df = docs(spark)
    assert mixing.poisson_mix(df.where("false"), W).count() == 0
    assert mixing.poisson_mix(df, {"a": 0.0}).where("source = 'a'").count() == 0
    with pytest.raises(ValueError):
        mixing.poisson_mix(df, {"a": -1.0})


def test_clashing_columns(spark):
    df = docs(spark)
    more = df.selectExpr("*", *(f"'own' AS {c}" for c in ("mix_source", "mix_id", "mix_text", "row", "id", "digest", "parts", "cdf", "u", "times", "order", "n", "mean")))
    got = mixing.poisson_mix(more, W, 0.5)
    assert got.columns == [*(c for c in more.columns if c != "copy"), "copy"]
    assert {(r.mix_source, r.order, r.u) for r in got.collect()} == {("own", "own", "own")}
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in mixing.poisson_mix(df, W, 0.5).collect())
