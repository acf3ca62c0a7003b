"""Encoders, joins of vectors, matchers as tiers, and counters."""

import random
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pytest
from pyspark.sql import functions as F

from polynym.functions.similarity import char_ngrams
from polynym.operators import dense
from polynym.operators.cascade import Cascade
from polynym.operators.matchers import EmbeddingMatcher, Matcher
from polynym.plans.resolver import Resolver
from polynym.sources.entities import entities_from_rows

LETTERS = "abcdefghijklmnopqrstuvwxyz "


def letter_vector(name):
    return [float(name.lower().count(c)) for c in LETTERS]


def fake(folder):
    """An encoder that notes when it is loaded and what it encodes."""

    def load():
        import os
        import uuid

        (folder / f"load-{os.getpid()}-{uuid.uuid4().hex}").touch()

        def run(names):
            (folder / f"call-{uuid.uuid4().hex}").write_text("\n".join(names))
            return np.array([letter_vector(n) for n in names])

        return run

    return dense.Model(str(folder), load, batch=4)


def noted(folder):
    loads = [p.name.split("-")[1] for p in folder.glob("load-*")]
    calls = [p.read_text().split("\n") for p in folder.glob("call-*")]
    return loads, calls


NAMES = ["listen to me", "me to silent", "silent to me", "другое имя", "red stone", "stone red", "no such thing", "elinst ot me", ""]


def records(spark, names):
    return entities_from_rows(spark, [{"id": str(i), "name": n, "lang": "en", "entity_type": None} for i, n in enumerate(names)]).repartition(4)


def test_model_encodes_each_name_once(spark, tmp_path):
    names = NAMES * 5
    model = fake(tmp_path)
    got = Resolver(0.99, 0.99, 0.95, backend="model", model=model).clusters(records(spark, names))
    loads, calls = noted(tmp_path)
    assert len(loads) == len(set(loads)), "loaded once in each worker"
    assert sorted(n for c in calls for n in c) == sorted({n for n in NAMES if n}) and max(map(len, calls)) <= 4
    # As with a column of the same vectors.
    keys = Cascade(0.99, 0.99, 0.95, "vector").derive(records(spark, NAMES).withColumnRenamed("idx", "kid"))
    vectors = spark.createDataFrame([(n, letter_vector(n)) for n in NAMES], "name string, vector array<double>")
    links = {(r.src, r.dst) for r in Cascade(0.99, 0.99, 0.95, "vector").links(keys.join(vectors, "name")).collect()}
    assert links == {(0, 1), (0, 2), (0, 7), (1, 2), (1, 7), (2, 7), (4, 5)}
    assert [len(c) for c in got] == [20, 5, 10, 5, 1, 1, 1, 1, 1]


def test_model_on_pairs(spark, tmp_path):
    pairs = spark.createDataFrame([("red stone", "stone red"), ("red stone", "blue"), (None, "x"), ("", "")], "name_a string, name_b string").withColumns({c: F.lit("") for c in ("lang_a", "lang_b", "type_a", "type_b")})
    cascade = Cascade(0.99, 0.99, 0.95, "model", model=fake(tmp_path))
    got = {(r.name_a, r.name_b): (r.is_match, r.tier, r.details.get("backend")) for r in cascade.match_pairs(pairs).collect()}
    assert got == {("red stone", "stone red"): (True, 4, "model"), ("red stone", "blue"): (False, 4, "model"), (None, "x"): (False, 0, None), ("", ""): (False, 0, None)}
    assert sorted(n for c in noted(tmp_path)[1] for n in c) == ["", "blue", "red stone", "stone red", "x"]
    matched = EmbeddingMatcher(0.95, backend="model", model=fake(tmp_path)).match(pairs.limit(1))
    assert matched.first().is_match and "vector_a" not in matched.columns
    with pytest.raises(ValueError, match="backend"):
        Cascade(backend="model")


def vectors(spark, m):
    return spark.createDataFrame([(i, "", v.tolist()) for i, v in enumerate(m)], "kid long, etype string, vector array<double>")


def near(m, threshold):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= threshold, 1))
    return set(zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.95])
def test_vector_join_loses_nothing(spark, threshold):
    rnd = np.random.default_rng(int(threshold * 100))
    base = rnd.normal(size=(250, 24))
    m = np.concatenate([base, base + rnd.normal(size=base.shape) * rnd.uniform(0.05, 1, size=(250, 1))])
    rows = vectors(spark, m).union(spark.createDataFrame([(1000, "", [0.0] * 24), (1001, "", None), (1002, "", [1.0]), (1003, "", [2.0]), (1004, "", [])], "kid long, etype string, vector array<double>"))
    want = near(m, threshold)
    assert len(want) > 50
    assert {(r.src, r.dst) for r in Cascade(tier4=threshold, backend="vector").last_links(rows).collect()} == want | {(1002, 1003)}


def test_pairs_compared_grow_about_linearly(spark):
    """On the given vectors, at 0.95: four times the vectors, far fewer than sixteen times the pairs, and a small share of all."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding is not null")
    counts = []
    for n in (500, 2000):
        rows = given.orderBy("vec_id").limit(n).select(F.col("vec_id").alias("kid"), F.lit("").alias("etype"), F.col("embedding").alias("vector"))
        keyed = dense.keyed_by_angle(rows, 0.95)
        counts.append(Cascade.typed_pairs(keyed.select("kid", "etype", "token"), ["token"]).count())
    assert counts[1] < 8 * counts[0]
    assert counts[1] < 0.05 * 2000 * 1999 / 2


def test_tables():
    assert dense.tables(10**9, 0.95)[0] > dense.tables(10**4, 0.95)[0]
    assert dense.tables(3, 0.95) is None
    work = [(lambda b, t: t * (1 + n / 2**b))(*dense.tables(n, 0.95)) for n in (10**5, 10**6, 10**7)]
    assert work[2] / work[1] < 2 and work[1] / work[0] < 2, "work for each vector"


@dataclass(frozen=True)
class Initials(Matcher):
    """Names of the same first letters of words."""

    threshold: float = 1.0
    method: ClassVar[str] = "Initials"

    @staticmethod
    def initials(name):
        return F.array_join(F.transform(F.split(F.lower(name), " "), lambda w: F.substring(w, 1, 1)), "")

    def score(self, pairs):
        return (self.initials(F.col("name_a")) == self.initials(F.col("name_b"))).cast("double")

    def candidates(self, keys):
        short = keys.select("kid", self.initials(F.col("name")).alias("i"))
        return short.withColumnRenamed("kid", "src").join(short.withColumnRenamed("kid", "dst"), "i")


def test_matcher_as_fifth_tier(spark):
    names = ["John Quincy Adams", "J Q A", "Jasper Quentin Albright", "Mary Moe", "mary moe", "Zed"]
    cascade = Cascade(more=(Initials(),))
    keys = cascade.derive(records(spark, names).withColumnRenamed("idx", "kid"))
    assert {(r.src, r.dst): r.tier for r in cascade.links(keys).collect()} == {(0, 1): 5, (0, 2): 5, (1, 2): 5, (3, 4): 0}
    assert [sorted(map(int, c)) for c in Resolver(more=(Initials(),)).clusters(records(spark, names))] == [[0, 1, 2], [3, 4], [5]]
    typed = cascade.derive(records(spark, names).withColumnRenamed("idx", "kid").withColumn("entity_type", F.col("id")))
    assert cascade.links(typed).count() == 0
    pairs = spark.createDataFrame([("John Q", "jon quill"), ("John Q", "Zed"), ("Ann", "Ann"), ("A", "")], "name_a string, name_b string").withColumns({c: F.lit("") for c in ("lang_a", "lang_b", "type_a", "type_b")})
    got = {r.name_b: (r.is_match, r.tier, r.method, r.score) for r in Cascade(0.99, more=(Initials(),)).match_pairs(pairs).collect()}
    assert got == {"jon quill": (True, 5, "Initials", 1.0), "Zed": (False, 5, "Initials", 0.0), "Ann": (True, 0, "Cascade/exact", 1.0), "": (False, 0, "Cascade/empty", 0.0)}
    with pytest.raises(NotImplementedError):
        Cascade(more=(EmbeddingMatcher(),)).links(keys)


def test_counters(spark, capsys):
    rnd = random.Random(3)
    names = ["".join(rnd.choice("abc ") for _ in range(9)) for _ in range(40)] + ["Same Name", "same  name", "Same Name"]
    r = Resolver(verbose=True)
    assert r.counters == {}
    r.label(records(spark, names))
    seen = r.counters
    assert set(seen) == {0, 2, 3, 4} and seen[0] == (1, 1)
    keys = r.cascade.derive(spark.createDataFrame([(i, n, "en", "") for i, n in enumerate(sorted(set(names)))], "kid long, name string, lang string, entity_type string"))
    for tier, form, threshold in ((2, "norm", 0.85), (3, "latin", 0.82)):
        scored = r.cascade.fuzzy_scores(keys.where("norm <> ''"), form, threshold, tier)
        assert seen[tier] == (scored.count(), scored.where(F.col("score") >= threshold).count())
    assert "comparisons" in capsys.readouterr().out
    r.label(records(spark, names).where("false"))
    assert all(v == (0, 0) for v in r.counters.values())


def test_trigrams_as_vectors_give_the_trigram_tier(spark):
    """The same names by both backends: trigram counts as vectors join as trigrams do."""
    rnd = random.Random(8)
    names = sorted({"".join(rnd.choice("abcd ") for _ in range(rnd.randint(3, 12))).strip() or "a" for _ in range(60)})
    keys = Cascade().derive(spark.createDataFrame([(i, n, "en", "") for i, n in enumerate(names)], "kid long, name string, lang string, entity_type string"))
    grams = sorted({r.g for r in keys.select(F.explode(char_ngrams(F.lower("name"))).alias("g")).collect()})
    counts = F.transform(F.array(*map(F.lit, grams)), lambda g: F.size(F.filter(char_ngrams(F.lower("name")), lambda x: x == g)).cast("double"))
    a = {(r.src, r.dst) for r in Cascade(tier4=0.5).last_links(keys).collect()}
    assert a == {(r.src, r.dst) for r in Cascade(tier4=0.5, backend="vector").last_links(keys.withColumn("vector", counts)).collect()} and a
