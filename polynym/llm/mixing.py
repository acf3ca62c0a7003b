"""Mixing sources to target weights by Poisson replication; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Source tables up to this size are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Above this mean, a count is the sum of several inverted Poisson draws.
LARGEST_MEAN = 64.0


def _uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts: 52 bits."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _cumulative(mean: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2, ... until all but rounding is covered."""
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int"))
    zero = F.exp(-mean)
    start = F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("all"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(steps, start, add, lambda acc: acc["all"])


def rates(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, epochs: float = 1.0) -> DataFrame:
    """``(mix_source, n, mean)``: each source's rows and the mean number of times each is repeated.

    The mixture has ``epochs`` times the rows of ``docs`` on average, shared out
    by weight among the sources present. Weights are not negative.
    """
    if min([default_weight, *weights.values()]) < 0:
        raise ValueError("a weight is negative")
    name = F.coalesce(F.col("source").cast("string"), F.lit(""))
    weight = F.lit(float(default_weight))
    for source, w in sorted(weights.items()):
        weight = F.when(F.col("mix_source") == source, F.lit(float(w))).otherwise(weight)
    found = docs.groupBy(name.alias("mix_source")).agg(F.count("*").alias("n")).withColumn("weight", weight)
    rows, total = found.agg(F.sum("n"), F.sum("weight")).first()
    share = F.lit(float(epochs) * (rows or 0) / total) if total else F.lit(0.0)
    return found.select("mix_source", "n", (share * F.col("weight") / F.col("n")).alias("mean"))


def poisson_mix(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, and ``copy`` (1, 2, ...), shuffled globally.

    A row's count inverts the Poisson distribution with its source's mean at a
    uniform number hashed from seed, ``doc_id`` and text, so it does not depend
    on partitions, and a lost task gives the same rows again. A null source counts
    as the empty one; null ids and texts hash as empty strings; repeated rows get
    equal counts; an empty table gives an empty one. A column named ``copy`` of
    the input is replaced; others, whatever their names, stay as they were. Rows are dealt to partitions and ordered in them
    by a hash, so no source, however large, meets in one task.
    """
    found = rates(docs, weights, default_weight, epochs)
    parts = F.greatest(F.lit(1), F.ceil(F.col("mean") / LARGEST_MEAN)).cast("int")
    table = found.select("mix_source", parts.alias("parts"), _cumulative(F.col("mean") / parts).alias("cdf"))
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    # The input's row stays in one column, so that its names can't clash with those made here.
    columns = [c for c in docs.columns if c != "copy"]
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text.alias("digest"))
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: F.size(F.filter("cdf", lambda c: c <= _uniform(seed, j.cast("string"), F.col("id"), F.col("digest")))))
    one = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    counted = keyed.join(table, "mix_source").withColumn("u", _uniform(seed, F.lit("1"), F.col("id"), F.col("digest")))
    counted = counted.withColumn("times", F.when(F.col("parts") == 1, one).otherwise(F.aggregate(draws, F.lit(0), lambda a, x: a + x)))
    copies = counted.where("times > 0").select("row", "id", "digest", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    dealt = copies.select("row", "copy", F.xxhash64(F.lit(seed), "id", "digest", "copy").alias("order")).repartition("order").sortWithinPartitions("order")
    return dealt.select(*(F.col("row")[c].alias(c) for c in columns), F.col("copy").cast("int").alias("copy"))


def oracle(weights: dict[str, float], default_weight: float, epochs: float, seed: int, columns: str, table: str = "documents") -> str:
    """DuckDB SQL for the same rows, for means up to ``LARGEST_MEAN``."""
    weight = "CASE mix_source " + " ".join(f"WHEN '{s}' THEN CAST({w!r} AS DOUBLE)" for s, w in sorted(weights.items())) + f" ELSE CAST({default_weight!r} AS DOUBLE) END" if weights else f"CAST({default_weight!r} AS DOUBLE)"
    return f"""
WITH sizes AS (
  SELECT coalesce(source, '') AS mix_source, count(*) AS n FROM {table} GROUP BY 1),
weighed AS (SELECT mix_source, n, {weight} AS weight FROM sizes),
means AS (
  SELECT mix_source, CAST({float(epochs)!r} AS DOUBLE) * (SELECT sum(n) FROM weighed) / (SELECT sum(weight) FROM weighed) * weight / n AS mean FROM weighed),
terms AS (
  SELECT mix_source, k, sum(CASE WHEN mean = 0 THEN (k = 0)::INT ELSE exp(k * ln(mean) - mean - lgamma(k + 1)) END) OVER (PARTITION BY mix_source ORDER BY k) AS cdf
  FROM means, range(0, 200) AS r(k)),
drawn AS (
  SELECT d.*, coalesce(source, '') AS mix_source,
         ('0x' || substr(md5(concat_ws('|', '{seed}', '1', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM {table} d),
counted AS (
  SELECT d.*, (SELECT count(*) FROM terms t WHERE t.mix_source = d.mix_source AND t.cdf <= d.u) AS times FROM drawn d)
SELECT {columns}, CAST(c.copy AS INT) AS copy FROM counted, LATERAL (SELECT unnest(range(1, times + 1)) AS copy) c"""
