"""Precision, recall and F1 of clusters and of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polynym.operators.materialize import materialize


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 if b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def _join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join where null equals null; of ``b`` only columns that ``a`` lacks are kept."""
    other = b.select(*(F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in b.columns))
    cond = F.lit(True)
    for c in on:
        cond &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(other, cond, how).drop(*(f"_{c}" for c in on))


def _choose_two(rows: DataFrame, by: list[str], cells: list[str], name: str) -> DataFrame:
    """``(*by, name)``: pairs of rows within the cells, from their sizes alone."""
    sizes = rows.groupBy(*by, *cells).agg(F.count("*").alias("_n"))
    return sizes.select(*by, F.expr("_n * (_n - 1) div 2").alias(name))


def pair_counts(predicted: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, tp, predicted, gold)``: pairs of ids that share a cluster, in both, in the predicted, in the gold.

    Pairs are counted, not listed: those within a cluster follow from its size,
    and those that both have from the sizes of the overlaps of their clusters.
    An id twice in a cluster pairs with itself, once. Only ids that are in
    several clusters of one side may share more than one with another id; pairs
    with such an id, whatever the other is, are listed and counted once.
    """
    sides = {n: materialize(d.groupBy(*by, "cluster", "id").agg(F.count("*").alias("times")), "members") for n, d in (("predicted", predicted), ("gold", gold))}
    several = [d.groupBy(*by, "id").agg(F.count("*").alias("_n")).where("_n > 1").select(*by, "id") for d in sides.values()]
    several = materialize(several[0].union(several[1]).distinct(), "several")
    plain = {n: _join(d, several, [*by, "id"], "left_anti") for n, d in sides.items()}
    own = {n: d.where("times > 1").select(*by, "id").distinct() for n, d in sides.items()}
    overlap = _join(plain["predicted"].select(*by, "id", F.col("cluster").alias("pc")), plain["gold"].select(*by, "id", F.col("cluster").alias("gc")), [*by, "id"])

    def listed(d: DataFrame) -> DataFrame:
        with_one = _join(d.select(*by, "cluster", "id"), several, [*by, "id"], "left_semi")
        pairs = _join(with_one.withColumnRenamed("id", "a"), d.select(*by, "cluster", F.col("id").alias("b")), [*by, "cluster"]).where("a <> b")
        return pairs.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    lists = {n: materialize(listed(d), "listed-pairs") for n, d in sides.items()}
    one = F.lit(1).cast("long")
    parts = [_choose_two(overlap, by, ["pc", "gc"], "tp"), _join(own["predicted"], own["gold"], [*by, "id"], "left_semi").select(*by, one.alias("tp")), _join(lists["predicted"], lists["gold"], [*by, "a", "b"], "left_semi").select(*by, one.alias("tp"))]
    for n in sides:
        parts += [_choose_two(plain[n], by, ["cluster"], n), own[n].select(*by, one.alias(n)), lists[n].select(*by, one.alias(n))]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p, allowMissingColumns=True)
    zero = F.lit(0).cast("long")
    return found.groupBy(*by).agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("tp", "predicted", "gold")))


def _prf(tp: Column, predicted: Column, gold: Column) -> list[Column]:
    """Of nothing against nothing all are 1."""
    none = (predicted == 0) & (gold == 0)
    p, r = ratio(tp, predicted), ratio(tp, gold)
    return [F.when(none, 1.0).otherwise(v).alias(n) for n, v in (("precision", p), ("recall", r), ("f1", f1(p, r)))]


def pairwise_prf(predicted: DataFrame, gold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pairwise precision, recall and F1 of clusters (*by, cluster, id); with ``by``, for each group of the gold."""
    by = by or []
    counts = pair_counts(predicted, gold, by)
    if by:  # groups that have a pair
        counts = counts.where("predicted + gold > 0")
    return counts.select(*by, *_prf(F.col("tp"), F.col("predicted"), F.col("gold")))


def cluster_prf(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Each predicted cluster (ord, id) is held against the gold cluster it overlaps most.

    Ties go to the first gold cluster, which may be taken by several. A cluster
    without overlap counts as false positives, an untaken gold cluster as false
    negatives.
    """
    p, g = predicted.select("ord", "id").distinct(), gold.select(F.col("ord").alias("gold"), "id").distinct()
    sizes = p.groupBy("ord").agg(F.count("*").alias("np"))
    gold_sizes = g.groupBy("gold").agg(F.count("*").alias("ng"))
    overlap = p.join(g, "id").groupBy("ord", "gold").agg(F.count("*").alias("both"))
    best = overlap.groupBy("ord").agg(F.max(F.struct("both", (-F.col("gold")).alias("first"))).alias("best")).select("ord", F.col("best.both").alias("both"), (-F.col("best.first")).alias("gold"))
    held = sizes.join(best, "ord", "left").join(gold_sizes, "gold", "left")
    zero = F.lit(0)
    from_predicted = held.select(F.coalesce("both", zero).alias("tp"), (F.col("np") - F.coalesce("both", zero)).alias("fp"), F.coalesce(F.col("ng") - F.col("both"), zero).alias("fn"))
    untaken = gold_sizes.join(best, "gold", "left_anti").select(zero.alias("tp"), zero.alias("fp"), F.col("ng").alias("fn"))
    total = from_predicted.union(untaken).agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("tp", "fp", "fn")))
    return total.select("tp", "fp", "fn", *_prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")))


def language_report(predicted: DataFrame, gold: DataFrame, records: DataFrame) -> DataFrame:
    """``(pair, precision, recall, f1)`` for each pair of languages in the gold, and ``overall``.

    A pair's clusters keep the members of either language, and both languages'
    own pairs count; clusters of fewer than two such members go. A pair the gold
    does not have is left out. An id's language is that of its last record.
    """
    lang = records.groupBy("id").agg(F.max_by("lang", "idx").alias("lang"))
    langs = records.where("lang is not null").select("lang").distinct()
    # Languages are few; each member is copied once for each pair that has its language.
    pairs = langs.select(F.col("lang").alias("la")).join(F.broadcast(langs.select(F.col("lang").alias("lb"))), F.col("la") <= F.col("lb"))
    wanted = pairs.select(F.concat_ws("-", "la", "lb").alias("pair"), F.explode(F.array_distinct(F.array("la", "lb"))).alias("lang"))

    def spread(clusters: DataFrame) -> DataFrame:
        placed = clusters.join(lang, "id").join(F.broadcast(wanted), "lang").select("pair", "cluster", "id")
        large = placed.groupBy("pair", "cluster").agg(F.count("*").alias("n")).where("n > 1").select("pair", "cluster")
        return placed.join(large, ["pair", "cluster"])

    g = spread(gold)
    found = pairwise_prf(spread(predicted), g, ["pair"]).join(g.select("pair").distinct(), "pair")
    return found.unionByName(pairwise_prf(predicted, gold).withColumn("pair", F.lit("overall")))


def confusion(scored: DataFrame, tiers: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """``(*by, tier, tp, fp, tn, fn, precision, recall, f1)`` of labelled rows; ``positive`` is the label."""
    by = by or []
    hits = F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), c.alias("hit")) for t, c in tiers.items())))
    rows = scored.select(*by, "positive", hits.alias("t")).select(*by, "positive", "t.tier", "t.hit")
    yes, pos = F.col("hit"), F.col("positive")
    counts = rows.groupBy(*by, "tier").agg(*(F.count_if(c).alias(n) for n, c in (("tp", pos & yes), ("fp", ~pos & yes), ("tn", ~pos & ~yes), ("fn", pos & ~yes))))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(*by, "tier", "tp", "fp", "tn", "fn", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def tier_winner(per_bucket: DataFrame, by: list[str]) -> DataFrame:
    """The tier with the highest F1; ties by precision, then by the tier's name."""
    return per_bucket.groupBy(*by).agg(F.max(F.struct("f1", "precision", "tier")).alias("best")).select(*by, F.col("best.tier").alias("winner"), F.col("best.f1").alias("f1"))


def heatmap(per_bucket: DataFrame, pairs: list[str], tier: str = "combined") -> DataFrame:
    """F1 of one tier: a row for each bucket, a column for each language pair."""
    return per_bucket.where(F.col("tier") == tier).groupBy("bucket").pivot("pair", pairs).agg(F.first("f1"))


def upper_median(values: Column) -> Column:
    """Of sorted values, the one at half their number, the upper one of two."""
    return F.get(F.sort_array(F.collect_list(values)), F.floor(F.count(values) / 2).cast("int"))


#: Ranges into which values are counted at once.
RANGES = 1024


def ranks_median(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``(*by, min, median, max)``: exact, the upper median; values are finite numbers, nulls are left out.

    Values are never sorted or gathered: those of a group are counted in ranges between its
    least and its largest, and only the range that holds the median is looked at
    again, in finer ranges, until one value is left.
    """
    v = materialize(rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")), "values")
    ends = materialize(v.groupBy(*by).agg(F.min("_v").alias("min"), F.max("_v").alias("max"), F.count("*").alias("_n")), "value-ends")
    state = ends.select(*by, F.col("min").alias("_lo"), F.col("max").alias("_hi"), (F.floor(F.col("_n") / 2) + 1).alias("_k"))
    medians = state.where("_lo = _hi").select(*by, F.col("_lo").alias("median"))
    while not (state := materialize(state.where("_lo < _hi"), "median-ranges")).isEmpty():
        inside = _join(v, state, by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        share = (F.col("_v").cast("double") - F.col("_lo").cast("double")) / (F.col("_hi").cast("double") - F.col("_lo").cast("double"))
        cell = F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).alias("_cell")
        counts = inside.select(*by, "_k", "_v", cell).groupBy(*by, "_k", "_cell").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        so_far = F.sum("_c").over(Window.partitionBy(*by).orderBy("_cell"))  # a row for each range
        told = counts.withColumn("_before", so_far - F.col("_c")).where((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_c") >= F.col("_k")))
        state = materialize(told.select(*by, "_lo", "_hi", (F.col("_k") - F.col("_before")).alias("_k")), "median-ranges")
        medians = medians.union(state.where("_lo = _hi").select(*by, F.col("_lo").alias("median")))
    return _join(ends.drop("_n"), medians, by).select(*by, "min", "median", "max")
