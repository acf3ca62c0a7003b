"""Analyses of scored pairs (l1, l2, bucket, t3_hit, t4_score, same_script, positive)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polynym.functions.script import detect_script
from polynym.functions.similarity import jaro_winkler
from polynym.functions.text import normalize_for_matching, normalize_title
from polynym.functions.translit import transliterate_to_latin
from polynym.operators.cascade import Cascade
from polynym.operators.materialize import materialize
from polynym.operators.metrics import ratio

THRESHOLDS = (0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9)


def score_pairs(pairs: DataFrame, cascade: Cascade, l1: str = "", l2: str = "") -> DataFrame:
    """``pairs`` (l1_title, l2_title, ...) with normalised titles, the phonetic hit, the last tier's score and scripts."""
    spark = pairs.sparkSession
    named = pairs.withColumns({"l1": normalize_title(F.coalesce("l1_title", F.lit(""))), "l2": normalize_title(F.coalesce("l2_title", F.lit("")))})
    for side, lang in (("l1", l1), ("l2", l2)):
        latin = transliterate_to_latin(F.col(side), F.lit(lang), spark, cascade.full_readings, cascade.words)
        named = named.withColumns({f"_{side}": normalize_for_matching(latin), f"_script_{side}": detect_script(F.col(side))})
    # Written, so that scores are planned in terms of columns: those of titles are large, and scores name them dozens of times.
    named = materialize(named, "title-forms")
    jw = F.when((F.col("_l1") == "") | (F.col("_l2") == ""), 0.0).otherwise(jaro_winkler(F.col("_l1"), F.col("_l2")))
    return named.select(*pairs.columns, "l1", "l2", (jw >= cascade.tier3).alias("t3_hit"), cascade.pair_cosine("l1", "l2").alias("t4_score"), (F.col("_script_l1") == F.col("_script_l2")).alias("same_script"))


def tiers(threshold: float = 0.75) -> dict[str, Column]:
    """The decisions of each tier, alone and combined, with and without the script gate."""
    t3, t4 = F.col("t3_hit"), F.col("t4_score") >= threshold
    return {"t3": t3, "t4": t4, "combined": (t3 & ~F.col("same_script")) | t4, "combined_ungated": t3 | t4}


def outcomes(scored: DataFrame, threshold: float | Column = 0.75, by: list[str] | None = None) -> DataFrame:
    """The four outcomes of two tiers, their recalls and what each adds to the other."""
    by = by or []
    t3, t4 = F.col("t3_hit"), F.col("t4_score") >= threshold
    counted = scored.groupBy(*by).agg(*(F.count_if(c).alias(n) for n, c in (("both", t3 & t4), ("t3_only", t3 & ~t4), ("t4_only", ~t3 & t4), ("neither", ~t3 & ~t4))))
    both, one, two, none = (F.col(c) for c in ("both", "t3_only", "t4_only", "neither"))
    n = both + one + two + none
    rates = {"t3_recall": one + both, "t4_recall": two + both, "combined_recall": n - none, "t3_marginal_over_t4": one, "t4_marginal_over_t3": two}
    return counted.select(*by, "both", "t3_only", "t4_only", "neither", *(ratio(v, n).alias(k) for k, v in rates.items()))


def sweep(scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """``outcomes`` at each threshold; scores are read once and each row is told off against the short list."""
    told = scored.select("t3_hit", "t4_score", F.explode(F.array(*map(F.lit, thresholds))).alias("t4_threshold"))
    return outcomes(told, F.col("t4_threshold"), ["t4_threshold"])


def phonetic_only(scored: DataFrame, threshold: float = 0.75) -> DataFrame:
    return scored.where(F.col("t3_hit") & (F.col("t4_score") < threshold))


def near_threshold(scored: DataFrame, threshold: float = 0.75, width: float = 0.05) -> DataFrame:
    return scored.agg(F.count_if(F.col("t3_hit") & (F.col("t4_score") >= threshold - width) & (F.col("t4_score") < threshold)).alias("near"))


def lowest(scored: DataFrame, n: int = 10, order: str = "idx") -> DataFrame:
    """The feature is the limit: the ``n`` lowest scores, earlier rows first among equals."""
    return scored.orderBy("t4_score", order).limit(n)


def missed_by_both(scored: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs no tier finds, with what their second title looks like."""
    rows = scored.where(~F.col("t3_hit") & (F.col("t4_score") < threshold))
    return rows.withColumns({"ascii": F.col("l2").rlike(r"^[\x00-\x7f]*$"), "has_latin": F.col("l2").rlike("[A-Za-z]"), "has_kana": F.col("l2").rlike(r"[\x{3040}-\x{30ff}]")})


def spacing_effect(pairs: DataFrame, a: str, standard: str, spaced: str, threshold: float = 0.82) -> DataFrame:
    """Recall of two spellings of one side against the other, what each adds, and how near the misses come."""
    s, t = (jaro_winkler(F.lower(F.col(a)), F.col(c)) for c in (standard, spaced))
    rows = pairs.select(s.alias("s"), t.alias("t"))
    hs, ht = F.col("s") >= threshold, F.col("t") >= threshold
    n = F.count("*")
    missed = ~hs & ~ht
    best = F.greatest("s", "t")
    return rows.agg(ratio(F.count_if(hs), n).alias("standard_recall"), ratio(F.count_if(ht), n).alias("spaced_recall"), F.count_if(ht & ~hs).alias("spaced_only"), F.count_if(hs & ~ht).alias("standard_only"), F.count_if(missed).alias("missed"), F.count_if(missed & (best >= 0.7)).alias("near"), F.count_if(missed & (best < 0.5)).alias("far"))


def transliteration_behaviour(pairs: DataFrame, title: str = "l2_title") -> DataFrame:
    """How many titles become empty, pass, or change."""
    latin = transliterate_to_latin(F.col(title), None, pairs.sparkSession)
    kind = F.when(F.trim(latin) == "", "empty").when(latin == F.col(title), "passthrough").otherwise("changed")
    return pairs.select(kind.alias("behaviour")).groupBy("behaviour").agg(F.count("*").alias("n"))


def decision(marginal: Column) -> Column:
    """What a marginal recall calls for."""
    return F.when(marginal >= 0.15, "PROCEED").when(marginal < 0.05, "REFRAME").otherwise("AMBIG")


def deltas(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``after - before`` of each value, by key."""
    a, b = before.alias("a"), after.alias("b")
    return a.join(b, key).select(key, *((F.col(f"b.{v}") - F.col(f"a.{v}")).alias(f"delta_{v}") for v in values))
