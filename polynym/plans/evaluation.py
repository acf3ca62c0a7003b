"""The evaluation of labelled title pairs of one language pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polynym.operators import metrics, negatives, reports
from polynym.operators.cascade import Cascade
from polynym.operators.materialize import materialize
from polynym.sources.entities import number_rows


def evaluate(pairs: DataFrame, l1: str, l2: str, cascade: Cascade | None = None) -> dict[str, DataFrame]:
    """All reports on ``pairs`` (qid, l1_title, l2_title, bucket); titles are scored once for all of them.

    ``sweep`` and ``outcomes`` are over the positives, ``hard`` and ``per_bucket``
    against the most similar title of the bucket, ``adversarial`` against titles
    within five edits.
    """
    cascade = cascade or Cascade()
    rows = materialize(number_rows(pairs), "pairs")
    kinds = {"hard": negatives.hard_negatives(rows), "adversarial": negatives.adversarial_negatives(rows).withColumnRenamed("bucket_positive", "bucket")}
    columns = ("idx", "l1_title", "l2_title", "bucket")
    labelled = rows.select(*columns, F.lit("positive").alias("kind"))
    for kind, found in kinds.items():
        labelled = labelled.unionByName(found.select(*columns, F.lit(kind).alias("kind")))
    labelled = materialize(labelled, "labelled")
    titles = labelled.select("l1_title", "l2_title").distinct()
    scored = labelled.join(materialize(reports.score_pairs(titles, cascade, l1, l2), "scores"), ["l1_title", "l2_title"]).withColumn("positive", F.col("kind") == "positive")
    positive = scored.where("positive")
    against = lambda kind: scored.where(F.col("kind").isin("positive", kind))
    tiers = reports.tiers(cascade.tier4)
    per_bucket = metrics.confusion(against("hard"), tiers, ["bucket"])
    return {
        "sweep": reports.sweep(positive),
        "outcomes": reports.outcomes(positive, cascade.tier4, ["bucket"]),
        "phonetic_only": metrics.ranks_median(reports.phonetic_only(positive, cascade.tier4), "t4_score", ["bucket"]),
        "hard": metrics.confusion(against("hard"), tiers),
        "adversarial": metrics.confusion(against("adversarial"), tiers),
        "per_bucket": per_bucket,
        "winner": metrics.tier_winner(per_bucket.where("tier <> 'combined_ungated'"), ["bucket"]),
    }
