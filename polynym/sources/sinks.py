"""Sinks for clusters, records and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polynym.sources.schema import TYPE_BUCKETS


def write_clusters(clusters: DataFrame, path: str | Path) -> int:
    """``{"clusters": [[id]], "count": n}`` in one document, in the order of first members.

    Rows are streamed to the file one by one, so the driver holds one partition
    at a time. For large results write the labelled rows with ``write_labels``.
    """
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with target.open("w", encoding="utf-8") as out:
        out.write('{\n  "clusters": [')
        for row in clusters.orderBy("cluster_id").toLocalIterator():
            members = json.dumps(list(row.members), indent=2).replace("\n", "\n    ")
            out.write(("," if n else "") + "\n    " + members)
            n += 1
        out.write(("\n  " if n else "") + f'],\n  "count": {n}\n}}')
    return n


def write_labels(labelled: DataFrame, path: str) -> None:
    labelled.write.mode("overwrite").json(path)


def write_entities(records: DataFrame, path: str) -> None:
    """JSON lines in input order, all characters as they are; null fields are left out."""
    records.orderBy("idx").drop("idx").write.mode("overwrite").json(path)


def write_sitelinks(pairs: DataFrame, path: str) -> None:
    """JSON lines in a folder for each ``lang_pair``, buckets in extraction order, and in a bucket by ``rn`` if there is one."""
    order = F.create_map(*(x for i, (_, b) in enumerate(TYPE_BUCKETS) for x in (F.lit(b), F.lit(i))))
    rank = ["rn"] if "rn" in pairs.columns else []
    pairs.orderBy("lang_pair", F.element_at(order, F.col("bucket")), *rank).write.mode("overwrite").partitionBy("lang_pair").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


# Fixed value: the heading of the text report.
HEADING = "Cross-Lingual Entity Resolution — Language Pair Report"


def language_summary(report: DataFrame) -> list[str]:
    """The text form of a language report: pairs in order, the overall line last. One short line per pair."""
    line = F.format_string("  %-12s  P=%.3f  R=%.3f  F1=%.3f", "pair", "precision", "recall", "f1")
    rows = report.select("pair", line.alias("line")).orderBy("pair").collect()
    pairs = [r.line for r in rows if r.pair != "overall"]
    overall = [x for r in rows if r.pair == "overall" for x in ("-" * 55, r.line)]
    return [HEADING, "=" * 55, *pairs, *overall]


def print_table(report: DataFrame, *order: str, rows: int = 200) -> None:
    """The first ``rows`` rows of a report on the console; reports have a row for each bucket, tier or threshold."""
    (report.orderBy(*order) if order else report).show(rows, truncate=False)
