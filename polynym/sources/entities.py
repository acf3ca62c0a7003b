"""Scans of entity records, labelled pairs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polynym.functions.text import id_from_uri
from polynym.operators.materialize import materialize
from polynym.sources.schema import ENTITY, SITELINK, TYPE_BUCKETS


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entity records of JSON lines with ``idx``, their order in the input.

    Blank lines are skipped, malformed ones fail. Numbers run over files in the
    order in which the scan reads them: partitions are counted, then numbered on
    from the ones before, so no row moves.
    """
    rows = spark.read.schema(ENTITY).option("mode", "FAILFAST").json(path)
    return number_rows(rows)


def number_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with ``idx`` 0, 1, 2, ... in the order of partitions and rows."""
    placed = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "rows")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.withColumns({"_part": part, "_row": at}).join(starts, "_part").select(*rows.columns, (F.col("_start") + F.col("_row")).cast("long").alias("idx"))


def entities_from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A table of given records, in their order."""
    fields = ("id", "name", "lang", "entity_type", "aliases")
    return spark.createDataFrame([(i, *(str(r[f]) if f == "id" and r.get(f) is not None else r.get(f) for f in fields)) for i, r in enumerate(rows)], f"idx long, {ENTITY}")


def read_sitelinks(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs of JSON lines; a ``lang_pair=`` folder becomes a column."""
    return spark.read.schema(SITELINK).option("mode", "FAILFAST").json(path)


def read_pair_folders(spark: SparkSession, root: str, name: str = "sitelinks.jsonl") -> DataFrame:
    """Pairs under ``root/xx_yy/name``, with ``l1`` and ``l2`` from the folder, split at the first underscore."""
    rows = spark.read.schema(SITELINK).option("mode", "FAILFAST").json(f"{root}/*/{name}")
    # The name may be a file's or that of a folder of parts.
    folder = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/\Q{name}\E(?:/|$)", 1)
    return rows.select("*", folder.alias("_folder")).select(*rows.columns, F.substring_index("_folder", "_", 1).alias("l1"), F.expr("substring(_folder, instr(_folder, '_') + 1)").alias("l2"))


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A JSON report, or None if there is none."""
    from pyspark.errors import AnalysisException

    reader = spark.read.option("multiLine", True)
    try:
        return (reader.schema(schema) if schema else reader).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def adapt_report(report: DataFrame) -> DataFrame:
    """A report in today's layout; the first report was written before it had a language pair, and is of English and Russian."""
    if {"language_pair", "t4_threshold_sweep"} <= set(report.columns):
        return report
    null = F.lit(None)
    # The pair and the number of rows of that report.
    n_pairs = F.coalesce(F.col("normalized.n_pairs"), F.lit(375)) if "normalized" in report.columns else F.lit(375)
    sweep, only = (F.col(c) if c in report.columns else null for c in ("t4_threshold_sweep", "t3_only_inspection"))
    return report.select(F.lit("en_ru").alias("language_pair"), n_pairs.cast("long").alias("n_pairs"), sweep.alias("t4_threshold_sweep"), only.alias("t3_only_inspection_at_default"))


def type_buckets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q, b) for i, (q, b) in enumerate(TYPE_BUCKETS)], "ord int, type string, bucket string")


#: First titles of an entity that meet its second titles in one task.
TITLES = 2048


def sitelink_pairs(sitelinks: DataFrame, types: DataFrame, labels: DataFrame, l1: str, l2: str) -> DataFrame:
    """The graph pattern as joins: entities with a title in both languages and a given type.

    ``sitelinks`` (entity, lang, title), ``types`` (entity, type), ``labels`` (type, label).
    """
    a, b = (sitelinks.where(F.col("lang") == lang).select("entity", F.col("title").alias(t)) for lang, t in ((l1, "l1_title"), (l2, "l2_title")))
    # Pairs of an entity's titles are as many as the product of their numbers, so all else is told before, and first titles are dealt out to tasks.
    facts = types.join(labels, "type", "left").select("entity", id_from_uri(F.col("entity")).alias("qid"), id_from_uri(F.col("type")).alias("wikidata_type"), F.coalesce("label", F.lit("")).alias("type_label"))
    shares = a.groupBy("entity").agg(F.ceil(F.count("*") / TITLES).cast("int").alias("_of"))
    parts = int(sitelinks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = a.join(facts, "entity").join(shares, "entity").withColumn("_part", F.pmod(F.xxhash64("l1_title"), F.col("_of")).cast("int")).drop("_of")
    right = b.join(shares, "entity").select("entity", "l2_title", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_part"))
    on = ["entity", "_part"]
    found = left.repartition(parts, *on).join(right.repartition(parts, *on).hint("merge"), on)
    return found.select("qid", "l1_title", "l2_title", "wikidata_type", "type_label")


def stratified(pairs: DataFrame, n_per_bucket: int, order: str = "qid") -> DataFrame:
    """At most ``n_per_bucket`` rows of each bucket, the first by ``order``: the extraction's own limit."""
    first = Window.partitionBy("bucket").orderBy(order)
    return pairs.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n_per_bucket).drop("_rn")


def label_map(labels: DataFrame) -> DataFrame:
    """``(qid, lang, label)`` rows to a map of labels for each qid."""
    return labels.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "label")))).alias("labels"))
