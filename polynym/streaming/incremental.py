"""Records that arrive in micro-batches are linked to all records so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polynym.plans.resolver import Resolver


def resolve_stream(store: str, resolver: Resolver | None = None) -> Callable:
    """A ``foreachBatch`` sink that appends each batch to ``store/records`` and rewrites ``store/labels-<batch>``.

    Batches have the columns idx, id, name, lang, entity_type, aliases. A
    batch that is delivered again overwrites its own folder, so results are the
    same after a restart.
    """
    resolver = resolver or Resolver()

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/records/batch={number}")
        so_far = spark.read.parquet(f"{store}/records").where(F.col("batch") <= number).drop("batch")
        resolver.label(so_far).write.mode("overwrite").parquet(f"{store}/labels-{number}")

    return sink
