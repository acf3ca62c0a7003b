"""A session with the settings the jobs are made for; on a cluster use the cluster's own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, cores: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("polynym").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    if cores:
        builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    return builder.getOrCreate()
