"""From links to clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polynym.operators.components import connected_components


def label_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (with ``idx``) and ``cluster_id``, the smallest idx reachable; links are (src, dst)."""
    reached = connected_components(links).select(F.col("node").alias("idx"), F.col("component").alias("cluster_id"))
    return nodes.join(reached, "idx", "left").withColumn("cluster_id", F.coalesce("cluster_id", "idx"))


def collect_clusters(labelled: DataFrame) -> DataFrame:
    """``(cluster_id, members)``: ids in input order; sort by cluster_id for the order of first members."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("idx", "id"))), lambda m: m["id"])
    return labelled.groupBy("cluster_id").agg(members.alias("members"))


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """``(size, clusters)``"""
    return labelled.groupBy("cluster_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def gold_clusters(records: DataFrame) -> DataFrame:
    """``(id, members)``: each id's (name, lang) in input order."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("idx", "name", "lang"))), lambda m: F.struct(m["name"].alias("name"), m["lang"].alias("lang")))
    return records.groupBy("id").agg(members.alias("members"))
