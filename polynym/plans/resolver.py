"""Resolution of entity records to clusters."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from polynym.functions.lexicon import LexiconSource
from polynym.functions.text import default_id
from polynym.operators.cascade import Cascade
from polynym.operators.cluster import collect_clusters, label_components
from polynym.operators.dense import Model
from polynym.operators.matchers import Matcher
from polynym.operators.materialize import materialize
from polynym.sources.entities import read_entities
from polynym.sources.sinks import write_clusters


class Resolver:
    """Entity records (idx, id, name, lang, entity_type) to clusters."""

    def __init__(self, tier2: float = 0.85, tier3: float = 0.82, tier4: float = 0.75, full_readings: bool = True, verbose: bool = False, backend: str = "ngram", model: Model | None = None, more: tuple[Matcher, ...] = (), words: dict[str, str] | LexiconSource | None = None):
        self.cascade = Cascade(tier2, tier3, tier4, backend, full_readings, words or {}, model, more)
        self.verbose = verbose
        self._seen: dict[int, Observation] = {}

    def keyed(self, records: DataFrame) -> DataFrame:
        """Distinct (name, lang, entity_type) with ``kid``, their smallest idx, and derived columns."""
        parts = {c: F.coalesce(c, F.lit("")) for c in ("name", "lang", "entity_type")}
        keys = records.select("idx", *(v.alias(c) for c, v in parts.items())).groupBy("name", "lang", "entity_type").agg(F.min("idx").alias("kid"))
        return materialize(self.cascade.derive(keys), "derived")

    def label(self, records: DataFrame) -> DataFrame:
        """``(idx, id, cluster_id)`` of every record; cluster_id is the smallest idx of the cluster.

        Equal names, languages and types are resolved once and expanded as a
        star. Records without a name match nothing, not even each other.
        """
        parts = [F.coalesce(c, F.lit("")).alias(f"_{c}") for c in ("name", "lang", "entity_type")]
        keys = self.keyed(records)
        self._seen = {}
        links = materialize(self.cascade.links(keys, self._seen), "links")
        if self.verbose:
            found = self.counters.values()
            print(f"Resolved in {sum(c for c, _ in found)} comparisons → {sum(m for _, m in found)} matches")
        roots = label_components(keys.where("norm <> ''").select(F.col("kid").alias("idx"), F.col("name").alias("_name"), F.col("lang").alias("_lang"), F.col("entity_type").alias("_entity_type")), links)
        roots = roots.select("_name", "_lang", "_entity_type", "cluster_id")
        rows = records.select("idx", default_id(F.col("id"), F.col("idx")).alias("id"), *parts)
        return rows.join(roots, ["_name", "_lang", "_entity_type"], "left").select("idx", "id", F.coalesce("cluster_id", "idx").alias("cluster_id"))

    @property
    def counters(self) -> dict[int, tuple[int, int]]:
        """Of the last ``label``, by tier: pairs of distinct names that it compared, and those that it matched.

        They are counted on the way, by the job that computes the links.
        """
        return {tier: (o.get["comparisons"], o.get["matches"]) for tier, o in sorted(self._seen.items())}

    def resolve(self, records: DataFrame) -> DataFrame:
        """``(cluster_id, members)``, one row for each cluster, singletons too."""
        return collect_clusters(self.label(records))

    def resolve_jsonl(self, spark: SparkSession, path: str) -> DataFrame:
        return self.resolve(read_entities(spark, path))

    def resolve_and_save(self, spark: SparkSession, source: str | Path, target: str | Path) -> int:
        """Clusters of a JSONL file as one JSON document; returns their number."""
        return write_clusters(self.resolve_jsonl(spark, str(source)), target)

    def clusters(self, records: DataFrame) -> list[list[str]]:
        """Clusters as lists, for small inputs: members in input order, clusters by first member."""
        return [r.members for r in self.resolve(records).orderBy("cluster_id").collect()]
