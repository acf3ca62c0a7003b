"""Matchers of given pairs (name_a, name_b, lang_a, lang_b): a score and a threshold.

A new matcher is a subclass with ``score``; it is used like the two here. With
``candidates`` it can be a tier of its own: ``Cascade(more=(MyMatcher(),))``.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polynym.functions.similarity import jaro_winkler
from polynym.functions.text import normalize_for_matching
from polynym.functions.translit import transliterate_to_latin
from polynym.operators.cascade import Cascade
from polynym.operators.dense import Model


@dataclass(frozen=True)
class Matcher(ABC):
    threshold: float = 0.75
    tier: int | None = None
    method: ClassVar[str] = "Matcher"

    @abstractmethod
    def score(self, pairs: DataFrame) -> Column:
        """The similarity of each pair, between 0 and 1."""

    def candidates(self, keys: DataFrame) -> DataFrame:
        """``(src, dst)`` among keys (kid, name, norm, script, latin, lang, etype): pairs that hold all that the matcher would match."""
        raise NotImplementedError(f"{type(self).__name__} has no candidates, so it can't be a tier")

    def number(self, otherwise: int) -> int:
        """The tier's number."""
        return otherwise if self.tier is None else self.tier

    def match(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with is_match, score, tier and method."""
        scored = pairs.withColumn("score", self.score(pairs))
        return scored.select(*pairs.columns, (F.col("score") >= self.threshold).alias("is_match"), "score", F.lit(self.tier).cast("int").alias("tier"), F.lit(self.method).alias("method"))


@dataclass(frozen=True)
class PhoneticMatcher(Matcher):
    """Jaro-Winkler of the Latin forms; 0 if either is empty."""

    threshold: float = 0.82
    tier: int | None = 3
    full_readings: bool = True
    method: ClassVar[str] = "PhoneticMatcher"

    def latin(self, pairs: DataFrame, side: str) -> Column:
        name, lang = F.coalesce(f"name_{side}", F.lit("")), F.coalesce(f"lang_{side}", F.lit(""))
        return normalize_for_matching(transliterate_to_latin(name, lang, pairs.sparkSession, self.full_readings))

    def score(self, pairs: DataFrame) -> Column:
        a, b = self.latin(pairs, "a"), self.latin(pairs, "b")
        return F.when((a == "") | (b == ""), 0.0).otherwise(jaro_winkler(a, b))


@dataclass(frozen=True)
class EmbeddingMatcher(Matcher):
    """Cosine of character trigrams, of the columns vector_a and vector_b, or of vectors that a model makes of the names."""

    tier: int | None = 4
    backend: str = "ngram"
    model: Model | None = field(default=None, hash=False)
    method: ClassVar[str] = "EmbeddingMatcher"

    def score(self, pairs: DataFrame) -> Column:
        return self.cascade.pair_cosine("name_a", "name_b")

    @property
    def cascade(self) -> Cascade:
        return Cascade(backend=self.backend, model=self.model)

    def match(self, pairs: DataFrame) -> DataFrame:
        if self.model is None:
            return super().match(pairs)
        found = super().match(self.cascade._encoded_pairs(pairs))
        return found.select(*pairs.columns, "is_match", "score", "tier", "method")
