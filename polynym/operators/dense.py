"""Vectors of names: encoded by a model, joined by cosine."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polynym.operators.materialize import materialize

Encoder = Callable[[list[str]], "np.ndarray | list[list[float]]"]
#: A pair at the threshold is missed with this chance at most, one above it with less.
MISS = 1e-9
SEED = 42
#: Rows that are projected at once.
ROWS = 1024


@dataclass(frozen=True)
class Model:
    """How names become vectors: ``load`` gives the encoder, from lists of names to rows of numbers.

    ``load`` has to be picklable; it is called once in each Python worker, which
    keeps the encoder under ``key`` for all its tasks. Weights are read by
    ``load`` from where the executors find them.
    """

    key: str
    load: Callable[[], Encoder]
    batch: int = 64


_LOADED: dict[str, Encoder] = {}


def loaded(model: Model) -> Encoder:
    if model.key not in _LOADED:
        _LOADED[model.key] = model.load()
    return _LOADED[model.key]


def encode(names: DataFrame, model: Model) -> DataFrame:
    """``(name, vector)``: every distinct ``name`` encoded once, ``model.batch`` at a time; null has no row. Written to the shared folder."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = loaded(model)
        for b in batches:
            texts = b.tolist()
            parts = [np.asarray(encoder(texts[k : k + model.batch]), dtype=np.float64) for k in range(0, len(texts), model.batch)]
            yield pd.Series([v for p in parts for v in p], dtype=object)

    distinct = materialize(names.where("name is not null").select("name").distinct(), "names")
    return materialize(distinct.select("name", run("name").alias("vector")), "encoded")


# -- join ----------------------------------------------------------------------------


def tables(n: int, threshold: float, miss: float = MISS) -> tuple[int, int] | None:
    """(bits, tables) for ``n`` vectors, by the least expected work; None where comparing all pairs is less.

    Two vectors lie on one side of a random hyperplane with a chance of 1 - angle / pi.
    Pairs at the threshold have to share all bits of one table at least, unless
    in one of ``1 / miss`` cases; the more vectors, the more bits keep unlike ones
    apart. So the pairs compared grow as n to a power of 1.2 at a cosine of 0.95
    and of 1.4 at 0.75.
    """
    chance = 1 - math.acos(min(1.0, threshold)) / math.pi
    best = None
    for bits in range(2, 49):
        found = chance**bits
        count = 3 if found >= 1 else max(3, math.ceil(math.log(miss) / math.log1p(-found)))
        work = count * (1 + n / 2**bits)
        if count < 1 << 14 and (best is None or work < best[0]):
            best = work, bits, count
    return None if best is None or best[0] >= n else best[1:]


@functools.lru_cache(maxsize=8)
def planes(dim: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, number))


def keyed_by_angle(rows: DataFrame, threshold: float, seed: int = SEED, miss: float = MISS) -> DataFrame:
    """``rows`` (with ``vector``) and a ``token`` for each key; two vectors of one length whose cosine is ``threshold`` or more share one.

    Vectors that are null, zero or not finite have no token, as they are like nothing.
    """
    chosen = tables(rows.count(), threshold, miss)
    if chosen is None:
        return rows.withColumn("token", F.size("vector").cast("long")).where("token > 0")
    bits, count = chosen

    @F.pandas_udf("array<bigint>")
    def keys(vectors: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(vectors)
        groups: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            if v is not None:
                groups.setdefault(len(v), []).append(i)
        weights = 1 << np.arange(bits, dtype=np.int64)
        for dim, members in groups.items():
            normals = planes(dim, bits * count, seed)
            for k in range(0, len(members), ROWS):
                part = members[k : k + ROWS]
                m = np.array([vectors[i] for i in part], dtype=np.float64)
                sides = ((m @ normals) > 0).reshape(len(part), count, bits)
                made = sides @ weights + (np.arange(count, dtype=np.int64) << bits)
                for i, row, fine in zip(part, made, np.isfinite(m).all(axis=1) & m.any(axis=1), strict=True):
                    out[i] = row if fine else None
        return pd.Series(out, dtype=object)

    return rows.withColumn("token", F.explode(keys(F.col("vector").cast("array<double>"))))
