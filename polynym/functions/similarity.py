"""Similarity of names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler_value(a: str, b: str, always_boost: bool = False) -> float:
    """Jaro-Winkler of two strings; the prefix counts if Jaro is over 0.7, or with ``always_boost``."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(0, max(la, lb) // 2 - 1)
    used, left = [False] * lb, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    crossed = sum(x != y for x, y in zip(left, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / la + m / lb + (m - crossed) / m) / 3
    if jaro <= 0.7 and not always_boost:
        return jaro
    prefix = 0
    while prefix < min(4, la, lb) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


#: Cells (pairs times characters) that are compared at once.
CELLS = 1 << 18


def jaro_winkler_values(a: list[str], b: list[str], always_boost: bool = False) -> np.ndarray:
    """``jaro_winkler_value`` of many pairs: character by character, all pairs at once, those of like length together."""
    size = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], dtype=np.int64).reshape(-1, 2)
    longest = size.max(axis=1, initial=1)
    order = np.argsort(longest, kind="stable")
    out = np.zeros(len(a))
    at = 0
    while at < len(order):
        # As many pairs as fit with the length of the last of them.
        n = max(1, int(np.searchsorted(longest[order[at:]] * np.arange(1, len(order) - at + 1), CELLS, side="right")))
        rows = order[at : at + n]
        out[rows] = _jaro_winkler_block([a[i] for i in rows], [b[i] for i in rows], size[rows], always_boost)
        at += n
    return out


def _jaro_winkler_block(a: list[str], b: list[str], size: np.ndarray, always_boost: bool) -> np.ndarray:
    width = max(1, int(size.max()))
    x, y = (np.array(t, dtype=f"U{width}").view(np.uint32).reshape(len(t), width) for t in (a, b))
    la, lb = size[:, 0], size[:, 1]
    place, rows = np.arange(width), np.arange(len(a))
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    free = place < lb[:, None]
    left = np.zeros(x.shape, dtype=bool)
    for i in range(int(la.max())):
        fits = (y == x[:, i : i + 1]) & free & (np.abs(place - i) <= reach[:, None]) & (i < la)[:, None]
        first = fits.argmax(axis=1)
        hit = fits[rows, first]
        free[rows[hit], first[hit]] = False
        left[:, i] = hit
    right = (place < lb[:, None]) & ~free
    m = left.sum(axis=1)
    # The matched characters of each side, moved to the front in their order.
    p, q = (np.take_along_axis(t, np.argsort(~mask, axis=1, kind="stable"), axis=1) for t, mask in ((x, left), (y, right)))
    crossed = ((p != q) & (place < m[:, None])).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - crossed) / m) / 3, 0.0)
    k = min(4, width)
    alike = (x[:, :k] == y[:, :k]) & (place[:k] < np.minimum(la, lb)[:, None])
    prefix = np.minimum.accumulate(alike, axis=1).sum(axis=1)
    boosted = np.where((jaro > 0.7) | always_boost, jaro + 0.1 * prefix * (1 - jaro), jaro)
    same = (la == lb) & ((x == y) | (place >= la[:, None])).all(axis=1)
    return np.where(same, 1.0, np.where(m > 0, boosted, 0.0))


def jaro_winkler(a: Column, b: Column, always_boost: bool = False) -> Column:
    """Jaro-Winkler similarity; null if either is. Spark has none, so it runs in Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        out[known] = jaro_winkler_values(x[known].tolist(), y[known].tolist(), always_boost)
        return pd.Series(out, dtype="Float64").where(known)

    return run(a, b)


def least_jaro(threshold: float, prefix: Column | int) -> Column:
    """The Jaro similarity without which Jaro-Winkler can't reach the threshold."""
    p = prefix if isinstance(prefix, Column) else F.lit(prefix)
    if threshold <= 0.7:
        return F.lit(float(threshold)) + p * 0
    return F.greatest(F.lit(0.7), (threshold - 0.1 * p) / (1 - 0.1 * p))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, up to 4."""
    out = F.lit(0)
    for n in range(1, 5):
        out = F.when((F.length(a) >= n) & (F.length(b) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n)), n).otherwise(out)
    return out


def may_reach_jaro_winkler(a: Column, b: Column, threshold: float) -> Column:
    """A cheap test that never fails a pair of the threshold or more: lengths and prefix only."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (short / long + 2) / 3 >= least_jaro(threshold, common_prefix(a, b)) - 1e-9


def levenshtein_within(a: Column, b: Column, most: int) -> Column:
    """Edit distance, or null beyond ``most``; lengths are compared first."""
    d = F.levenshtein(a, b, most)
    return F.when((F.abs(F.length(a) - F.length(b)) <= most) & (d >= 0), d)


def char_ngrams(text: Column, n: int = 3) -> Column:
    """The ``n``-grams of ``#text#``, repeats included; empty if it is shorter than ``n``."""
    framed = F.concat(F.lit("#"), text, F.lit("#"))
    return F.when(F.length(framed) >= n, F.transform(F.sequence(F.lit(1), F.length(framed) - n + 1), lambda i: F.substr(framed, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays of one length in double precision; 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)
