"""Joins of strings by similarity, without comparing all of them.

Each join gives pairs that hold every match (``candidates``); the score itself
decides afterwards.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache, reduce
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polynym.functions.similarity import levenshtein_within
from polynym.operators.materialize import materialize

#: Lengths are told apart by bands, each longer than the last by a fifth.
BAND = 1.2
#: Lengths up to this one are told apart one by one where only like lengths go together.
EXACT = 32
#: Kinds of pairs by the first letters that are the same: so many in the key, so many at most.
KINDS = ((0, 0), (1, 1), (2, 3), (4, 4))
#: Keys of a string for each kind, where two tokens a key don't make more.
KEYS = 100
#: Keys of a string within some edits for each other length, where two tokens a key don't make more.
EDIT_KEYS = 36
MASK = (1 << 64) - 1


def least_jaro_of(threshold: float, prefix: int) -> float:
    """The Jaro similarity without which Jaro-Winkler can't reach the threshold with a common prefix of that length or less."""
    return threshold if threshold <= 0.7 else max(0.7, (threshold - 0.1 * prefix) / (1 - 0.1 * prefix))


def band(n: int) -> int:
    return int(math.log(n) / math.log(BAND) + 1e-9)


def mixed(*parts: int) -> int:
    """A 64-bit key of some numbers; equal keys of different numbers only add pairs to look at."""
    h = 0x9E3779B97F4A7C15
    for p in parts:
        h = ((h ^ (p & MASK)) * 0xBF58476D1CE4E5B9) & MASK
        h ^= h >> 29
    return h - (1 << 64) if h >> 63 else h


def length_class(n: int, exact: bool) -> int:
    """Classes of lengths: of short strings the lengths themselves, if ``exact``, else bands."""
    return n if exact and n <= EXACT else EXACT + 1 + band(n)


def class_ends(c: int) -> tuple[int, int]:
    """The least and the largest length of a class."""
    return (c, c) if c <= EXACT else (math.ceil(BAND ** (c - EXACT - 1) - 1e-6), math.floor(BAND ** (c - EXACT) + 1e-6))


@lru_cache(maxsize=1 << 14)
def key_plan(n: int, threshold: float, lengths: frozenset[int] | None) -> list[tuple[int, list[tuple[int, int, np.ndarray]]]]:
    """For each kind of prefix and class of other lengths: a number for both classes, which of them is longer, and which tokens of a string of length n are put together."""
    out = []
    for kind, prefix in KINDS:
        if n < kind:
            continue
        j = least_jaro_of(threshold, prefix)
        share, ratio = 3 * j - 1, 3 * j - 2  # ratio: of the shorter length to the longer, at least
        exact = ratio >= 0.5
        bands = range(length_class(EXACT + 1 if exact else 1, exact), EXACT + 1 + OPEN)
        there = [*(range(1, EXACT + 1) if exact else ()), *bands] if lengths is None else sorted({length_class(m, exact) for m in lengths})

        def reach(low: int, high: int, ratio=ratio, exact=exact, there=there) -> list[int]:
            """Classes of lengths that go with lengths from ``low`` to ``high``."""
            first, last = (length_class(max(1, math.ceil(low * ratio - 1e-9)), exact), length_class(math.floor(high / ratio + 1e-9), exact)) if ratio > 0 else (0, EXACT + 1 + OPEN)
            return [c for c in there if first <= c <= last and class_ends(c)[0] <= class_ends(c)[1]]

        mine, made = length_class(n, exact), []
        for other in reach(n, n):
            small, large = min(mine, other), max(mine, other)
            least = lambda x, y, kind=kind, share=share: math.ceil(share * x * y / (x + y) - 1e-9) - kind
            # What holds for all strings of both classes tells how many tokens make a key, so that both sides agree.
            surely, top = least(class_ends(small)[0], class_ends(large)[0]), class_ends(large)[1] - kind
            most = KEYS // max(1, len(reach(*class_ends(large))))
            r = max(0, min(surely, 2))
            while r < surely and math.comb(top - surely + r + 1, r + 1) <= most:
                r += 1
            common = max(surely, least(n, class_ends(other)[0]))
            if n - kind >= common:
                made.append((mixed(kind, small, large), (0 if mine == other else 1 if mine < other else 2), np.array(list(combinations(range(n - kind - common + r), r)), dtype=np.int64).reshape(-1, r) if r else np.zeros((1, 0), dtype=np.int64)))
        out.append((kind, made))
    return out


@lru_cache(maxsize=1 << 16)
def token_code(c: str, seen: int) -> int:
    """A random number for a token: sums of them tell sets of tokens apart."""
    return int.from_bytes(blake2b(f"{ord(c)}:{seen}".encode(), digest_size=8).digest())


def jaro_winkler_tokens(text: str, threshold: float, often: dict[str, int], lengths: frozenset[int] | None = None) -> np.ndarray:
    """Keys such that of two strings of the threshold or more one has the ``mate`` of a key of the other.

    Of strings of n and m letters with a Jaro similarity of j at least
    ``(3j - 1) * n * m / (n + m)`` letters are common, of any order. A letter and
    its number within the string make a token. If s tokens are common, the r
    rarest common ones are among the rarest ``n - s + r`` of either string, so
    all r of these are a key, beside the lengths of both; the more tokens, the fewer
    strings share a key, so r is as large as ``KEYS`` allows. What is common is
    told for four kinds of pairs: four first letters are the same (which then are
    part of the key, and less similarity is needed beyond them), two are, one is, or none.
    ``lengths``: those that occur, if they are known. The last two bits tell whether the other string is of
    the same class of lengths (0), of a longer (1) or a shorter one (2), so that strings of one class only meet for keys of that class.
    """
    out = []
    for kind, entries in key_plan(len(text), threshold, lengths):
        seen, tokens = Counter(), []
        for c in text[kind:]:
            seen[c] += 1
            tokens.append((often.get(c, 0) / 4 ** seen[c], c, seen[c]))
        tokens.sort()
        codes = np.array([token_code(c, i) for _, c, i in tokens], dtype=np.uint64)
        head = mixed(kind, *map(ord, text[:kind])) & MASK
        for group, side, put in entries:
            made = codes[put].sum(axis=1, dtype=np.uint64) + np.uint64((group * 0x9E3779B97F4A7C15 + head) & MASK)
            out.append(made << np.uint64(2) | np.uint64(side))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def jaro_winkler_keys(text: str, threshold: float, often: dict[str, int], lengths: frozenset[int] | None = None) -> set[int]:
    """Keys of which two strings of the threshold or more share one, whichever is longer."""
    return set((jaro_winkler_tokens(text, threshold, often, lengths) >> 2).tolist())


def mate(token: Column) -> Column:
    """The key that another string has where this one has ``token``."""
    return F.when(token.bitwiseAND(F.lit(3)) == 0, token).otherwise(token.bitwiseXOR(F.lit(3)))


#: Bands of lengths up to about a billion, where a threshold sets no limit.
OPEN = band(1 << 30) + 1


def letter_counts(texts: DataFrame, text: str) -> dict[str, int]:
    """In how many strings each letter occurs; no longer than the alphabets."""
    letters = texts.select(F.explode(F.array_distinct(F.split(text, ""))).alias("c")).where("c <> ''")
    return {r.c: r.n for r in letters.groupBy("c").agg(F.count("*").alias("n")).collect()}


def lengths_of(texts: DataFrame, text: str) -> frozenset[int]:
    """The lengths that occur; no more than the longest string has letters."""
    return frozenset(r.n for r in texts.select(F.length(text).alias("n")).where("n > 0").distinct().collect())


def keyed_by_jaro_winkler(rows: DataFrame, text: str, threshold: float, often: dict[str, int] | None = None, lengths: frozenset[int] | None = None) -> DataFrame:
    """``rows`` with a ``token`` for each key of ``text``; of two that reach the threshold one has the ``mate`` of a token of the other. Empty and null texts have none.

    Two tables that are joined need the same ``often`` and ``lengths``.
    """
    counts, long = (letter_counts(rows, text), lengths_of(rows, text)) if often is None else (often, lengths)

    @F.pandas_udf("array<bigint>")
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: jaro_winkler_tokens(s, threshold, counts, long) if s else None)

    # Keys are much work for few bytes, so rows are dealt to all tasks; the keys are written once, for both sides of a join.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartition(parts).withColumn("token", F.explode(keys(F.col(text)))), "jaro-winkler-keys")


# -- edit distance -----------------------------------------------------------------


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of the parts of a string of length n, the last ones longer by one."""
    size, more = divmod(n, parts)
    out, at = [], 0
    for k in range(parts):
        length = size + (k >= parts - more)
        out.append((at, length))
        at += length
    return out


def edit_keys(text: str, most: int) -> tuple[list[str], list[str]]:
    """Keys to be found by, and keys to look for: strings of ``most`` edits or fewer apart meet in one.

    A string is cut into ``most + 1`` segments. Of a string no shorter that is
    within reach, one segment stays whole (an edit touches one segment only), and
    stands at most as far from its place as the lengths and the other edits allow.
    Strings too short to be cut are found by their length alone.
    """
    n, parts = len(text), most + 1
    own = [f"{n}:{k}:{text[a : a + size]}" for k, (a, size) in enumerate(segments(n, parts))] if n >= parts else [f"{n}"]
    seek = []
    for m in range(max(0, n - most), n + 1):
        if m < parts:
            seek.append(f"{m}")
            continue
        apart = n - m
        for k, (a, size) in enumerate(segments(m, parts)):
            # Of the edits left of the segment and right of it, those that a shift needs are bounded by what remains.
            low = max(0, a - k, a + apart - (most - k))
            high = min(n - size, a + k, a + apart + (most - k))
            seek += [f"{m}:{k}:{text[s : s + size]}" for s in range(low, high + 1)]
    return own, list(dict.fromkeys(seek))


@lru_cache(maxsize=1 << 12)
def edit_plan(n: int, most: int, lengths: frozenset[int]) -> list[tuple[int, int, np.ndarray]]:
    """For each other length within ``most``: a number for both, which is longer, and which tokens of a string of length n are put together."""
    out = []
    for m in sorted(lengths):
        if abs(n - m) > most or m > EXACT:
            continue
        common = max(n, m) - most
        if n < common:
            continue
        r = max(0, min(common, 2))
        while r < common and math.comb(most + r + 1, r + 1) <= EDIT_KEYS:
            r += 1
        put = np.array(list(combinations(range(n - common + r), r)), dtype=np.int64).reshape(-1, r) if r else np.zeros((1, 0), dtype=np.int64)
        out.append((mixed(most, min(n, m), max(n, m)), (0 if n == m else 1 if n < m else 2), put))
    return out


def edit_tokens(text: str, most: int, often: dict[str, int], lengths: frozenset[int]) -> tuple[np.ndarray, int]:
    """Keys such that of two strings within ``most`` edits and of up to ``EXACT`` letters one has the ``mate`` of a key of the other; and a mask of all letters.

    An edit takes one letter away at most, so all letters but ``most`` of the longer string are common, see
    ``jaro_winkler_tokens``. A segment of a title is no rarer than the words it is made of; its rarest letters are.
    """
    seen, tokens = Counter(), []
    for c in text:
        seen[c] += 1
        tokens.append((often.get(c, 0) / 4 ** seen[c], c, seen[c]))
    tokens.sort()
    codes = np.array([token_code(c, i) for _, c, i in tokens], dtype=np.uint64)
    mask = int(np.bitwise_or.reduce(np.uint64(1) << (codes >> np.uint64(58)))) if tokens else 0
    out = []
    for group, side, put in edit_plan(len(text), most, lengths) if len(text) <= EXACT else ():
        made = codes[put].sum(axis=1, dtype=np.uint64) + np.uint64(group & MASK)
        out.append(made << np.uint64(2) | np.uint64(side))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, dtype=np.int64), mask - (1 << 64) if mask >> 63 else mask


def edit_pairs(titles: DataFrame, title: str, most: int, seeking: DataFrame | None = None) -> DataFrame:
    """``(title, other, d)``: for each of ``seeking`` (all ``titles``, unless told), the ``titles`` within ``most`` edits, itself (d = 0) included.

    Both have distinct titles. Two of up to ``EXACT`` letters meet by rare letters, others by segments. Masks of
    letters and then the distance decide where two meet, so only pairs within it are gathered and told apart.
    """
    often, lengths = letter_counts(titles, title), lengths_of(titles, title) | {0}
    long = max(lengths) > EXACT

    def made(texts: pd.Series) -> pd.DataFrame:
        found = [edit_tokens(s, most, often, lengths) for s in texts]
        # Only the longer of two seeks, so that segments are cut where one of two is long.
        segment = [edit_keys(s, most) if long and len(s) > EXACT - most else ([], []) for s in texts]
        return pd.DataFrame({"token": [t for t, _ in found], "mask": [m for _, m in found], "own": [o for o, _ in segment], "seek": [k if len(s) > EXACT else [] for s, (_, k) in zip(texts, segment, strict=True)]})

    keys = F.pandas_udf(made, "token array<bigint>, mask bigint, own array<string>, seek array<string>")
    parts = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        return materialize(rows.repartition(parts).select(F.col(title).alias(name), keys(F.col(title)).alias("k")).select(name, F.col("k.mask").alias(f"{name}_mask"), "k.token", *(F.transform(F.col("k")[c], lambda x: F.xxhash64(x)).alias(c) for c in ("own", "seek"))), "edit-keys")

    def by(rows: DataFrame, name: str, column: str) -> DataFrame:
        return rows.select(name, f"{name}_mask", F.explode(column).alias("key"))

    b = keyed(titles, "b")
    a = b.withColumnsRenamed({"b": "a", "b_mask": "a_mask"}) if seeking is None else keyed(seeking, "a")
    # The shorter one is found by its own segments; either may be the one that seeks.
    met = [(by(a, "a", "token"), by(b, "b", "token").withColumn("key", mate(F.col("key"))))]
    met += [(by(a, "a", "own"), by(b, "b", "seek")), (by(a, "a", "seek"), by(b, "b", "own"))] if long else []
    x, y = F.col("a_mask"), F.col("b_mask")
    # An edit adds one letter at most and takes one away at most.
    may = (F.bit_count(x.bitwiseAND(F.bitwise_not(y))) <= most) & (F.bit_count(y.bitwiseAND(F.bitwise_not(x))) <= most)
    d = levenshtein_within(F.col("a"), F.col("b"), most)
    pairs = reduce(DataFrame.union, [l.join(r, "key").where(may).select("a", "b", d.alias("d")).where("d is not null") for l, r in met])
    return pairs.distinct().select(F.col("a").alias(title), F.col("b").alias("other"), "d")
