"""Mining of hard negatives among labelled pairs (idx, qid, l1_title, l2_title, bucket)."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polynym.functions.similarity import jaro_winkler, jaro_winkler_values
from polynym.operators.materialize import materialize
from polynym.operators.similarity_join import edit_pairs, keyed_by_jaro_winkler, lengths_of, letter_counts, mate, token_code

#: Edit distances at which near titles are looked for before the largest one.
DISTANCES = (1, 2, 3)
#: Similarities down to which the most similar title is looked for, one after the other; below, keys are shared by too many.
LEVELS = (0.9,)
#: In buckets of up to so many titles all are compared at once.
FEW = 256
#: In buckets of up to so many titles bounds of all similarities are computed; in larger ones only of titles for which the levels find nothing.
MANY = 16384
#: Titles of a task that seek, and those they are held against; cells of the matrix that are computed at once; columns of it.
SEEKING, HELD, MATRIX, COLUMNS = 2048, 8192, 1 << 20, 1024
#: Of each title's bounds the largest are looked at first.
FIRST = 8


def token_counts(titles: list[str]) -> np.ndarray:
    """A row for each title: its letters, each with its number within the title, in ``COLUMNS`` columns, of which a title has one or more tokens."""
    out = np.zeros((len(titles), COLUMNS), dtype=np.float32)
    for i, t in enumerate(titles):
        seen: Counter[str] = Counter()
        for c in t:
            seen[c] += 1
            out[i, token_code(c, seen[c]) % COLUMNS] += 1
    return out


def bounds(a: list[str], b: list[str]) -> np.ndarray:
    """No less than the Jaro-Winkler similarity of each of ``a`` and each of ``b``, from their common letters, lengths and prefixes."""
    x, y = token_counts(a), token_counts(b)
    used = x.any(axis=0) & y.any(axis=0)
    la, lb = (np.array([len(t) for t in s], dtype=np.float32) for s in (a, b))
    # A product of numbers is no less than the smaller of them.
    common = np.minimum(x[:, used] @ y[:, used].T, np.minimum(la[:, None], lb[None, :]))
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(common > 0, (common * (1 / la[:, None] + 1 / lb[None, :]) + 1) / 3, 0)
    alike = np.ones(jaro.shape, dtype=bool)
    prefix = np.zeros(jaro.shape, dtype=np.float32)
    for k in range(4):
        p, q = (np.array([ord(t[k]) if len(t) > k else none for t in s]) for s, none in ((a, -1), (b, -2)))
        alike &= p[:, None] == q[None, :]
        if not alike.any():
            break
        prefix += alike
    jaro += 1e-5  # of single precision
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def two_best(rows: np.ndarray, items: np.ndarray, jw: np.ndarray, idx: np.ndarray, qid: np.ndarray) -> np.ndarray:
    """Which places of ``rows`` (with what they meet, and its similarity) hold the best of each row, and the best of another qid; ties go to the first ``idx``."""
    order = np.lexsort((idx[items], -jw, rows))
    r, q = rows[order], qid[items[order]]
    first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, dtype=bool)
    lead = q[np.flatnonzero(first)][np.cumsum(first) - 1] if len(r) else q
    other = np.flatnonzero(q != lead)
    second = other[np.r_[True, r[other][1:] != r[other][:-1]]] if len(other) else other
    return order[np.r_[np.flatnonzero(first), second]]


def closest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """For each title of ``a`` its two best rows of ``b`` (other, q_qid, q_idx, ...), of two qids, with ``jw``.

    Exact similarities are computed where the bound allows for a title to be among the two.
    """
    seek, held = a["l1_title"].tolist(), b["other"].tolist()
    names, of = np.unique(np.array(held, dtype=object), return_inverse=True)
    names, at = names.tolist(), np.argsort(of, kind="stable")
    starts = np.searchsorted(of[at], np.arange(len(names) + 1))
    idx, qid = b["q_idx"].to_numpy(), pd.factorize(b["q_qid"])[0]
    found = []
    step = max(1, MATRIX // max(1, len(names)))

    def items(rows: np.ndarray, cols: np.ndarray, part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of ``b`` of these titles, each with its similarity."""
        pairs = [(part[i], names[j]) if part[i] < names[j] else (names[j], part[i]) for i, j in zip(rows.tolist(), cols.tolist(), strict=True)]
        jw = jaro_winkler_values([x for x, _ in pairs], [y for _, y in pairs])
        n = starts[cols + 1] - starts[cols]
        place = np.repeat(starts[cols] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.repeat(rows, n), at[place], np.repeat(jw, n)

    for s in range(0, len(seek) if names else 0, step):
        part = seek[s : s + step]
        most = bounds(part, names)
        k = min(FIRST, len(names))
        cols = np.argpartition(-most, k - 1, axis=1)[:, :k]
        r, m, jw = items(np.repeat(np.arange(len(part)), k), cols.ravel(), part)
        # What two rows of different qids reach is needed to be among the two best.
        least = np.full(len(part), -1.0)
        best = two_best(r, m, jw, idx, qid)
        twice = np.bincount(r[best], minlength=len(part)) == 2
        low = np.full(len(part), np.inf)
        np.minimum.at(low, r[best], jw[best])
        least[twice] = low[twice]
        np.put_along_axis(most, cols, -2.0, axis=1)
        rest = items(*np.nonzero(most >= least[:, None]), part)
        r, m, jw = (np.concatenate(p) for p in zip((r, m, jw), rest))
        best = two_best(r, m, jw, idx, qid)
        out = b.iloc[m[best]].drop(columns=["other"])
        found.append(out.assign(l1_title=[part[i] for i in r[best].tolist()], jw=jw[best]))
    return pd.concat(found) if found else b.iloc[:0].drop(columns=["other"]).assign(l1_title=pd.Series(dtype=str), jw=pd.Series(dtype=float))


def hard_negatives(pairs: DataFrame, levels: tuple[float, ...] = LEVELS, few: int = FEW, many: int = MANY) -> DataFrame:
    """For each row, the row of its bucket with another qid and the most similar first title.

    Similarity is Jaro-Winkler of the raw titles; among equals the first row
    wins. A row alone in its bucket has none, and a row without a title, qid or
    bucket neither has one nor is one. In buckets of over ``many`` titles, titles are
    searched by falling bounds: at each level only titles of which a row has nothing yet look for others, by
    a join that holds all pairs of the level or more. So what a title found at a
    level is the best, and most titles never meet the rest of their bucket. Those
    that are like nothing at the lowest level, and those of buckets of over ``few``, are held against all of the bucket
    by bounds of the similarity (see ``closest``).
    """
    fine = pairs.where("l1_title is not null and qid is not null and bucket is not null")
    rows = materialize(fine.select("idx", "qid", "l1_title", "l2_title", "bucket"), "negative-rows")
    # Of each title's rows, the first and the first of another qid are all that can win.
    firsts = rows.groupBy("bucket", "l1_title", "qid").agg(F.min(F.struct("idx", "l2_title")).alias("q"))
    ranked = Window.partitionBy("bucket", "l1_title").orderBy("q")
    firsts = materialize(firsts.withColumn("_k", F.row_number().over(ranked)).where("_k <= 2").select("bucket", F.col("l1_title").alias("other"), F.col("qid").alias("q_qid"), F.col("q.idx").alias("q_idx"), F.col("q.l2_title").alias("q_l2")), "negative-firsts")

    def best(found: DataFrame, of: DataFrame) -> DataFrame:
        """Of each row, the best of the ``found`` (bucket, l1_title, other, jw).

        A title's best and its best of another qid are told once; its rows, however many they are, take one of the two.
        """
        return chosen(found.join(firsts, ["bucket", "other"]), of)

    def chosen(met: DataFrame, of: DataFrame) -> DataFrame:
        met = met.withColumn("q", F.struct("jw", (-F.col("q_idx")).alias("first"), "q_l2", "q_qid"))
        of_qid = met.groupBy("bucket", "l1_title", "q_qid").agg(F.max("q").alias("q"))
        two = of_qid.withColumn("_k", F.row_number().over(Window.partitionBy("bucket", "l1_title").orderBy(F.desc("q")))).where("_k <= 2")
        won = two.groupBy("bucket", "l1_title").agg(*(F.max(F.when(F.col("_k") == k, F.col("q"))).alias(f"_{k}") for k in (1, 2)))
        p = of.select("idx", "qid", "l1_title", "bucket").join(won, ["bucket", "l1_title"])
        return p.select("idx", "qid", "l1_title", "bucket", F.when(F.col("qid") != F.col("_1.q_qid"), F.col("_1")).otherwise(F.col("_2")).alias("best")).where("best is not null")

    titles = materialize(rows.select("bucket", "l1_title").distinct(), "negative-titles")
    sizes = materialize(titles.groupBy("bucket").agg(F.count("*").alias("n")), "negative-sizes")
    small, middle = sizes.where(F.col("n") <= few).select("bucket"), sizes.where((F.col("n") > few) & (F.col("n") <= many)).select("bucket")

    def scored(seeking: DataFrame, level: float | None) -> DataFrame:
        """``(bucket, l1_title, other, jw)`` of the level or more; None: of all in the bucket."""
        other = titles.select("bucket", F.col("l1_title").alias("other"))
        if level is None:
            met = seeking.join(other, "bucket")
        else:
            a, b = keyed_by_jaro_winkler(seeking, "l1_title", level, *often), keyed_by_jaro_winkler(other.join(seeking.select("bucket").distinct(), "bucket", "left_semi"), "other", level, *often)
            met = a.join(b.withColumn("token", mate(F.col("token"))), ["bucket", "token"]).select("bucket", "l1_title", "other").distinct()
        # In one order, so that a pair's score is the same from both sides to the last bit.
        jw = jaro_winkler(F.least("l1_title", "other"), F.greatest("l1_title", "other"))
        found = met.where("l1_title <> other").withColumn("jw", jw)
        return found if level is None else found.where(F.col("jw") >= level)

    def held(seeking: DataFrame) -> DataFrame:
        """``(bucket, l1_title, jw, q_...)``: the two best of all in the bucket, or in each part of it; parts of buckets meet in tasks."""

        def dealt(rows: DataFrame, title: str, at: str, side: int, beside: str, others: int) -> DataFrame:
            parts, across = (F.ceil(F.col("n") / n).cast("int") for n in (side, others))
            return rows.join(sizes, "bucket").withColumns({at: F.pmod(F.xxhash64(title), parts).cast("int"), beside: F.explode(F.sequence(F.lit(0), across - 1))}).drop("n")

        a = dealt(seeking, "l1_title", "_i", SEEKING, "_j", HELD)
        b = dealt(firsts.join(seeking.select("bucket").distinct(), "bucket", "left_semi"), "other", "_j", HELD, "_i", SEEKING)
        types = {f.name: f.dataType.simpleString() for f in firsts.schema}
        schema = f"bucket {types['bucket']}, l1_title string, jw double, q_qid {types['q_qid']}, q_idx {types['q_idx']}, q_l2 {types['q_l2']}"

        def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return closest(a, b)[["bucket", "l1_title", "jw", "q_qid", "q_idx", "q_l2"]]

        return a.groupBy("bucket", "_i", "_j").cogroup(b.groupBy("bucket", "_i", "_j")).applyInPandas(run, schema)

    # A title's other rows are as similar as can be.
    same = titles.select("bucket", "l1_title", F.col("l1_title").alias("other"), F.lit(1.0).alias("jw"))
    direct = scored(titles.join(small, "bucket", "left_semi"), None)
    done = materialize(best(same.union(direct), rows), "negative-best")
    rows = rows.join(small, "bucket", "left_anti")
    large = rows.join(middle, "bucket", "left_anti")
    if levels and not large.isEmpty():
        often = letter_counts(titles, "l1_title"), lengths_of(titles, "l1_title")
        for level in levels:
            large = materialize(large.join(done.select("idx"), "idx", "left_anti"), "negative-rows")
            done = materialize(done.union(best(scored(large.select("bucket", "l1_title").distinct(), level), large)), "negative-best")
    rows = materialize(rows.join(done.select("idx"), "idx", "left_anti"), "negative-rows")
    if not rows.isEmpty():
        done = materialize(done.union(chosen(held(rows.select("bucket", "l1_title").distinct()), rows)), "negative-best")
    return done.select("idx", "l1_title", F.col("best.q_l2").alias("l2_title"), "bucket", F.col("qid").alias("positive_qid"), F.col("best.q_qid").alias("negative_qid"), F.col("best.jw").alias("l1_jw_to_source"), F.lit("negative").alias("label"))


def adversarial_negatives(pairs: DataFrame, most: int = 5, per_row: int = 3) -> DataFrame:
    """For each row, up to ``per_row`` rows of another qid with first titles within ``most`` edits, nearest first.

    Ties go to earlier rows. Titles within the distance share rare letters or a segment (see
    ``edit_pairs``). They are looked for at growing distances: at each only titles of which
    a row has too few yet look further, so most never meet what is far from them.
    Rows are cut before they are joined: whatever qid is left out, the nearest
    ``per_row`` rows of others are among the first ``per_row`` of each qid, and of
    these among the first ``2 * per_row``. So a title has that many candidates.
    """

    def leading(df: DataFrame, title: str, order: list[str]) -> DataFrame:
        of_qid = df.withColumn("_k", F.row_number().over(Window.partitionBy(title, "q_qid").orderBy(*order))).where(F.col("_k") <= per_row)
        return of_qid.withColumn("_k", F.row_number().over(Window.partitionBy(title).orderBy(*order))).where(F.col("_k") <= 2 * per_row).drop("_k")

    rows = pairs.select(F.col("l1_title").alias("other"), F.col("qid").alias("q_qid"), F.col("idx").alias("q_idx"), F.col("l2_title").alias("q_l2"), F.col("bucket").alias("q_bucket"))
    q = materialize(leading(rows.where("other is not null and q_qid is not null"), "other", ["q_idx"]), "title-rows")
    titles = materialize(pairs.select("l1_title").where("l1_title is not null").distinct(), "titles")
    seeking, candidates = titles, None
    for d in (*(d for d in DISTANCES if d < most), most):
        close = edit_pairs(titles, "l1_title", d, seeking)
        found = materialize(leading(close.join(q, "other").drop("other"), "l1_title", ["d", "q_idx"]), "title-candidates")
        candidates = found if candidates is None else candidates.join(seeking, "l1_title", "left_anti").unionByName(found)
        # Whatever qid a row has, ``per_row`` rows of others are enough.
        of_qid = found.groupBy("l1_title", "q_qid").agg(F.count("*").alias("n"))
        enough = of_qid.groupBy("l1_title").agg(F.sum("n").alias("all"), F.max("n").alias("most")).where(F.col("all") - F.col("most") >= per_row).select("l1_title")
        seeking = materialize(seeking.join(enough, "l1_title", "left_anti"), "titles")
        if seeking.isEmpty():
            break
    found = pairs.select("idx", "qid", "l1_title", "bucket").join(candidates, "l1_title").where("qid <> q_qid")
    first = Window.partitionBy("idx").orderBy("d", "q_idx")
    best = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_row)
    return best.select("idx", "rank", "l1_title", F.col("q_l2").alias("l2_title"), F.col("bucket").alias("bucket_positive"), F.col("q_bucket").alias("bucket_negative"), F.col("qid").alias("positive_qid"), F.col("q_qid").alias("negative_qid"), F.col("d").alias("l1_levenshtein"), F.lit("negative").alias("label"))
