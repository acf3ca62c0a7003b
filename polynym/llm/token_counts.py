"""Exact token counts for every context limit, from a histogram of encoded lengths."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]
#: Suffix sums run within this many neighbouring lengths, and over the sums of such ranges.
SPAN = 1024


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def length_batches(ranks: bytes, pattern: str) -> Callable[[Batches], Batches]:
    """(text, ...) to (n_tokens, ...)."""

    def run(batches: Batches) -> Batches:
        encode = _encoding(ranks, pattern).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(t.as_py() or "")) for t in b.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([n, *b.columns[1:]], ["n_tokens", *b.schema.names[1:]])

    return run


def encoded_lengths(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """``(n_tokens, *keep)``, one row for each row of ``docs``; null and empty texts have no tokens. Kept columns may have any name but ``n_tokens``; no rows give none.

    The vocabulary (under a megabyte) is read on the driver and sent with the task.
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    text = "_" * (1 + max(map(len, keep), default=0))  # no name of a kept column
    rows = docs.select(F.col(text_col).cast("string").alias(text), *keep)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(length_batches(ranks, pattern), ", ".join(["n_tokens long", *(f"`{c}` {kinds[c]}" for c in keep)]))


def histogram(lengths: DataFrame) -> DataFrame:
    """``(length, n_docs)``: combined before the shuffle, so it has a row for each length and task at most."""
    return lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """``(length, n_docs, docs_at_least, tokens_at_least, total_docs, total_tokens, truncated_total)``.

    ``truncated_total`` is the number of tokens left if every document is cut to
    ``length``; ``docs_at_least`` and ``tokens_at_least`` are over the documents of
    that length or more. Between two lengths of the table the truncated total is
    linear in the limit, see ``at_limits``. An empty histogram gives no rows.

    Sums are exact integers in two levels: within ranges of ``SPAN`` lengths, each
    a window of its own, and over the ranges, of which there are few.
    """
    part = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / SPAN).alias("range"))
    ranges = part.groupBy("range").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("all_tokens"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    summed = ranges.select("range", F.coalesce(F.sum("docs").over(above), zero).alias("docs_above"), F.coalesce(F.sum("all_tokens").over(above), zero).alias("tokens_above"), F.sum("docs").over(whole).alias("total_docs"), F.sum("all_tokens").over(whole).alias("total_tokens"))
    inner = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = part.join(summed, "range").select(
        "length", "n_docs", (F.sum("n_docs").over(inner) + F.col("docs_above")).alias("docs_at_least"), (F.sum("tokens").over(inner) + F.col("tokens_above")).alias("tokens_at_least"), "total_docs", "total_tokens"
    )
    return out.withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``(limit, docs_over, truncated_total)`` for given context limits."""
    wanted = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "`limit` long")
    # The list of limits is the caller's own and small.
    longer = sums.join(F.broadcast(wanted), F.col("length") > F.col("limit")).groupBy("limit").agg(F.sum("n_docs").alias("over"), F.sum(F.col("n_docs") * F.col("length")).alias("tokens_over"))
    total = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0))).first()[0]
    return wanted.join(longer, "limit", "left").select("limit", F.coalesce("over", F.lit(0)).alias("docs_over"), (F.lit(total) - F.coalesce("tokens_over", F.lit(0)) + F.coalesce("over", F.lit(0)) * F.col("limit")).alias("truncated_total"))


def quantiles(sums: DataFrame, fractions: list[float]) -> list[int | None]:
    """For each fraction q, the smallest length that at least q of the documents do not exceed."""
    up_to = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    row = sums.agg(*(F.min(F.when(up_to >= F.lit(q) * F.col("total_docs"), F.col("length"))).alias(f"q{i}") for i, q in enumerate(fractions))).first()
    return list(row)


def with_percentiles(sums: DataFrame) -> DataFrame:
    """``sums`` with ``from_percent`` and ``to_percent``: the whole percents p for which ``length`` is the p-quantile.

    That is the smallest length that at least p percent of the documents do not
    exceed. Where none is, ``from_percent`` is greater. Exact integers throughout.
    """
    up_to = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    whole = lambda docs: (100 * docs - F.pmod(100 * docs, F.col("total_docs"))) / F.col("total_docs")
    return sums.withColumns({"from_percent": (whole(up_to - F.col("n_docs")) + 1).cast("long"), "to_percent": whole(up_to).cast("long")})
