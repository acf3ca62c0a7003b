"""Exact deduplication: equal 128-bit content hashes, then equal bytes.

Only hashes are grouped and joined. Texts move in one place: those whose hash
another row has too are grouped by hash and text, which compares their bytes
and combines copies in each task before anything is shuffled, so a text that a
third of all rows hold crosses the network once for each task. Hashes under
which more than one text is found (collisions) are grouped by text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polynym.operators.materialize import materialize

#: Bytes of the content hash.
HASH_BYTES = 16
#: Hashes that several rows have are looked up by broadcast up to this many (about 100 MB), beyond it by a shuffle join.
BROADCAST_HASHES = 500_000


def normal(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def content_hash(norm: Column, hash_bytes: int) -> Column:
    return F.substring(F.unhex(F.md5(norm)), 1, hash_bytes)


def collided(texts: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """``(h)`` of the ``shared`` hashes that stand for more than one text, and ``(h, norm, least, n)`` of their texts; None if there are none."""
    if shared.count() <= BROADCAST_HASHES:
        shared = F.broadcast(shared)
    kinds = texts.join(shared, "h", "left_semi").groupBy("h", "norm").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    several = materialize(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h"), "collided")
    if several.isEmpty():  # as good as always; the texts are grouped again only for the hashes that need it
        return None
    return several, materialize(kinds.join(several, "h", "left_semi"), "collided-texts")


def exact_groups(docs: DataFrame, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for each row of ``docs``.

    Texts are equal when they are after each run of ASCII white space became one
    space; null counts as empty, and empty texts are equal. Of equal texts the
    row with the smallest ``doc_id`` (of any type that has an order) stays.
    Repeated rows all count in ``group_size`` and, being one document, share its
    fate. A row without ``doc_id`` counts too and stays, as nothing names it;
    ``keep_id`` is null if no row of its group has an id. No table is too small:
    none gives none. Other columns are not read. ``hash_bytes`` shortens the
    hash, for tests of what happens when texts collide.
    """
    norm = docs.select("doc_id", normal(F.col("text")).alias("norm"))
    texts = norm.withColumn("h", content_hash(F.col("norm"), hash_bytes))
    sha = F.unhex(F.sha2("norm", 256)).alias("sha")
    keys = materialize(texts.select("doc_id", "h", sha), "text-keys")
    groups = materialize(keys.groupBy("h").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "text-groups")
    found = keys.join(groups, "h").select("h", "doc_id", "least", "n", "sha")
    if apart := collided(texts, groups.where("n > 1").select("h")):
        hashes, kinds = apart
        by_text = texts.join(hashes, "h", "left_semi").join(kinds, ["h", "norm"]).select("h", "doc_id", "least", "n", sha)
        found = found.join(hashes, "h", "left_anti").union(by_text)
    kept = F.coalesce(F.col("doc_id") == F.col("least"), F.lit(True))
    return found.select("doc_id", F.col("least").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``exact_groups``."""
    gone = exact_groups(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def oracle() -> str:
    """DuckDB SQL of ``exact_groups`` over documents."""
    norm = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
    return f"""WITH d AS (SELECT doc_id, {norm} AS norm FROM documents), g AS (SELECT doc_id, norm, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM d WINDOW w AS (PARTITION BY norm))
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, true) AS kept, sha256(norm) AS text_sha256 FROM g"""
