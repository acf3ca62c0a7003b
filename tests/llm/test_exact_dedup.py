import hashlib
import random
import re

from polynym.llm import exact_dedup


def brute(rows):
    norms = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "", flags=re.ASCII) for _, t in rows]
    out = []
    for (i, _), norm in zip(rows, norms, strict=True):
        group = [j for (j, _), other in zip(rows, norms, strict=True) if other == norm]
        ids = [j for j in group if j is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(group), i is None or i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def documents():
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["a", "b", "ß", "\x00", "日本"]) + rnd.choice(["", "\t", "\x0b\n"]) for _ in range(rnd.randint(0, 3))) for _ in range(120)]
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    rows += [(5000, None), (5001, ""), (5002, None), (5003, " "), (5004, "\n\t "), (5005, " "), (5006, "\x1c"), (5007, "x" * 300_000), (5008, "x" * 300_000), (5009, "x" * 299_999 + "y")]
    rows += [(6000, "twice"), (6000, "twice"), (5999, "twice"), (6001, "tie"), (6001, "other"), (None, "twice"), (None, "nameless"), (None, "nameless"), (None, None)]
    return rows


def test_against_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame([(t, i, 1, b"") for i, t in rows], "text string, doc_id long, n int, h binary").repartition(5)
    assert rows_of(exact_dedup.exact_groups(df)) == brute(rows)


def test_texts_under_one_hash_are_told_apart(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    assert rows_of(exact_dedup.exact_groups(df, hash_bytes=1)) == brute(rows)
    assert rows_of(exact_dedup.exact_groups(df, hash_bytes=0)) == brute(rows)


def test_many_shared_hashes_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_HASHES", 0)
    rows = documents()
    assert rows_of(exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty_table_and_ids_of_another_type(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "doc_id string, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_groups(df).collect()} == {("a", "a", True), ("b", "a", False), ("c", "c", True)}


def test_drop_copies_keeps_columns(spark):
    df = spark.createDataFrame([(2, "a  b", 1), (1, "a b", 2), (3, None, 3), (None, "a b", 4), (4, "", 5)], "doc_id long, text string, kept int")
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns
    assert sorted(r.kept for r in out.collect()) == [2, 3, 4]
