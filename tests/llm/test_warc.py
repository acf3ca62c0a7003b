import gzip
import hashlib
import io
import random

import pytest

from polynym.llm import warc


def test_records_parse_back():
    data = warc.record([("WARC-Type", "response"), ("X", "é")], b"body\r\n\r\nWARC/1.1\r\n") + warc.record([("WARC-Type", "revisit")], b"")
    got = [warc.parse(x) for _, _, x in warc.members(io.BytesIO(data), piece=7)]
    assert got[0] == ({"warc-type": "response", "x": "é", "content-length": "18"}, b"body\r\n\r\nWARC/1.1\r\n") and got[1][1] == b""
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 3
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-3])))


def test_revisits(spark):
    rnd = random.Random(9)
    bodies = ["x" * 99, "y" * 100, "é" * 50, "", None, "z" * 5000] + ["".join(rnd.choice("ab\r\n") for _ in range(200)) for _ in range(5)]
    rows = [(i, f"http://h/{i}\n", rnd.choice(bodies), 1) for i in rnd.sample(range(1000), 80)] + [(None, None, "y" * 100, 2), (5000, "u", "only" * 50, 3), (5000, "u", "only" * 50, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, length int").repartition(5)
    want, least = [], {}
    for i, _, h, _ in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            least[p] = min(i, least.get(p, i))
    for i, _, h, _ in rows:
        p = (h or "").encode()
        revisit = len(p) >= 100 and least[p] != i
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", least[p] if revisit else None))
    want.remove(w := next(x for x in want if x[0] == 5000))
    want.append((*w[:3], "revisit", 5000))
    out = warc.dedup_archives(pages)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.dedup_archives(pages.where("false")).count() == 0


def test_uris_and_string_ids(spark):
    rows = [("a%20b\r\nX: y", "http://a/b%20c", "p" * 200), ("b", "http://a/\r\nEvil: 1", "p" * 200), ("ü", "http://ü/?q=%C3%BC", "short")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    folder = warc._new_folder(spark, "uris")
    found = warc.read_headers(warc.write_archives(pages, folder), "string").collect()
    assert sorted((r.page_id, r.uri) for r in found) == [("a%20b\r\nX: y", "http://a/b%20c"), ("b", "http://a/%0D%0AEvil: 1"), ("ü", "http://ü/?q=%C3%BC")]
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.dedup_archives(pages).collect())
    assert got == [("a%20b\r\nX: y", "response", None), ("b", "revisit", "a%20b\r\nX: y"), ("ü", "response", None)]


def test_archives_are_read_by_many_tasks(spark):
    """One partition for about each file, whatever adaptive execution would merge."""
    pages = spark.range(100).selectExpr("id page_id", "concat('http://h/', id) url", "repeat('x', 200) html").repartition(20)
    files = warc.write_archives(pages, warc._new_folder(spark, "many"))
    headers = warc.read_headers(files)
    assert files.count() == 20 and headers.rdd.getNumPartitions() == 2 * files.count()
    assert headers.count() == 100
