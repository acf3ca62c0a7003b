"""The data source against a local server, and the rate of a whole read."""

import json
import re
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

import cli
from polynym.sources import entities, remote
from polynym.sources.datasource import SitelinkSource
from polynym.sources.schema import TYPE_BUCKETS

SIZES = {q: n for (q, _), n in zip(TYPE_BUCKETS, (7, 3, 0, 5, 1, 2, 4, 6, 3, 2))}


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            text = parse_qs(urlparse(self.path).query)["query"][0]
            q = re.search(r"wdt:P31 wd:(Q\d+)", text)[1]
            limit, offset = int(re.search(r"LIMIT (\d+)", text)[1]), int(re.search(r"OFFSET (\d+)", text)[1])
            seen.append((time.time(), q, offset, limit))
            rows = [{"entity": {"value": f"http://x/{q}-{k}"}, "l1Title": {"value": f"a{k}"}, "l2Title": {"value": f"b{k}"}, "type": {"value": f"http://x/{q}"}} for k in range(SIZES[q])]
            body = json.dumps({"results": {"bindings": rows[offset : offset + limit]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}/", seen
    s.shutdown()


def rows_of(df):
    return sorted((r.bucket, r.ord, r.rn, r.qid) for r in df.collect())


def want(buckets, per_type):
    return sorted((b, i, k, f"{q}-{k}") for i, (q, b) in enumerate(TYPE_BUCKETS) if b in buckets for k in range(min(per_type, SIZES[q])))


def test_source_reads_pages_in_partitions_and_pushes_buckets(spark, server):
    url, seen = server
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SitelinkSource)
    read = spark.read.format("sitelinks").options(l1="en", l2="ru", per_type=6, page=2, partitions=4, rate=200, url=url)
    df = read.load()
    assert df.rdd.getNumPartitions() == 4
    seen.clear()
    assert rows_of(df) == want({b for _, b in TYPE_BUCKETS}, 6)
    assert {(q, o) for _, q, o, _ in seen} <= {(q, o) for q in SIZES for o in (0, 2, 4)} and all(n == 2 for *_, n in seen)
    seen.clear()
    assert rows_of(read.load().where("bucket in ('city', 'film') and rn < 1")) == [r for r in want({"city", "film"}, 6) if r[2] < 1]
    assert {q for _, q, _, _ in seen} <= {"Q515", "Q11424"} and seen
    assert rows_of(read.load().where("bucket = 'nothing'")) == []
    with pytest.raises(Exception, match="option l2"):
        spark.read.format("sitelinks").options(l1="en").load().collect()


def test_four_partitions_keep_to_the_rate_together(spark, server):
    url, seen = server
    spark.dataSource.register(SitelinkSource)
    spark.read.format("sitelinks").options(l1="en", l2="ru", per_type=2, page=1, partitions=4, url=url).load().count()
    times = sorted(t for t, *_ in seen)
    assert len(times) >= 15
    # Five a second: within any second five, and one more where its ends meet two slots.
    assert all(b - a > 0.9 for a, b in zip(times, times[6:]))
    assert times[-1] - times[0] > (len(times) - 2) / 5 * 0.9
    seen.clear()
    client = remote.Client(query_url=url)
    assert remote.read_sitelinks(spark, "en", "ru", 3, client, partitions=4).count() == sum(min(3, n) for n in SIZES.values())
    times = sorted(t for t, *_ in seen)
    assert len(times) == 10 and all(b - a > 0.9 for a, b in zip(times, times[6:]))


def test_slots_are_shared_by_turns():
    now = [100.0]
    slots = [remote.Slots(100.0, k, 3, 2.0, lambda s: now.__setitem__(0, now[0] + s), lambda: now[0]) for k in range(3)]
    taken = []
    for k in (0, 1, 2, 0, 2, 1):
        slots[k].wait()
        taken.append(now[0])
    assert taken == [100.0, 100.5, 101.0, 101.5, 102.5, 103.5]
    now[0] = 110.2
    slots[0].wait()
    assert now[0] == 110.5, "slots of the past are not made up for"


def test_commands_that_ask_the_endpoint(spark, server, tmp_path, capsys):
    url, seen = server
    assert cli.main(["smoke", "--url", url]) == 0
    assert "3 rows" in capsys.readouterr().out
    args = ["extract", "--output", str(tmp_path), "--pair", "en", "ru", "--n-per-type", "2", "--url", url]
    assert cli.main(args) == 0
    found = entities.read_pair_folders(spark, str(tmp_path)).collect()
    assert len(found) == sum(min(2, n) for n in SIZES.values()) and {(r.l1, r.l2) for r in found} == {("en", "ru")}
    asked = len(seen)
    assert cli.main(args) == 0 and len(seen) == asked, "what is there stays"


def test_reports_of_the_first_layout(spark, tmp_path):
    (tmp_path / "old.json").write_text('{"normalized": {"n_pairs": 9}, "t4_threshold_sweep": [{"t": 0.5}], "t3_only_inspection": {"n": 1}}')
    (tmp_path / "bare.json").write_text('{"t4_threshold_sweep": [{"t": 0.5}]}')
    (tmp_path / "new.json").write_text('{"language_pair": "en_de", "n_pairs": 4, "t4_threshold_sweep": []}')
    read = lambda name: entities.adapt_report(entities.read_report(spark, str(tmp_path / name))).first()
    old = read("old.json")
    assert (old.language_pair, old.n_pairs, old.t4_threshold_sweep[0].t, old.t3_only_inspection_at_default.n) == ("en_ru", 9, 0.5, 1)
    assert read("bare.json").n_pairs == 375 and read("new.json").language_pair == "en_de"
