import random

import pytest
from pyspark.sql import functions as F

from polynym.functions.similarity import jaro_winkler_value
from polynym.operators import metrics, negatives, reports
from polynym.operators.cascade import Cascade
from polynym.operators.components import connected_components
from polynym.sources import entities, remote, sinks
from polynym.streaming.incremental import resolve_stream


def clusters(spark, lists):
    return spark.createDataFrame([(i, i, x) for i, c in enumerate(lists) for x in c], "cluster int, ord int, id string")


@pytest.mark.parametrize(
    ("predicted", "gold", "pairwise", "clustered"),
    [
        (["ab", "c"], ["abc"], (1, 1 / 3, 0.5), (1, 0.5, 2 / 3)),
        ([], [], (1, 1, 1), (1, 1, 1)),
        (["a", "b"], ["ab"], (0, 0, 0), (1, 0.5, 2 / 3)),
        (["aa"], ["a", "a"], (0, 0, 0), (1, 0.5, 2 / 3)),
        (["x"], ["ab"], (0, 0, 0), (0, 0, 0)),
    ],
)
def test_micro(spark, predicted, gold, pairwise, clustered):
    p, g = clusters(spark, predicted), clusters(spark, gold)
    assert tuple(metrics.pairwise_prf(p, g).first()) == pytest.approx(pairwise)
    assert tuple(metrics.cluster_prf(p, g).first())[3:] == pytest.approx(clustered)


def test_language_report(spark):
    records = spark.createDataFrame([(0, "a", "en"), (1, "b", "ru"), (2, "c", "en"), (3, "d", "de")], "idx long, id string, lang string")
    report = metrics.language_report(clusters(spark, ["ab", "c", "d"]), clusters(spark, ["abc", "d"]), records)
    got = {r.pair: (r.precision, pytest.approx(r.recall)) for r in report.collect()}
    assert got == {"en-ru": (1.0, 1 / 3), "en-en": (0.0, 0.0), "de-en": (0.0, 0.0), "overall": (1.0, 1 / 3)}
    lines = sinks.language_summary(report)
    assert lines[-1].startswith("  overall       P=1.000  R=0.333") and lines[2].startswith("  de-en")


def sample(rnd, n=60):
    names = ["anna", "annas", "bert", "berta", "carl", "carla", "dora x", "dora y"]
    return [(i, f"Q{rnd.randrange(40)}", rnd.choice(names) + rnd.choice(["", "", "z"]), f"t{i}", rnd.choice("AB")) for i in range(n)]


def test_negatives_against_brute_force(spark):
    rows = sample(random.Random(17))
    df = spark.createDataFrame(rows, "idx long, qid string, l1_title string, l2_title string, bucket string")
    want = []
    for p in rows:
        peers = [q for q in rows if q[4] == p[4] and q[1] != p[1]]
        if peers:
            best = max(peers, key=lambda q: (round(jaro_winkler_value(*sorted((p[2], q[2]))), 12), -q[0]))
            want.append((p[0], p[2], best[3], p[4], p[1], best[1], pytest.approx(jaro_winkler_value(p[2], best[2])), "negative"))
    for few in (256, 0):
        assert [tuple(r) for r in negatives.hard_negatives(df, few=few).orderBy("idx").collect()] == want
    assert negatives.hard_negatives(df.where("false")).count() == 0

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = []
    for p in rows:
        near = sorted(((lev(p[2], q[2]), q[0], q) for q in rows if q[1] != p[1] and lev(p[2], q[2]) <= 2), key=lambda x: x[:2])[:3]
        want += [(p[0], k, d, q[1]) for k, (d, _, q) in enumerate(near, 1)]
    got = negatives.adversarial_negatives(df, most=2).orderBy("idx", "rank").select("idx", "rank", "l1_levenshtein", "negative_qid")
    assert [tuple(r) for r in got.collect()] == want


def test_reports(spark):
    rows = [(i, "b", t3, s, False, True) for i, (t3, s) in enumerate([(True, 0.9), (True, 0.4), (False, 0.8), (False, 0.1), (True, 0.72)])]
    df = spark.createDataFrame(rows, "idx long, bucket string, t3_hit boolean, t4_score double, same_script boolean, positive boolean")
    o = reports.outcomes(df, 0.75).first()
    assert (o.both, o.t3_only, o.t4_only, o.neither, o.t3_recall, o.combined_recall) == (1, 2, 1, 1, 0.6, 0.8)
    assert reports.sweep(df).where("t4_threshold = 0.75").first().t3_only == 2
    assert reports.near_threshold(df).first().near == 1
    assert [r.idx for r in reports.lowest(reports.phonetic_only(df), 10).collect()] == [1, 4]
    assert df.groupBy().agg(metrics.upper_median(F.col("t4_score"))).first()[0] == 0.72
    assert tuple(metrics.ranks_median(df, "t4_score", ["bucket"]).first()) == ("b", 0.1, 0.72, 0.9)
    assert reports.missed_by_both(df.withColumn("l2", F.lit("x"))).count() == 1
    assert reports.outcomes(df.where("false"), 0.75).first().t3_recall == 0.0
    pairs = spark.createDataFrame([("Parma", "parma", "pa r ma"), ("Bern", "xyz", "qqq")], "a string, s string, t string")
    r = reports.spacing_effect(pairs, "a", "s", "t").first()
    assert (r.standard_recall, r.missed, r.far) == (0.5, 1, 1)
    titles = spark.createDataFrame([("Путин",), ("Putin",), ("",)], "l2_title string")
    assert {x.behaviour: x.n for x in reports.transliteration_behaviour(titles).collect()} == {"changed": 1, "passthrough": 1, "empty": 1}
    scored = reports.score_pairs(spark.createDataFrame([("Putin (man)", "Путин")], "l1_title string, l2_title string"), Cascade(), "en", "ru").first()
    assert (scored.l1, scored.t3_hit, scored.t4_score, scored.same_script) == ("Putin", True, 0.0, False)
    d = reports.deltas(spark.createDataFrame([("a", 1.0)], "k string, v double"), spark.createDataFrame([("a", 1.5)], "k string, v double"), "k", ["v"])
    assert d.first().delta_v == 0.5


def test_components(spark):
    rnd = random.Random(18)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def page(rows):
    import json

    return 200, json.dumps({"results": {"bindings": [{k: {"value": v} for k, v in r.items()} for r in rows]}})


class Fake:
    """Answers in turn; keeps what it was asked."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, url, params):
        self.asked.append(params)
        return self.answers.pop(0)


def test_remote_client():
    quick = {"sleep": lambda s: None}
    assert remote.Client(Fake((429, ""), page([{"a": "1"}])), **quick).query("q") == [{"a": "1"}]
    with pytest.raises(RuntimeError):
        remote.Client(Fake((503, ""), (503, "")), tries=2, **quick).query("q")
    assert remote.Client(Fake((200, "{"), page([])), **quick).query("q") == []
    c = remote.Client(Fake(page([{"a": str(i)} for i in range(1000)]), page([{"a": "x"}])), **quick)
    assert len(list(c.pages(lambda o: f"offset {o}", 5000))) == 1001 and [p["query"] for p in c.transport.asked] == ["offset 0", "offset 1000"]
    assert len(list(remote.Client(Fake(page([{"a": "1"}] * 1000)), **quick).pages(str, 42))) == 42
    assert remote.Client(Fake(), **quick).labels([], ["en"]) == []
    now = [0.0]
    slept = []
    limited = remote.Client(Fake(*[page([])] * 7), rate=5.0, sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)), clock=lambda: now[0])
    for _ in range(7):
        limited.query("q")
    assert 0.3 < sum(slept) < 0.6
    assert "wd:Q5" in remote.sitelink_query("en", "ru", "Q5", 10, 20) and "OFFSET 20" in remote.sitelink_query("en", "ru", "Q5", 10, 20)


def answer(url, params):
    if "action" in params:
        import json

        return 200, json.dumps({"entities": {q: {"labels": {"en": {"value": f"label {q}"}}} for q in params["ids"].split("|")}})
    kind = params["query"].split("wd:")[1].split(" ")[0]
    return page([{"entity": f"http://x/{kind}-{i}", "l1Title": "a", "l2Title": "b", "type": f"http://x/{kind}"} for i in range(2)])


def test_remote_sources(spark):
    client = remote.Client(answer, sleep=lambda s: None)
    rows = remote.read_sitelinks(spark, "en", "ru", 2, client).orderBy("ord", "rn").collect()
    assert len(rows) == 20 and tuple(rows[0])[2:] == ("Q5-0", "a", "b", "Q5", "", "person") and rows[-1].bucket == "business"
    labels = remote.read_labels(spark.createDataFrame([("Q1",), ("Q2",), ("Q1",)], "qid string"), client=client)
    assert {r.qid: r.labels for r in entities.label_map(labels).collect()} == {"Q1": {"en": "label Q1"}, "Q2": {"en": "label Q2"}}
    assert remote.read_query(spark, "x wd:Q5 .", ["entity", "none"], client).count() == 2


def test_files(spark, tmp_path):
    rows = [{"id": "a", "name": "Å b", "lang": "en", "entity_type": "PER", "aliases": ["x"]}, {"id": "b", "name": None}]
    df = entities.entities_from_rows(spark, rows)
    sinks.write_entities(df, str(tmp_path / "e"))
    back = entities.read_entities(spark, str(tmp_path / "e")).orderBy("idx").collect()
    assert [(r.idx, r.id, r.name) for r in back] == [(0, "a", "Å b"), (1, "b", None)]
    for pair in ("en_ru", "en_zh_x"):
        (tmp_path / "s" / pair).mkdir(parents=True)
        (tmp_path / "s" / pair / "sitelinks.jsonl").write_text('{"qid": "Q1", "l1_title": "a", "l2_title": "b", "wikidata_type": "Q5", "type_label": "", "bucket": "person"}\n')
    found = entities.read_pair_folders(spark, str(tmp_path / "s"))
    assert sorted((r.l1, r.l2) for r in found.collect()) == [("en", "ru"), ("en", "zh_x")]
    sinks.write_sitelinks(entities.read_sitelinks(spark, str(tmp_path / "s/en_ru")).withColumn("lang_pair", F.lit("en_ru")), str(tmp_path / "o"))
    assert entities.read_sitelinks(spark, str(tmp_path / "o/lang_pair=en_ru")).count() == 1
    assert entities.read_report(spark, str(tmp_path / "none.json")) is None
    sinks.write_report(found, str(tmp_path / "r"))
    assert entities.read_report(spark, str(tmp_path / "r")).count() == 2


def test_stream(spark, tmp_path):
    sink = resolve_stream(str(tmp_path / "store"))
    one = entities.entities_from_rows(spark, [{"name": "Ann Lee"}, {"name": "Bob"}])
    two = one.where("idx = 0").withColumn("idx", F.lit(2).cast("long"))
    sink(one, 0)
    sink(two, 1)
    sink(two, 1)
    got = spark.read.parquet(str(tmp_path / "store/labels-1")).orderBy("idx").collect()
    assert [(r.idx, r.cluster_id) for r in got] == [(0, 0), (1, 1), (2, 0)]


def test_pairs_are_counted_as_if_listed(spark):
    """Random clusters, with ids twice in one and in several, by group; the counts of the sets of pairs."""
    rnd = random.Random(30)
    sides = [[(rnd.choice(["x", "y", None]), f"c{rnd.randrange(5)}", f"i{rnd.randrange(25)}") for _ in range(60)] for _ in range(2)]

    def pairs(rows, group):
        out = set()
        for c in {r[1] for r in rows if r[0] == group}:
            ids = [r[2] for r in rows if r[:2] == (group, c)]
            out |= {tuple(sorted((a, b))) for i, a in enumerate(ids) for b in ids[:i]}
        return out

    p, g = (spark.createDataFrame(s, "g string, cluster string, id string") for s in sides)
    got = {r.g: (r.tp, r.predicted, r.gold) for r in metrics.pair_counts(p, g, ["g"]).collect()}
    assert got == {k: (len(a & b), len(a), len(b)) for k in ("x", "y", None) for a, b in [(pairs(sides[0], k), pairs(sides[1], k))]}
    once = [list({r[2]: r for r in s}.values()) for s in sides]  # each id in one cluster
    p, g = (spark.createDataFrame([("z", *r[1:]) for r in s], "g string, cluster string, id string") for s in once)
    a, b = (pairs([("z", *r[1:]) for r in s], "z") for s in once)
    assert tuple(metrics.pair_counts(p, g, []).first()) == (len(a & b), len(a), len(b))


@pytest.mark.parametrize("spread", [1, 40, 10**15])
def test_median_by_ranges(spark, spread):
    rnd = random.Random(spread)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice([None, float(rnd.randrange(spread)), -rnd.random() * spread**2, 7.0])) for _ in range(300)] + [("one", 1.5), ("two", 1.0), ("two", 2.0), ("none", None)]
    got = {r.g: (r.min, r.median, r.max) for r in metrics.ranks_median(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    groups = {g: sorted(v for h, v in rows if h == g and v is not None) for g in {g for g, _ in rows}}
    assert got == {g: (v[0], v[len(v) // 2], v[-1]) for g, v in groups.items() if v}
