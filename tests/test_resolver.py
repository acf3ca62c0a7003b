"""Resolution end to end, and the joins against exhaustive comparison."""

import json
import random
import subprocess
import sys

import pytest

import cli
from polynym.functions.similarity import jaro_winkler_value
from polynym.operators.cascade import Cascade
from polynym.operators.cluster import gold_clusters
from polynym.plans.resolver import Resolver
from polynym.sources.entities import entities_from_rows, read_entities

CORPUS = [
    ("Q1", "Vladimir Putin", "en"), ("Q1", "Wladimir Putin", "de"), ("Q1", "Владимир Путин", "ru"), ("Q2", "Xi Jinping", "en"), ("Q2", "習近平", "zh"), ("Q2", "Си Цзиньпин", "ru"),
    ("Q3", "Angela Merkel", "en"), ("Q3", "Ангела Меркель", "ru"), ("Q3", "أنغيلا ميركل", "ar"), ("Q4", "Barack Obama", "en"), ("Q4", "Барак Обама", "ru"), ("Q4", "باراك أوباما", "ar"),
    ("Q5", "Emmanuel Macron", "en"), ("Q5", "Эмманюэль Макрон", "ru"), ("Q6", "Mahatma Gandhi", "en"), ("Q6", "Махатма Ганди", "ru"), ("Q6", "مهاتما غاندي", "ar"),
    ("Q7", "Nelson Mandela", "en"), ("Q7", "Нельсон Мандела", "ru"), ("Q7", "نيلسون مانديلا", "ar"), ("Q8", "Albert Einstein", "en"), ("Q8", "Альберт Эйнштейн", "ru"), ("Q8", "阿尔伯特·爱因斯坦", "zh"),
    ("Q9", "Marie Curie", "en"), ("Q9", "Мария Кюри", "ru"), ("Q9", "ماري كوري", "ar"), ("Q10", "Napoleon Bonaparte", "en"), ("Q10", "Наполеон Бонапарт", "ru"), ("Q10", "نابليون بونابرت", "ar"), ("Q10", "拿破仑·波拿巴", "zh"),
]
DEFAULT = [[0, 1, 2], [3, 4], [5], [6, 7, 8], [9, 10, 11], [12, 13], [14, 15], [16], [17, 18, 19], [20, 21], [22], [23, 24, 25], [26, 27], [28], [29]]


def corpus(spark):
    return entities_from_rows(spark, [{"id": str(i), "name": n, "lang": lang, "entity_type": "PER"} for i, (_, n, lang) in enumerate(CORPUS)])


@pytest.mark.parametrize(("tiers", "full", "clusters"), [((0.85, 0.82, 0.75), True, 15), ((0.85, 0.82, 0.75), False, 16), ((0.85, 0.70, 0.35), True, 10)])
def test_corpus(spark, tiers, full, clusters):
    got = [[int(x) for x in c] for c in Resolver(*tiers, full_readings=full).clusters(corpus(spark))]
    assert len(got) == clusters
    if tiers[1] == 0.82 and full:
        assert got == DEFAULT


def test_pairs(spark):
    rows = [(i, j, *CORPUS[i][1:], *CORPUS[j][1:], "PER", "PER") for i, j in ((0, 1), (0, 2), (3, 4), (3, 5), (6, 7), (6, 8), (12, 13))]
    rows += [(100, 0, "A", "en", "A", "en", "PER", "ORG"), (101, 0, "", "en", "A", "en", "PER", "ORG"), (102, 0, "A b", "en", "a  B", "de", "", "ORG"), (103, 0, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, j int, name_a string, lang_a string, name_b string, lang_b string, type_a string, type_b string")
    got = {(r.i, r.j): (r.is_match, r.tier, pytest.approx(r.score, abs=1e-12), r.method) for r in Cascade().match_pairs(df).collect()}
    assert got == {
        (0, 1): (True, 2, 0.9523809523809524, "Cascade/same-script-fuzzy"), (0, 2): (True, 3, 1.0, "PhoneticMatcher"), (3, 4): (True, 3, 0.9818181818181818, "PhoneticMatcher"), (3, 5): (False, 4, 0.0, "EmbeddingMatcher"),
        (6, 7): (True, 3, 0.95625, "PhoneticMatcher"), (6, 8): (True, 3, 0.8923076923076924, "PhoneticMatcher"), (12, 13): (True, 3, 0.9616666666666668, "PhoneticMatcher"),
        (100, 0): (False, 1, 0.0, "Cascade/type-mismatch"), (101, 0): (False, 0, 0.0, "Cascade/empty"), (102, 0): (True, 0, 1.0, "Cascade/exact"), (103, 0): (False, 0, 0.0, "Cascade/empty"),
    }


def test_joins_lose_no_match(spark):
    """The union of joins against the cascade on every pair."""
    rnd = random.Random(15)
    base = ["Anna Karenina", "Anton Chekhov", "Ольга Книппер", "Maria Lopez", "Lopez Maria", "علي حسن", "Ali Hasan", "···", "", "Nina", "Ninna", "ina N", "毛泽东", "Mao Zedong"]
    rows = []
    for i in range(70):
        n = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            if n:
                n[rnd.randrange(len(n))] = rnd.choice("aeinoА ")
        rows.append({"id": str(i), "name": "".join(n), "lang": "en", "entity_type": rnd.choice(["PER", "ORG", None])})
    for tiers in ((0.85, 0.82, 0.75), (0.75, 0.7, 0.4)):
        cascade = Cascade(*tiers)
        pairs = [(i, j, a["name"], "en", b["name"], "en", a["entity_type"], b["entity_type"]) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j]
        df = spark.createDataFrame(pairs, "i int, j int, name_a string, lang_a string, name_b string, lang_b string, type_a string, type_b string")
        root = list(range(len(rows)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for r in cascade.match_pairs(df).where("is_match").collect():
            a, b = sorted((find(r.i), find(r.j)))
            root[b] = a
        want = {}
        for i in range(len(rows)):
            want.setdefault(find(i), []).append(str(i))
        assert Resolver(*tiers).clusters(entities_from_rows(spark, rows)) == list(want.values())


def test_small_and_odd_inputs(spark):
    r = Resolver()
    assert r.clusters(entities_from_rows(spark, [{"name": "A"}]).where("false")) == []
    assert r.clusters(entities_from_rows(spark, [{"name": "Solo", "lang": "en"}])) == [["0"]]
    rows = [{"id": "X1", "name": "John Smith", "entity_type": "PER"}, {"id": "X1", "name": "John Smith", "entity_type": "ORG"}, {"id": "X2", "name": None}, {"name": ""}, {"id": "X3", "name": "john  smith"}]
    assert r.clusters(entities_from_rows(spark, rows)) == [["X1", "X1", "X3"], ["X2"], ["3"]]


def test_command_line(spark, tmp_path):
    source, target = tmp_path / "in.jsonl", tmp_path / "out" / "c.json"
    source.write_text("\n\n".join(json.dumps({"id": i, "name": n, "lang": "en", "entity_type": "PER"}) for i, n in (("A1", "Ann Lee"), ("A1", "Ann Lee"), ("A2", "Bob Ray"))))
    assert cli.main(["resolve", "--input", str(tmp_path / "none"), "--output", str(target)]) == 1
    assert cli.main([]) == 0
    assert cli.main(["resolve", "--input", str(source), "--output", str(target), "--force-tfidf", "-v"]) == 0
    assert json.loads(target.read_text()) == {"clusters": [["A1", "A1"], ["A2"]], "count": 2}
    assert [r.idx for r in read_entities(spark, str(source)).orderBy("idx").collect()] == [0, 1, 2]
    assert subprocess.run([sys.executable, "-c", "import cli; cli.parser()"], check=False).returncode == 0


def test_gold(spark):
    rows = [{"id": q, "name": n, "lang": lang} for q, n, lang in CORPUS]
    got = {r.id: len(r.members) for r in gold_clusters(entities_from_rows(spark, rows)).collect()}
    assert got["Q1"] == 3 and got["Q10"] == 4 and len(got) == 10


def test_jaro_winkler_is_symmetric():
    rnd = random.Random(16)
    for _ in range(2000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(2))
        assert jaro_winkler_value(a, b) == pytest.approx(jaro_winkler_value(b, a), abs=1e-12)
