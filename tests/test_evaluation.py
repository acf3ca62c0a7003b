import json

import cli
from polynym.operators.matchers import EmbeddingMatcher, PhoneticMatcher


def test_matchers(spark):
    pairs = spark.createDataFrame([("Vladimir Putin", "Владимир Путин", "en", "ru"), ("", "x", "", ""), ("abc", "abc", "", "")], "name_a string, name_b string, lang_a string, lang_b string")
    got = [(r.is_match, round(r.score, 6), r.tier, r.method) for r in PhoneticMatcher().match(pairs).collect()]
    assert got == [(True, 1.0, 3, "PhoneticMatcher"), (False, 0.0, 3, "PhoneticMatcher"), (True, 1.0, 3, "PhoneticMatcher")]
    assert [r.is_match for r in EmbeddingMatcher().match(pairs).collect()] == [False, False, True]


def test_evaluate_command(spark, tmp_path):
    rows = [("Q1", "Putin", "Путин", "person"), ("Q2", "Putnin", "Обама", "person"), ("Q3", "Moscow", "Москва", "city"), ("Q4", "Mosco", "Киев", "city")]
    folder = tmp_path / "in" / "en_ru"
    folder.mkdir(parents=True)
    (folder / "sitelinks.jsonl").write_text("\n".join(json.dumps({"qid": q, "l1_title": a, "l2_title": b, "wikidata_type": "", "type_label": "", "bucket": c}) for q, a, b, c in rows))
    assert cli.main(["evaluate", "--root", str(tmp_path / "in"), "--output", str(tmp_path / "out")]) == 0
    hard = {r.tier: (r.tp, r.fp, r.tn, r.fn) for r in spark.read.json(str(tmp_path / "out/en_ru/hard")).collect()}
    assert hard["t3"] == hard["combined"] and sum(hard["t3"]) == 8 and hard["t3"][0] >= 1
    assert spark.read.json(str(tmp_path / "out/en_ru/sweep")).count() == 8
