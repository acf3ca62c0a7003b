"""Work that has to grow with the titles, not with the rows or with what is written about them."""

import random
from pathlib import Path

import pandas as pd
import pytest

from polynym.functions.similarity import jaro_winkler_value, jaro_winkler_values, levenshtein_within
from polynym.operators import negatives, reports
from polynym.operators import similarity_join as J
from polynym.plans import queries as core
from polynym.sources import entities

SMALL = Path("/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not SMALL.is_dir(), reason="no tables")
def test_filters_on_scores_are_planned_by_columns(spark):
    scored = core._scored(spark, str(SMALL))
    assert "regexp" not in plan(reports.phonetic_only(scored, 0.75))
    assert "regexp" not in plan(reports.lowest(reports.phonetic_only(scored, 0.75), 10))


def test_rows_of_a_title_take_one_of_its_two_best(spark, monkeypatch):
    made = []
    monkeypatch.setattr(negatives, "materialize", lambda df, label="step": made.append((label, plan(df))) or df)
    rows = [(i, f"q{i % 7}", f"title {i % 5}", f"t {i}", "b") for i in range(70)]
    df = spark.createDataFrame(rows, "idx long, qid string, l1_title string, l2_title string, bucket string")
    got = negatives.hard_negatives(df).orderBy("idx").collect()
    assert not [p for label, p in made if label == "negative-best" and "Aggregate [idx#" in p]
    # Each title has rows of all qids, so the first row of the same title and another qid wins.
    want = [(i, min((j for j in range(70) if j % 5 == i % 5 and j % 7 != i % 7))) for i in range(70)]
    assert [(r.idx, r.l2_title) for r in got] == [(i, f"t {j}") for i, j in want]


def test_random_names_hardly_ever_meet():
    """Seven random letters of 16 and one of eight words: keys hold all matches, and few other pairs."""
    rnd = random.Random(1)
    names = sorted({"".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) + " " + rnd.choice("ring bolt plate gear widget rod gizmo anvil".split()) for _ in range(1200)})
    often = {c: sum(c in s for s in names) for c in set("".join(names))}
    keys = [{(t ^ 3 if t & 3 else t): t for t in J.jaro_winkler_tokens(s, 0.9, often, frozenset(map(len, names))).tolist()} for s in names]
    has = [set(k.values()) for k in keys]
    met = {(i, j) for i, k in enumerate(keys) for j in range(i) if not has[j].isdisjoint(k)}
    pairs = [(i, j) for i in range(len(names)) for j in range(i)]
    scores = jaro_winkler_values([names[i] for i, _ in pairs], [names[j] for _, j in pairs])
    assert {p for p, s in zip(pairs, scores) if s >= 0.9} <= met
    assert len(met) < len(pairs) * 0.02


def test_titles_are_held_against_all_of_their_bucket_by_bounds():
    """The two best of different qids, whatever the letters, numbers of rows and ties; few exact similarities are computed."""
    rnd = random.Random(2)
    for letters, n in (("ab", 60), ("abcdefghijkl é日𝒳", 150)):
        titles = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(n)})
        rows = [(rnd.choice(titles), f"q{rnd.randint(0, 3)}", i, f"l{i}", "b") for i in range(2 * n)]
        rows += [(t, "q0", 2 * n + i, "", "b") for i, t in enumerate(titles)]
        # As the caller does: of each title the first row and the first of another qid.
        firsts = {}
        for r in rows:
            kept = firsts.setdefault(r[0], [])
            if len(kept) < 2 and r[1] not in {k[1] for k in kept}:
                kept.append(r)
        b = pd.DataFrame([r for kept in firsts.values() for r in kept], columns=["other", "q_qid", "q_idx", "q_l2", "bucket"])
        got = negatives.closest(pd.DataFrame({"l1_title": titles}), b)
        found = {t: sorted((-r.jw, r.q_idx, r.q_qid) for r in g.itertuples()) for t, g in got.groupby("l1_title")}
        for t in titles:
            want = []
            for s, i, q in sorted((-jaro_winkler_value(min(t, r.other), max(t, r.other)), r.q_idx, r.q_qid) for r in b.itertuples()):
                if q not in {x[2] for x in want}:
                    want.append((s, i, q))
            assert found[t] == want[:2]
    assert len(negatives.closest(pd.DataFrame({"l1_title": ["a"]}), b.iloc[:0])) == 0


@pytest.mark.parametrize("sizes", [{"few": 0}, {"few": 0, "many": 0}])
def test_hard_negatives_of_large_buckets(spark, sizes):
    rnd = random.Random(3)
    rows = [(i, f"q{rnd.randint(0, 4)}", "".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 8))), f"l{i}", f"b{i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "idx long, qid string, l1_title string, l2_title string, bucket string")
    got = {r.idx: (r.l2_title, r.l1_jw_to_source) for r in negatives.hard_negatives(df, **sizes).collect()}
    for i, q, t, _, b in rows:
        best = max((jaro_winkler_value(min(t, r[2]), max(t, r[2])), -r[0]) for r in rows if r[4] == b and r[1] != q)
        assert got[i] == (f"l{-best[1]}", best[0])


def test_edit_pairs_of_short_and_long_titles(spark):
    """Titles on both sides of the length up to which rare letters are keys."""
    rnd = random.Random(4)
    pool = set()
    for _ in range(60):
        s = "".join(rnd.choice("abcdefgh") for _ in range(rnd.choice((1, 4, J.EXACT - 2, J.EXACT, J.EXACT + 2, J.EXACT + 12))))
        for _ in range(4):
            at = rnd.randint(0, len(s))
            s = s[:at] + rnd.choice(("", "x", "yz")) + s[at + rnd.randint(0, 2) :]
            pool.add(s)
    df = spark.createDataFrame([(s,) for s in sorted(pool)], "t string")
    a, b = df.toDF("a"), df.toDF("b")
    want = {(r.a, r.b): r.d for r in a.crossJoin(b).withColumn("d", levenshtein_within(a.a, b.b, 4)).where("d is not null").collect()}
    assert {(r.t, r.other): r.d for r in J.edit_pairs(df, "t", 4).collect()} == want
    assert any(len(x) <= J.EXACT < len(y) for x, y in want)


def test_titles_of_common_words_meet_by_their_rare_letters():
    """Titles of a few words with letters of their own: segments are words and shared by most, rare letters are not."""
    rnd = random.Random(5)
    titles = sorted({f"{rnd.choice(('large', 'small', 'hot'))[:3]}{''.join(rnd.choice('0123456789abcdef') for _ in range(5))} {rnd.choice(('ring', 'bolt', 'plate'))}" for _ in range(900)})
    often, lengths = {c: sum(c in t for t in titles) for c in set("".join(titles))}, frozenset(map(len, titles))

    def meet(made):
        by_key = {}
        for i, (own, seek) in enumerate(made):
            for k in own:
                by_key.setdefault(k, set()).add(i)
        return {(i, j) for j, (_, seek) in enumerate(made) for k in seek for i in by_key.get(k, ())}

    tokens = [J.edit_tokens(t, 2, often, lengths)[0].tolist() for t in titles]
    found = meet([(k, [x ^ 3 if x & 3 else x for x in k]) for k in tokens])
    assert len(found) * 20 < len(meet([J.edit_keys(t, 2) for t in titles]))


def test_titles_of_an_entity_are_dealt_out(spark, monkeypatch):
    """All pairs of its titles, once for each type, whatever shares they are dealt out in."""
    monkeypatch.setattr(entities, "TITLES", 2)
    links = [("u/e1", "en", f"a{i % 6}") for i in range(7)] + [("u/e1", "de", f"b{i}") for i in range(5)] + [("u/e2", "en", None), ("u/e2", "de", "z"), ("u/e3", "en", "only")]
    kinds = [("u/e1", "t/1"), ("u/e1", "t/2"), ("u/e2", None), ("u/e3", "t/1")]
    got = entities.sitelink_pairs(spark.createDataFrame(links, "entity string, lang string, title string"), spark.createDataFrame(kinds, "entity string, type string"), spark.createDataFrame([("t/1", "one")], "type string, label string"), "en", "de")
    want = [(e[2:], x, y, (t or "")[2:], "one" if t == "t/1" else "") for e, t in kinds for f, lang, x in links if (f, lang) == (e, "en") for g, other, y in links if (g, other) == (e, "de")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert "u/" not in str(got.first()) and got.columns == ["qid", "l1_title", "l2_title", "wikidata_type", "type_label"]
