import itertools
import random
import zlib

import numpy as np

from polynym.llm import quality_crf as Q


def test_marginals_against_enumeration():
    rnd = np.random.default_rng(6)
    for n in (1, 2, 5, 8):
        m = Q.Model(np.zeros(3), rnd.normal(size=(2, 2)))
        u = rnd.normal(size=n)
        total, good = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(u[k] for k in range(n) if path[k]) + sum(m.transitions[a, b] for a, b in itertools.pairwise(path)))
            total += p
            good += p * np.array(path)
        assert np.allclose(m.marginals(u), good / total)


def make(rnd, bad):
    words = ["the", "of", "river", "stone", "walk", "light", "again"]
    lines = []
    for _ in range(rnd.randint(1, 6)):
        w = [rnd.choice(words) for _ in range(12)]
        lines.append(" ".join(x.upper() + "!!" for x in w) if bad else " ".join(w).capitalize() + ".")
    return "\n".join(lines)


def test_learns_from_rows_that_are_not_held_out(spark):
    rnd = random.Random(7)
    data = [(i, make(rnd, i % 3 == 0), int(i % 3 != 0)) for i in range(400)]
    hidden = {i for i, _, _ in data if zlib.crc32(str(i).encode()) % 4 == 2}
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in data] + [(500, None, 1), (501, "", 1), (None, "Ok then.", 2)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, q if i not in hidden else 1 - q) for i, _, q in data], "doc_id long, quality int")
    rows = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert len(rows) == 403 and {i for i, r in rows.items() if r.held_out and i < 400} == hidden
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert np.mean([rows[i].predicted == q for i, _, q in data if i in hidden]) > 0.95
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}
    assert Q.classify(docs.where("false"), labels).count() == 0
    assert Q.classify(docs, labels.where("false")).count() == 403


def test_documents_count_alike_in_pieces():
    """A document of over 64 lines is cut for training, and weighs as much as a short one; repeats of it change nothing."""
    rnd = random.Random(21)
    good, bad = ([make(rnd, flag).encode().split(b"\n") for _ in range(30)] for flag in (False, True))
    chain = lambda lines: Q.with_neighbours(Q.np.array([Q.line_features(x) for x in lines]), Q.np.arange(len(lines)) == 0)
    long = [x for lines in good for x in lines] * 8
    assert len(long) > 200
    model = Q.train([chain(x) for x in [*good, *bad, long]], [1] * 30 + [0] * 30 + [1])
    same = Q.train([chain(x) for x in [*good, *bad, long]], [1] * 30 + [0] * 30 + [1], longest=4096)
    score = lambda m, lines: sum(m.marginals(chain(lines) @ m.weights)) / len(lines)
    for m in (model, same):
        assert all(score(m, x) > 0.5 for x in [*good, long]) and all(score(m, x) < 0.5 for x in bad)
    assert abs(score(model, long) - score(same, long)) < 0.05
