import hashlib
import random

import numpy as np
import pytest

from polynym.llm import prefix_free as P


def brute(rows, length):
    """rows: (doc_id, text), distinct ids."""
    seen, out = set(), []
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for k in range(len(data) - length + 1):
            w = data[k : k + length]
            if w in seen:
                gone[k : k + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rnd):
    vocab = ["w%d" % rnd.randint(0, 10**6) for _ in range(2000)] + ["é", "the", "ß"]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    shared = [prose(rnd.randint(10, 60)) for _ in range(6)]
    rows = []
    for i in rnd.sample(range(10**6), 60):
        parts = [rnd.choice([prose(rnd.randint(0, 40)), rnd.choice(shared), rnd.choice(shared)[5:-7], "ab" * rnd.randint(0, 120), "x" * rnd.randint(0, 260)]) for _ in range(rnd.randint(0, 6))]
        rows.append((i, "\n".join(parts)))
    return rows + [(10**7 + k, rows[k][1]) for k in range(5)] + [(2 * 10**7, None), (2 * 10**7 + 1, ""), (2 * 10**7 + 2, "q" * 99), (2 * 10**7 + 3, "q" * 100), (2 * 10**7 + 4, "q" * 101)]


def test_against_brute_force(spark):
    rows = corpus(random.Random(11))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5)
    got = sorted(tuple(r) for r in P.removal_digests(docs).collect())
    assert got == brute(rows, 100)
    small = [r for r in rows if r[0] < 10**6]
    assert sorted(tuple(r) for r in P.removal_digests(docs.where("doc_id < 1000000"), 40).collect()) == brute(small, 40)


def test_long_texts_are_cut_into_pieces(monkeypatch, spark):
    rnd = random.Random(12)
    text = "".join(rnd.choice("abc ") for _ in range(5000))
    long = text + "".join(rnd.choice("def ") for _ in range(700)) + text[100:3000]
    for bits in (9, 11, 20):
        monkeypatch.setattr(P, "PIECE_BITS", bits)
        first = list(P.phrase_batches(100)(iter([P.pa.RecordBatch.from_arrays([P.pa.array([7]), P.pa.array([long])], ["ord", "text"])])))
        runs = [(at >> 32, at >> 7 & (2**25 - 1)) for b in first for at in b.column("at").to_pylist()]
        assert sorted(k for s, c in runs for k in range(s, s + c)) == list(range(len(long) - 99))


def test_streamed_groups_over_batches():
    rnd = np.random.default_rng(13)
    rows = sorted((int(a), int(b), 0, int(d), int(s)) for a, b, d, s in zip(rnd.integers(0, 12, 90), rnd.integers(0, 3, 90), rnd.integers(0, 50, 90), rnd.permutation(90)))
    sure, maybe = set(), set()
    for k, (a, b, _, d, s) in enumerate(rows):
        if k and rows[k - 1][:2] == (a, b):
            sure.add((d, s))
        elif len({r[1] for r in rows if r[0] == a}) > 1:
            maybe.add((d, s))
    for size in (1, 2, 7, 90):
        batches = [P.pa.RecordBatch.from_arrays([P.pa.array([r[j] for r in rows[k : k + size]], P.pa.int64()) for j in range(5)], P.KEYED) for k in range(0, 90, size)]
        got = [(d, s, u) for col, u_ in P._streamed(iter(batches), True) for d, s, u in zip(col["ord"], col["at"], u_)]
        assert {(d, s) for d, s, u in got if u} == sure and {(d, s) for d, s, u in got if not u} == maybe and len(got) == len(sure | maybe)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "y" * 150), (1, "y" * 150), (1, "z" * 120), (None, "y" * 150), (None, None)], "doc_id long, text string")
    assert P.removal_digests(docs.where("false")).count() == 0
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in P.remove_repeats(docs).collect())
    assert got == [("1", 120, 119), ("1", 150, 149), ("1", 150, 149), ("None", 0, 0), ("None", 150, 150)]
    with pytest.raises(ValueError):
        P.removal_digests(docs, 10)
