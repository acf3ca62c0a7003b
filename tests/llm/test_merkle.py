import hashlib
import random
import zlib

import pytest

from polynym.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row, text):
    i, _, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(nodes):
    """(proof of each node, last digest)"""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        for j, a in enumerate(at):
            run = runs[a // 8]
            proofs[j].append((a % 8, run[: a % 8] + run[a % 8 + 1 :]))
        level, at = [sha("".join(r)) for r in runs], [a // 8 for a in at]
    return proofs, level[0]


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    over, root = climb([made[g][1] for g in langs])
    out = []
    for g, above in zip(langs, over, strict=True):
        for (_, _, leaf, r), proof in zip(sorted(groups[g], key=lambda x: x[:3]), made[g][0], strict=True):
            fold = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                fold = leaf_of(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]))
            for place, others in [*proof, *above]:
                fold = sha("".join([*others[:place], fold, *others[place:]]))
            out.append((r[0], leaf, made[g][1], root, sha("".join(d for _, others in [*proof, *above] for d in others)), fold, fold == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def documents(n, langs):
    rnd = random.Random(n)
    rows = [(k, rnd.choice(["Some Text", "lower", "ÄÖ Über", "", None, "日本A"]) , rnd.choice(langs), rnd.choice(["s", None, ""]), rnd.choice([None, 7])) for k in rnd.sample(range(100_000), n)]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_against_brute_force(spark, levels):
    rows = documents(700, ["en"] * 12 + ["de", "fr", None, "", "zz"]) + [(None, "X", "en", None, None), (None, "X", "en", None, None), (3, "A" * 400_000, "only", "s", 1), (3, "B", "en", "s", 1), (3, "B", "en", "s", 1), (3, "C", "en", "s", 1)]
    rows += [(200_000 + k, "T", f"l{k}", "s", k) for k in range(70)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS + ", pos int, digest string").repartition(6)
    assert rows_of(merkle.manifest(df, levels)) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_sizes_of_one_language(spark, n):
    rows = documents(n, ["en"])
    assert rows_of(merkle.manifest(spark.createDataFrame(rows, COLUMNS), 1)) == (brute(rows) if rows else [])


@pytest.mark.parametrize(("n", "levels"), [(1, 1), (8, 1), (9, 2), (64, 2), (65, 3), (300, 3), (511, 3)])
def test_traversal_gives_all_paths(n, levels):
    nodes = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
    root = merkle.block_root(nodes, levels)
    found = list(merkle.traverse(nodes, levels))
    assert len(found) == n
    for d, proof in zip(nodes, found, strict=True):
        assert len(proof) == levels
        assert merkle.fold(d, proof) == root
        assert merkle.unpacked(merkle.packed(proof)) == proof


def test_tampering_is_found(spark):
    rows = [(k, "Upper" if k % 2 else "lower", "en", "s", 5) for k in range(40)]
    found = {r.doc_id: r.verified for r in merkle.manifest(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert found == {k: not (k % 2 and zlib.crc32(str(k).encode()) % 3 == 0) for k in range(40)}
