import random

import xxhash
from pyspark.sql import types as T

from polynym.llm import simhash


def brute_fp(text, width):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)


def brute(rows, width, tau):
    fps = [(i, brute_fp(t, width)) for i, t in rows]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= tau:
                a, b = find(i), find(j)
                root[a] = root[b] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(fps[i][0])
    return sorted((fps[i][0], f"{fps[i][1]:016x}", min(groups[find(i)])) for i in range(len(fps)))


def rows_of(df):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def test_against_brute_force(spark):
    rnd = random.Random(1)
    vocab = ["Ab%d" % i for i in range(300)]
    rows = []
    for i in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(0, 300))]
        for _ in range(3):
            words = list(base)
            for _ in range(rnd.randint(0, 2)):
                if words:
                    words[rnd.randrange(len(words))] = "z"
            rows.append((len(rows) * 3 + 5, " ".join(words)))
    rows += [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "one"), (9004, "One"), (9005, "É é É é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(simhash.near_duplicates(df)) == brute(rows, 4, 4)


def test_blocks_split_hot_buckets(spark):
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)} | {rnd.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([((f - (1 << 64)) if f >> 63 else f,) for f in fps], "fp long")
    small = {tuple(r) for r in simhash.connected_components(simhash.link_fingerprints(df, 4, block=16)).collect()}
    large = {tuple(r) for r in simhash.connected_components(simhash.link_fingerprints(df, 4, block=10**6)).collect()}
    assert small == large
    assert len({c for _, c in small}) == 1


def test_empty_and_clashing_columns(spark):
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("fp", T.StringType()), ("key", T.LongType()))])
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e", "x", 1), (1, "a b c d e", "y", 2), (None, "a b c d e", None, None)], schema)
    assert sorted(map(str, (tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "component_id").collect()))) == ["(1, 1)", "(1, 1)", "(None, 1)"]
    kept = simhash.keep_one(df)
    assert kept.columns == ["doc_id", "text", "fp", "key"]
    assert kept.count() == 3
