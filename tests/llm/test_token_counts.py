import math
import random

import public_tokenizers
import tiktoken

from polynym.llm import token_counts as C


def test_every_limit(spark):
    rnd = random.Random(14)
    lengths = [int(rnd.expovariate(1 / 900)) for _ in range(700)] + [0, 0, 5000, 40_000]
    df = spark.createDataFrame([(n,) for n in lengths], "n_tokens long")
    sums = C.suffix_sums(C.histogram(df))
    for r in sums.collect():
        at_least = [n for n in lengths if n >= r.length]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.total_docs, r.total_tokens) == (lengths.count(r.length), len(at_least), sum(at_least), len(lengths), sum(lengths))
        assert r.truncated_total == sum(min(n, r.length) for n in lengths)
    assert sums.count() == len(set(lengths))
    limits = [0, 1, 17, 512, 1024, 4096, 10**6]
    assert {r["limit"]: (r.docs_over, r.truncated_total) for r in C.at_limits(sums, limits).collect()} == {x: (sum(n > x for n in lengths), sum(min(n, x) for n in lengths)) for x in limits}
    ordered = sorted(lengths)
    assert C.quantiles(sums, [0.1, 0.5, 0.9, 1.0]) == [ordered[max(0, math.ceil(q * len(ordered)) - 1)] for q in (0.1, 0.5, 0.9, 1.0)]
    found = {p: r.length for r in C.with_percentiles(sums).collect() for p in range(r.from_percent, r.to_percent + 1)}
    assert found == {p: ordered[max(0, math.ceil(p * len(ordered) / 100) - 1)] for p in range(1, 101)}
    empty = C.suffix_sums(C.histogram(df.where("false")))
    assert empty.count() == 0 and C.quantiles(empty, [0.5]) == [None]


def test_lengths(spark):
    docs = spark.createDataFrame([(1, "Hello world, hello", 4), (2, None, 5), (3, "", 6), (4, "<|endoftext|> é 漢", 7), (4, "x" * 50_000, 8)], "doc_id long, text string, n_tokens int")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert C.encoded_lengths(docs.where("false"), path, public_tokenizers.PATTERN).count() == 0
    assert {r.text for r in C.encoded_lengths(docs, path, public_tokenizers.PATTERN, ("text", "doc_id")).collect()} == {r.text for r in docs.collect()}
    got = sorted((r.doc_id, r.n_tokens) for r in C.encoded_lengths(docs, path, public_tokenizers.PATTERN, ("doc_id",)).collect())
    with open(path, "rb") as f:
        enc = C._encoding(f.read(), public_tokenizers.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    assert got == sorted((r.doc_id, len(enc.encode_ordinary(r.text or ""))) for r in docs.collect())
