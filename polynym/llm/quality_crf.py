"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; what a line looks like, what its neighbours look
like, and whether its neighbour is good decide together. Forward-backward gives
each line's probability of being good, and the mean over lines, weighted by
their length, is the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]

#: A class for each byte: letters (and all beyond ASCII), capitals, digits, space, sentence marks, exclamations, symbols.
LETTER, CAPITAL, DIGIT, BLANK, MARK, SHOUT, SYMBOL = b"a", b"A", b"0", b" ", b".", b"!", b"#"


def _class_of(byte: int) -> bytes:
    c = chr(byte)
    if byte >= 128 or "a" <= c <= "z":
        return LETTER
    if "A" <= c <= "Z":
        return CAPITAL
    if c.isdigit():
        return DIGIT
    if c.isspace() or byte < 32:
        return BLANK
    return MARK if c in ".,;:'\"()-" else SHOUT if c in "!?" else SYMBOL


CLASSES = b"".join(_class_of(i) for i in range(256))
FEATURES = ("long", "word_length", "capitals", "digits", "marks", "shouts", "symbols", "repeats", "variety", "ends", "begins", "blank")
NF = len(FEATURES)


def line_features(line: bytes) -> tuple[float, ...]:
    """What one line looks like, each between 0 and 1."""
    n = len(line)
    if not n or line.isspace():
        return (0.0,) * (NF - 1) + (1.0,)
    kinds = line.translate(CLASSES)
    words = line.split()
    k = len(words)
    capitals = kinds.count(CAPITAL)
    letters = kinds.count(LETTER) + capitals
    repeats = sum(map(eq, words[1:], words)) / (k - 1) if k > 1 else 0.0
    return (
        min(1.0, n.bit_length() / 16),
        min(1.0, n / k / 32),
        capitals / letters if letters else 0.0,
        kinds.count(DIGIT) / n,
        min(1.0, kinds.count(MARK) / k),
        min(1.0, kinds.count(SHOUT) / k),
        min(1.0, kinds.count(SYMBOL) / k),
        repeats,
        len(set(words)) / k,
        float(kinds.rstrip()[-1:] in (MARK, SHOUT)),
        float(kinds.lstrip()[:1] == CAPITAL),
        0.0,
    )


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, the previous line's, the next line's, and flags of the text's ends; ``first`` marks first lines."""
    n = len(own)
    last = np.append(first[1:], True)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    after[:-1] = own[1:]
    before[first], after[last] = 0, 0
    return np.hstack([own, before, after, first.reshape(n, 1), last.reshape(n, 1), np.ones((n, 1))]).astype(np.float64)


@dataclass
class Model:
    """Weights of a good line's features, and of the transitions bad-bad, bad-good, good-bad, good-good."""

    weights: np.ndarray
    transitions: np.ndarray

    def marginals(self, unary: np.ndarray) -> list[float]:
        """The probability that each line of one document is good."""
        p = 1 / (1 + np.exp(-np.clip(unary, -30, 30)))
        good = p.tolist()
        n = len(good)
        if n == 1:
            return good
        bb, bg, gb, gg = np.exp(self.transitions - self.transitions.max()).ravel().tolist()
        forward, g = [], 0.5
        for k, e in enumerate(good):
            x, y = ((1 - g) * bb + g * gb, (1 - g) * bg + g * gg) if k else (1.0, 1.0)
            x, y = x * (1 - e), y * e
            g = y / (x + y)
            forward.append(g)
        out, b = [0.0] * n, 0.5
        for k in range(n - 1, -1, -1):
            f = forward[k]
            out[k] = f * b / (f * b + (1 - f) * (1 - b))
            e = good[k]
            x, y = (1 - b) * (1 - e), b * e
            u, v = x * bb + y * bg, x * gb + y * gg
            b = v / (u + v)
        return out


def train(chains: list[np.ndarray], labels: list[int], rounds: int = 80, step: float = 0.2, l2: float = 2e-4, longest: int = 64) -> Model:
    """Maximum likelihood by gradient ascent (Adam); each line carries its document's label."""
    dim = 3 * NF + 3
    if len(set(labels)) < 2:
        base = 0.0 if not labels else 4.0 if labels[0] else -4.0
        return Model(np.append(np.zeros(dim - 1), base), np.zeros((2, 2)))
    parts = [(c[k : k + longest], y, len(c)) for c, y in zip(chains, labels, strict=True) for k in range(0, len(c), longest)]
    n, size = len(parts), np.array([len(c) for c, *_ in parts])
    x = np.zeros((n, longest, dim))
    for i, (c, *_) in enumerate(parts):
        x[i, : len(c)] = c
    y = np.array([y for _, y, _ in parts])
    mask = np.arange(longest) < size[:, None]
    flat, at = x[mask], np.flatnonzero(mask.ravel())
    # every document counts alike, in however many pieces, and so do its lines
    weight = 1 / np.array([whole for *_, whole in parts])
    rows = np.repeat(np.arange(n), size)
    w, t = np.zeros(dim), np.zeros((2, 2))
    m, v = np.zeros(dim + 4), np.zeros(dim + 4)
    pairs = np.maximum(size - 1, 0)
    for r in range(1, rounds + 1):
        unary = np.zeros(n * longest)
        unary[at] = np.clip(flat @ w, -30, 30)
        unary = unary.reshape(n, longest)
        alpha = np.zeros((longest, n, 2))
        alpha[0, :, 1] = unary[:, 0]
        for k in range(1, longest):
            new = np.logaddexp(alpha[k - 1, :, :1] + t[0], alpha[k - 1, :, 1:] + t[1])
            new[:, 1] += unary[:, k]
            alpha[k] = np.where(mask[:, k : k + 1], new, alpha[k - 1])
        z = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
        beta = np.zeros((n, 2))
        good = np.zeros((n, longest))
        edges = np.zeros((2, 2))
        for k in range(longest - 1, -1, -1):
            live = mask[:, k]
            good[:, k] = np.where(live, np.exp(alpha[k, :, 1] + beta[:, 1] - z), 0)
            if k:
                inner = beta.copy()
                inner[:, 1] += unary[:, k]
                joint = np.exp(alpha[k - 1][:, :, None] + t[None] + inner[:, None, :] - z[:, None, None])
                edges += (joint * (weight * live)[:, None, None]).sum(axis=0)
                beta = np.where(live[:, None], np.stack([np.logaddexp(t[0, 0] + inner[:, 0], t[0, 1] + inner[:, 1]), np.logaddexp(t[1, 0] + inner[:, 0], t[1, 1] + inner[:, 1])], axis=1), beta)
        slope = ((y[rows] - good[mask]) * weight[rows]) @ flat
        seen = np.diag([(pairs * weight)[y == 0].sum(), (pairs * weight)[y == 1].sum()])
        g = np.concatenate([slope, (seen - edges).ravel()]) / len(chains) - l2 * np.concatenate([w, t.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = step * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
        w, t = w + move[:dim], t + move[dim:].reshape(2, 2)
    return Model(w, t)


def _documents(batch: pa.RecordBatch) -> tuple[list[int], list[int], np.ndarray]:
    """Lines in each document, length of each line, and features; an empty text is one empty line."""
    counts, sizes, feats = [], [], []
    for text in batch.column("text").cast(pa.binary()):
        lines = (text.as_py() or b"").split(b"\n")
        counts.append(len(lines))
        sizes += [len(x) + 1 for x in lines]
        feats += map(line_features, lines)
    own = np.array(feats, dtype=np.float64).reshape(-1, NF)
    first = np.zeros(len(own), dtype=bool)
    first[np.cumsum([0, *counts[:-1]])] = True
    return counts, sizes, with_neighbours(own, first)


def feature_batches(batches: Batches) -> Batches:
    """(text, quality) to (features, quality): a document's feature rows as 64-bit floats."""
    for whole in batches:
        for k in range(0, len(whole), 256):
            b = whole.slice(k, 256)
            counts, _, x = _documents(b)
            parts = np.split(x, np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in parts], pa.binary()), b.column("quality")], ["x", "quality"])


def score_batches(model: Model):
    def run(batches: Batches) -> Batches:
        for whole in batches:
            for k in range(0, len(whole), 256):
                b = whole.slice(k, 256)
                counts, sizes, x = _documents(b)
                unary, at, scores = x @ model.weights, 0, []
                for n in counts:
                    p = model.marginals(unary[at : at + n])
                    length = sizes[at : at + n]
                    scores.append(min(1.0, max(0.0, sum(a * c for a, c in zip(p, length, strict=True)) / sum(length))))
                    at += n
                out = [b.column(j) for j, name in enumerate(b.schema.names) if name != "text"]
                yield pa.RecordBatch.from_arrays([*out, pa.array(scores, pa.float64())], [n for n in b.schema.names if n != "text"] + ["score"])

    return run


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that training never sees: crc32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000) -> Model:
    """A model from at most ``sample`` labelled documents that aren't held out.

    The documents are those whose id hashes lowest, so the choice is the same on
    every run. A document labelled more than once takes the mean, rounded.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.round(F.avg("quality")).cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # The chosen ids are at most `sample` rows, so broadcasting them is bounded; of rows that share an id, one is taken.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).select("text", "quality")
    got = rows.mapInArrow(feature_batches, "x binary, quality int").collect()
    return train([np.frombuffer(r.x).reshape(-1, 3 * NF + 3) for r in got], [r.quality for r in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)``, one row for each row of ``docs``; null and empty texts are one empty line."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score_batches(model), f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 2000) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row for each row of ``docs``.

    Only texts enter a score. Null ids are scored and count as not held out;
    repeated rows are scored alike; without labels of both kinds the score is a
    constant. Other columns are not read.
    """
    found = score(docs, fit(docs, labels, sample))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 2000) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    model = fit(docs, labels, sample)

    def run(batches: Batches) -> Batches:
        for b in batches:
            texts = pa.RecordBatch.from_arrays([b.column("text").cast(pa.string())], ["text"])
            scores = pa.concat_arrays([x.column("score") for x in score_batches(model)(iter([texts]))]) if len(b) else pa.array([], pa.float64())
            yield b.filter(pa.array(scores.to_numpy() >= threshold))

    return docs.mapInArrow(run, docs.schema)
