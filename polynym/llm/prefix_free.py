"""Removal of repeated strings, by prefix-free parsing.

Every window of ``length`` bytes picks the lowest rolling hash of its 24-byte
grams as its trigger. Windows that pick one trigger follow each other, and the
text they cover is a phrase. Equal windows pick equal triggers at equal places,
so equal windows lie in phrases with one trigger.

1. Phrases are grouped by trigger and content. All but the first occurrence of
   a phrase, in corpus order, repeat earlier text throughout. This is the
   dictionary with the parse's first occurrences.
2. Only first occurrences whose trigger another phrase shares can still hold
   windows that occur elsewhere. Their windows, i.e. suffixes of the dictionary
   cut at ``length`` bytes, are taken eight at a time, in steps counted from the
   trigger. The bytes that all eight share are hashed, the seven on either side
   are kept as they are. Blocks are sorted by this content; again the later of
   equal blocks repeat throughout.
3. Windows of blocks that share their middle but not their sides are sorted by
   content and then by place; all but the first in each class repeat.
4. Windows that repeat cover the bytes to remove.

The order within a class is the corpus order; classes themselves are ordered by
key, not by alphabet, since only equality decides here. Texts that have to meet
their runs are shuffled compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polynym.operators.materialize import materialize

Batches = Iterator[pa.RecordBatch]

GRAM = 24
PIECE_BITS = 20  # positions in a piece that is hashed at once
PAD = 256
STEP = 8  # windows in a block
SIDE = np.uint64((1 << 8 * (STEP - 1)) - 1)
LAST = (1 << 63) - 1
# Odd multipliers of the hash.
M1, M2, M3, M4, M5 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _mix(x: np.ndarray) -> np.ndarray:
    x *= M1
    x ^= x >> np.uint64(32)
    return x


def _grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 8 and 16 bytes from each position of a padded buffer."""
    words = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    h8 = _mix(words ^ (words >> np.uint64(29)))
    return h8, _mix(h8[:-8] * M2 + h8[8:])


def _window_hash(h16: np.ndarray, at: np.ndarray, length: int, by: np.uint64) -> np.ndarray:
    """64 bits for the ``length`` bytes from each position in ``at``."""
    out = h16[at] * by
    for k in [*range(16, length - 15, 16), length - 16]:
        out = _mix(out * by + h16[at + k])
        out ^= out >> np.uint64(29)
    return out


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _joined(texts: list[bytes], front: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """One padded buffer, and where each text starts in it."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    buf = np.frombuffer(bytearray(front) + bytearray(b"".join(texts)) + bytearray(PAD), dtype=np.uint8)
    return buf, np.cumsum(sizes) - sizes + front


def _pieces(rows: list[int], texts: list[bytes], length: int, limit: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(row, offset, bytes) in groups of ``limit`` bytes at most; long texts are cut so that each window is in one piece."""
    out, size = ([], [], []), 0
    for row, text in zip(rows, texts, strict=True):
        for at in range(0, max(1, len(text) - length + 1), limit - length):
            part = text[at : at + limit - 1] if len(text) > limit else text
            if size + len(part) > limit and out[0]:
                yield out
                out, size = ([], [], []), 0
            for column, value in zip(out, (row, at, part), strict=True):
                column.append(value)
            size += len(part)
            if len(text) <= limit:
                break
    if out[0]:
        yield out


def _phrases(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(piece, start, count, trigger's distance from start, its hash, content) of each run of windows with one trigger."""
    buf, first = _joined(texts)
    h8, h16 = _grams(buf)
    n = len(buf) - PAD
    size = np.diff(np.append(first, n))
    count = np.maximum(size - length + 1, 0)
    starts = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    if not len(starts):
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    gram = _mix(h16[: len(buf) - PAD] * M3 + h8[16 : len(buf) - PAD + 16])
    mask = np.uint64((1 << PIECE_BITS) - 1)
    lowest = _lowest((gram & ~mask) | np.arange(len(gram), dtype=np.uint64), length - GRAM + 1)
    trigger = (lowest[starts] & mask).astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    run = np.diff(np.append(head, len(starts)))
    at, end = starts[head], starts[head] + run - 1
    content = _mix(_window_hash(h16, at, length, M4) * M5 + _window_hash(h16, end, length, M4)) + run.astype(np.uint64)
    piece = np.searchsorted(first, at, side="right") - 1
    return piece, at - first[piece], run, trigger[head] - at, gram[trigger[head]], content


def _merged(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring runs as one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + count)[order]
    if not len(doc):
        return doc, start, end
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(doc)) - 1
    return doc[head], start[head], end[last] - start[head]


KEYED = ["a", "b", "c", "ord", "at"]
KEYED_SCHEMA = "a long, b long, c long, ord long, at long"


def _place(start: np.ndarray, count: np.ndarray, rest: np.ndarray | int = 0) -> np.ndarray:
    """A run in one number: start, count and 7 bits more."""
    return start.astype(np.int64) << 32 | count.astype(np.int64) << 7 | rest


def _unplace(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 32, at >> 7 & ((1 << 25) - 1), at & 127


def _keyed(a: np.ndarray, b: np.ndarray, c: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, rest: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows to sort by content (a, b, c); those that repeat a row of the same batch go as finished runs.

    A finished run has no b, and is dealt by its document.
    """
    order = np.lexsort((start, doc, c, b, a))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1]) & (c[order][1:] == c[order][:-1])
    keep, gone = order[~same], order[same]
    yield pa.RecordBatch.from_arrays([*(pa.array(x[keep].view(np.int64)) for x in (a, b, c)), pa.array(doc[keep]), pa.array(_place(start[keep], count[keep], rest[keep]))], KEYED)
    if len(gone):
        d, s, n = _merged(doc[gone], start[gone], count[gone])
        none = pa.nulls(len(d), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(_mix(d.astype(np.uint64)).view(np.int64)), none, none, pa.array(d), pa.array(_place(s, n))], KEYED)


def phrase_batches(length: int) -> Callable[[Batches], Batches]:
    """(ord, text) to a row for each phrase: trigger, content, none, place."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), [t.as_py() for t in batch.column(1).cast(pa.binary())]
            found = []
            for rows, at, parts in _pieces(list(range(len(texts))), texts, length, 1 << PIECE_BITS):
                piece, start, count, rel, trigger, content = _phrases(parts, length)
                found.append((trigger, content, np.zeros_like(content), ids[np.array(rows)[piece]], start + np.array(at)[piece], count, rel))
            if found:
                yield from _keyed(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return run


def _streamed(batches: Batches, candidates: bool) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Of rows sorted by (a, b, c, ord, at): (columns, sure) of those that count.

    ``sure`` rows are not the first of their content, or were finished before.
    With ``candidates`` the first rows of each content count too, if their a has
    several contents. Only the last row seen is held, however large a group is.
    """
    before: tuple[int, ...] | None = None
    pending: dict[str, np.ndarray] | None = None
    for batch in batches:
        done = batch.column("b").is_null().to_numpy(zero_copy_only=False)
        if done.any():
            gone = batch.filter(pa.array(done))
            yield {n: gone.column(n).to_numpy() for n in ("ord", "at")}, np.ones(len(gone), dtype=bool)
            batch = batch.filter(pa.array(~done))
        if not len(batch):
            continue
        col = {n: batch.column(n).to_numpy() for n in KEYED}
        new_a, new = np.ones(len(batch), dtype=bool), np.ones(len(batch), dtype=bool)
        new_a[1:] = col["a"][1:] != col["a"][:-1]
        new[1:] = new_a[1:] | (col["b"][1:] != col["b"][:-1]) | (col["c"][1:] != col["c"][:-1])
        if before is not None:
            new_a[0] = col["a"][0] != before[0]
            new[0] = new_a[0] or (col["b"][0], col["c"][0]) != before[1:]
        before = col["a"][-1], col["b"][-1], col["c"][-1]
        yield {n: v[~new] for n, v in col.items()}, np.ones(int((~new).sum()), dtype=bool)
        head = np.flatnonzero(new)
        if not candidates or not len(head):
            continue
        opens = new_a[head]
        if not opens[0] and pending is not None:
            yield pending, np.zeros(1, dtype=bool)
        pick = head[~opens | np.append(~opens[1:], False)]
        yield {n: v[pick] for n, v in col.items()}, np.zeros(len(pick), dtype=bool)
        pending = {n: v[head[-1:]] for n, v in col.items()} if opens[-1] else None


RUNS = "ord long, start int, count int, rel int, sure boolean"


def phrase_repeats(batches: Batches) -> Batches:
    """Sorted phrases to runs of windows: those that repeat for sure, and candidates with their trigger's distance."""
    for col, sure in _streamed(batches, True):
        start, count, rel = _unplace(col["at"])
        yield pa.RecordBatch.from_arrays([pa.array(col["ord"], pa.int64()), *(pa.array(x, pa.int32()) for x in (start, count, rel)), pa.array(sure)], ["ord", "start", "count", "rel", "sure"])


def block_batches(length: int) -> Callable[[Batches], Batches]:
    """(ord, compressed text, runs) to a row for each block of windows: hash of the middle, left side, right side, place.

    The left side's last byte holds the first and last window of the block that
    are in the run; bytes that no such window has are zero.
    """

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for k in range(0, len(whole), 512):
                batch = whole.slice(k, 512)
                ids, texts = batch.column(0).to_numpy(), _unpacked(batch.column(1))
                runs = batch.column(2)
                row = np.repeat(np.arange(len(texts)), np.diff(runs.offsets.to_numpy()))
                start, count, rel = (runs.flatten().field(n).to_numpy().astype(np.int64) for n in ("start", "count", "rel"))
                buf, first = _joined(texts, STEP)
                _, h16 = _grams(buf)
                words = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
                low, high = -rel // STEP, (count - 1 - rel) // STEP
                blocks = high - low + 1
                which = np.repeat(np.arange(len(row)), blocks)
                base = (start + rel)[which] + STEP * (low[which] + np.arange(len(which)) - (np.cumsum(blocks) - blocks)[which])
                p, q = np.maximum(start[which] - base, 0), np.minimum((start + count - 1)[which] - base, STEP - 1)
                at = first[row[which]] + base
                middle = _window_hash(h16, at + STEP - 1, length - STEP + 1, M4)
                eight = np.uint64(8)
                left = (words[at] & SIDE) >> (p.astype(np.uint64) * eight) << (p.astype(np.uint64) * eight)
                right = words[at + length] & ((np.uint64(1) << (q.astype(np.uint64) * eight)) - np.uint64(1))
                left |= (p | q << 3).astype(np.uint64) << np.uint64(56)
                yield from _keyed(middle, left, right, ids[row[which]], base + p, q - p + 1, p)

    return run


def block_repeats(batches: Batches) -> Batches:
    """Sorted blocks to finished runs and, of blocks that share their middle only, a row for each window."""
    for col, sure in _streamed(batches, True):
        if not len(sure):
            continue
        start, count, p = _unplace(col["at"])
        none = pa.nulls(int(sure.sum()), pa.int64())
        if sure.any():
            yield pa.RecordBatch.from_arrays([pa.array(_mix(col["ord"][sure].astype(np.uint64)).view(np.int64)), none, none, pa.array(col["ord"][sure]), pa.array(_place(start[sure], count[sure]))], KEYED)
            continue
        which = np.repeat(np.arange(len(start)), count)
        step = np.arange(len(which)) - (np.cumsum(count) - count)[which]
        window = (p[which] + step).astype(np.uint64) * np.uint64(8)
        a, left, right = (col[n][which].view(np.uint64) for n in ("a", "b", "c"))
        left = (left & SIDE) >> window
        right = right & ((np.uint64(1) << window) - np.uint64(1))
        one = _mix(_mix(a + window) * M2 + left)
        two = _mix(_mix(a * M3 + right) * M5 + left + window)
        yield from _keyed(one, two, np.zeros_like(one), col["ord"][which], start[which] + step, np.ones(len(which), dtype=np.int64), np.zeros(len(which), dtype=np.int64))


def window_repeats(batches: Batches) -> Batches:
    for col, sure in _streamed(batches, False):
        d, s, n = _merged(col["ord"], *_unplace(col["at"])[:2])
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int32()), pa.array(n, pa.int32())], ["ord", "start", "count"])


def pack_batches(batches: Batches) -> Batches:
    """Texts compressed for a shuffle: (.., text) to (.., packed)."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        packed = pa.array([pack(t.as_py() or b"") for t in b.column("text").cast(pa.binary())], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed], [*b.schema.names[:-1], "packed"])


def _unpacked(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x.as_py()) for x in column]


def removal_batches(length: int) -> Callable[[Batches], Batches]:
    """(doc_id, compressed text, runs of repeated windows or null) to the text without the bytes they cover."""

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for k in range(0, len(whole), 512):
                batch = whole.slice(k, 512)
                kept, removed, spans = [], [], []
                for data, runs in zip(_unpacked(batch.column(1)), batch.column(2), strict=True):
                    pairs = runs.as_py()
                    if not pairs:
                        kept.append(data)
                        removed.append(0)
                        spans.append([])
                        continue
                    start = np.array([p["start"] for p in pairs], dtype=np.int64)
                    count = np.array([p["count"] for p in pairs], dtype=np.int64)
                    one = np.zeros(len(start), dtype=np.int64)
                    _, a, n = _merged(one, start, count + length - 1)
                    left, at = [], 0
                    for x, m in zip(a.tolist(), n.tolist(), strict=True):
                        left.append(data[at:x])
                        at = x + m
                    kept.append(b"".join([*left, data[at:]]))
                    removed.append(int(n.sum()))
                    spans.append([{"start": x, "size": m} for x, m in zip(a.tolist(), n.tolist(), strict=True)])
                size = [x + len(y) for x, y in zip(removed, kept, strict=True)]
                columns = [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def digest_batches(batches: Batches) -> Batches:
    for b in batches:
        n = pa.array([len(x) for x in b.column("spans")], pa.int64())
        sha = pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in b.column("kept")], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), b.column("n_removed"), n, sha], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(ord, doc_id, text)`` of all rows, and of each document once; ``ord`` orders documents.

    Usually it is the id. If ids are null or repeated, rows are numbered by id
    (nulls last) and the text's hash; rows that repeat both are one document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, known, most = docs.select(F.col(id_col).cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.when(F.col("doc_id").isNotNull(), 1)), F.max("n")).first()
    if n is None or (known == n and most == 1):
        same = rows.select(F.col("doc_id").alias("ord"), "doc_id", "text")
        return same, same
    keyed = rows.select("*", F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.xxhash64("text").alias("_text"))
    numbers = keyed.select("_id", "_text").distinct().repartitionByRange("_id", "_text").sortWithinPartitions("_id", "_text")
    numbers = materialize(numbers.withColumn("ord", F.monotonically_increasing_id()), "order")
    named = keyed.join(numbers, ["_id", "_text"]).select("ord", "doc_id", "text")
    return named, named.dropDuplicates(["ord"])


def repeated_windows(rows: DataFrame, length: int) -> DataFrame:
    """``(ord, start, count)``: runs of ``count`` windows that occur earlier in the corpus."""
    sort = ["a", "b", "c", "ord", "at"]
    dealt = lambda df: df.repartition("a").sortWithinPartitions(*sort)
    phrases = rows.select("ord", "text").mapInArrow(phrase_batches(length), KEYED_SCHEMA)
    runs = materialize(dealt(phrases).mapInArrow(phrase_repeats, RUNS), "phrases")
    some = runs.where(~F.col("sure")).groupBy("ord").agg(F.collect_list(F.struct("start", "count", "rel")).alias("runs"))
    packed = rows.select("ord", "text").mapInArrow(pack_batches, "ord long, packed binary")
    blocks = packed.join(some, "ord").select("ord", "packed", "runs").mapInArrow(block_batches(length), KEYED_SCHEMA)
    windows = dealt(blocks).mapInArrow(block_repeats, KEYED_SCHEMA)
    again = materialize(dealt(windows).mapInArrow(window_repeats, "ord long, start int, count int"), "windows")
    return runs.where("sure").select("ord", "start", "count").union(again)


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept)``, one row for each row of ``docs``.

    Removes every byte covered by a string of ``length`` bytes that also starts
    earlier: in a document before this one, or in this one at an earlier place.
    Strings are compared on the input; overlaps count; matches never cross
    documents. Null text is empty. Without ids, or with repeated ones, documents
    are ordered as ``_ordered`` says. Other columns are not read.
    """
    return _removed(docs, length, id_col, text_col, removal_batches(length), "n_bytes long, n_removed long, spans array<struct<start:long,size:long>>, kept binary")


def removal_digests(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``remove_repeats`` with the number of spans and the kept bytes' digest in their place."""
    steps = removal_batches(length)
    return _removed(docs, length, id_col, text_col, lambda b: digest_batches(steps(b)), "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _removed(docs: DataFrame, length: int, id_col: str, text_col: str, steps, schema: str) -> DataFrame:
    if length < GRAM + 16:
        raise ValueError(f"length must be {GRAM + 16} or more")
    rows, once = _ordered(docs, id_col, text_col)
    gone = repeated_windows(once, length).groupBy("ord").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    packed = rows.select("ord", "doc_id", "text").mapInArrow(pack_batches, "ord long, doc_id long, packed binary")
    return packed.join(gone, "ord", "left").select("doc_id", "packed", "runs").mapInArrow(steps, f"doc_id long, {schema}")
