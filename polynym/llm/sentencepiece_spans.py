"""SentencePiece encoding that keeps, for every piece, its bytes in the original text.

Normalisation runs here: the longest prefix of the remaining text that the
model's compiled character map knows is replaced, and every normalised byte
records the original byte at which it began. The sentencepiece library then
segments the normalised text (with its own normaliser switched off), and piece
lengths are projected back through the alignment. Ids equal those of the
library's own ``encode``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
Batches = Iterator[pa.RecordBatch]

# Field numbers and enum values of the model file's protobuf schema.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_TYPE, TYPE_UNKNOWN, TYPE_CONTROL, TYPE_USER, TYPE_BYTE = 1, 3, 2, 3, 4, 6
MODEL_TYPE, MODEL_BPE, SUFFIX_SPACE, BYTE_FALLBACK = 3, 2, 24, 35
CHARSMAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else (4 if kind == 5 else 8, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie of byte strings and their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.values = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest known prefix of ``text[at:]``."""
        units = self.units
        if not units:
            return None
        found, node = None, self._child(units[0])
        for end in range(at, len(text)):
            node ^= text[end]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != text[end]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, end + 1 - at
        if found is None:
            return None
        return self.values[found[0] : self.values.index(b"\0", found[0])], found[1]

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)


class Encoder:
    """Encodes one text at a time: ids and the original byte span of each piece."""

    def __init__(self, model: bytes, cache: int = 300_000):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        trainer, normalizer, texts, kinds = {}, {}, [], []
        for field, value in _fields(model):
            if field == PIECES:
                piece = dict(_fields(value))
                texts.append(bytes(piece.get(PIECE_TEXT, b"")))
                kinds.append(piece.get(PIECE_TYPE, 1))
            elif field == TRAINER:
                trainer |= dict(_fields(value))
            elif field == NORMALIZER:
                normalizer |= dict(_fields(value))
        self.map = CharacterMap(normalizer.get(CHARSMAP, b""))
        self.dummy_prefix = bool(normalizer.get(DUMMY_PREFIX, 1))
        self.remove_spaces = bool(normalizer.get(REMOVE_SPACES, 1))
        self.space = SPACE.encode() if normalizer.get(ESCAPE_SPACES, 1) else b" "
        self.suffix = bool(trainer.get(SUFFIX_SPACE, 0))
        self.user = sorted((t for t, k in zip(texts, kinds, strict=True) if k == TYPE_USER), key=len, reverse=True)
        self.unknown = kinds.index(TYPE_UNKNOWN)
        self.length = np.array([1 if k == TYPE_BYTE else 0 if k == TYPE_CONTROL else len(t) for t, k in zip(texts, kinds, strict=True)], dtype=np.int64)
        # The same pieces with normalisation off; a repeated field of a message is merged into the first.
        off = bytes([CHARSMAP << 3 | 2, 0, DUMMY_PREFIX << 3, 0, REMOVE_SPACES << 3, 0, ESCAPE_SPACES << 3, 0])
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model + bytes([NORMALIZER << 3 | 2, len(off)]) + off)
        inner = any(SPACE in t.decode(errors="replace").lstrip(SPACE) for t, k in zip(texts, kinds, strict=True) if k == 1)
        #: No merge crosses into a word mark, so words can be segmented, and remembered, one by one.
        self.by_word = trainer.get(MODEL_TYPE, 1) == MODEL_BPE and bool(trainer.get(BYTE_FALLBACK, 0)) and not (self.suffix or self.user or inner)
        self.words: dict[str, bytes] = {}  # without their mark
        self.runs: dict[str, bytes] = {}  # with their marks
        self.most = cache
        self.split = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall

    def normalize(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the original byte offset."""
        if not text:
            return b"", np.zeros(1, dtype=np.int64)
        if not (self.map.units or self.remove_spaces or self.user or self.suffix) and len(self.space) == 3:
            width = np.ones(len(text), dtype=np.int64)
            width[np.frombuffer(text, dtype=np.uint8) == 32] = 3
            origin = np.repeat(np.arange(len(text)), width)
            head = 3 * self.dummy_prefix
            return self.space * self.dummy_prefix + text.replace(b" ", self.space), np.concatenate([np.zeros(head, dtype=np.int64), origin, [len(text)]])
        out, origin, at, end = bytearray(), [], 0, len(text)

        def put(piece: bytes) -> None:
            for byte in piece:
                new = self.space if byte == 32 else bytes([byte])
                out.extend(new)
                origin.extend([at] * len(new))

        if self.remove_spaces:
            while at < end and (step := self._prefix(text, at))[0] == b" ":
                at += step[1]
            if at == end:
                return b"", np.array([at])
        if self.dummy_prefix and not self.suffix:
            put(b" ")
        after_space = self.remove_spaces
        while at < end:
            piece, used = self._prefix(text, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece)
                after_space = piece.endswith(b" ")
            at += used
            after_space &= self.remove_spaces
        if self.remove_spaces:
            while out.endswith(self.space):
                del out[-len(self.space) :]
                at = origin[len(out)]
                del origin[len(out) :]
        if self.dummy_prefix and self.suffix:
            put(b" ")
        return bytes(out), np.array([*origin, at])

    def _prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        for symbol in self.user:
            if text.startswith(symbol, at):
                return symbol, len(symbol)
        known = self.map.longest(text, at)
        if known:
            return known
        size = 1 if text[at] < 0xC0 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
        return text[at : at + size], size

    def _segment(self, normal: str) -> np.ndarray:
        if not self.by_word:
            return np.array(self.segmenter.encode(normal, num_threads=1), dtype=np.int32)
        words = normal.split(SPACE)
        if not words[0] and len(words) > 1 and "" not in words[1:]:
            return self._remembered(self.words, words[1:], SPACE)
        return self._remembered(self.runs, self.split(normal), "")

    def _remembered(self, known: dict[str, bytes], words: list[str], mark: str) -> np.ndarray:
        ids = list(map(known.get, words))
        if None in ids:
            if len(known) > self.most:
                known.clear()
            new = list({w for w in words if w not in known})
            for w, found in zip(new, self.segmenter.encode([mark + w for w in new], num_threads=1), strict=True):
                known[w] = np.array(found, dtype=np.int32).tobytes()
            ids = map(known.__getitem__, words)
        return np.frombuffer(b"".join(ids), dtype=np.int32)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each piece starts and ends in the UTF-8 bytes of ``text``.

        A piece made of a replacement only (the word mark put before the text) has an empty span.
        """
        normal, origin = self.normalize(text.encode())
        if not normal:
            return (np.zeros(0, dtype=np.int32),) * 3
        decoded = normal.decode()
        ids = self._segment(decoded)
        if (ids == self.unknown).any():
            sizes = np.array([len(p.encode()) for p in self.segmenter.encode(decoded, out_type=str, num_threads=1)])
        else:
            sizes = self.length[ids]
        end = np.cumsum(sizes)
        if end[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        return ids, origin[end - sizes].astype(np.int32), origin[end].astype(np.int32)


@functools.lru_cache(maxsize=2)
def encoder(model: bytes) -> Encoder:
    """One for each model and Python worker."""
    return Encoder(model)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode_batches(model: bytes, add_eos: bool = True, rows: int = 256) -> Callable[[Batches], Batches]:
    """(doc_id, text) batches to (doc_id, ids, starts, ends) batches."""

    def run(batches: Batches) -> Batches:
        enc = encoder(model)
        eos = enc.library.eos_id() if add_eos else None
        for whole in batches:
            for k in range(0, len(whole), rows):
                batch = whole.slice(k, rows)
                got: list[tuple[np.ndarray, ...]] = []
                for text in batch.column(1):
                    text = text.as_py() or ""
                    ids, starts, ends = enc.encode(text)
                    if eos is not None:
                        end = [len(text.encode())]
                        ids, starts, ends = np.append(ids, eos), np.append(starts, end), np.append(ends, end)
                    got.append((ids, starts, ends))
                columns = [_lists([g[j] for g in got]) for j in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "ids", "starts", "ends"])

    return run


def decode_batches(model: bytes) -> Callable[[Batches], Batches]:
    """Adds ``decoded`` to batches that have ``ids``, by the library's decode."""

    def run(batches: Batches) -> Batches:
        sp = encoder(model).library
        for batch in batches:
            texts = [None if ids is None else sp.decode(ids) for ids in _rows(batch.column("ids"))]
            kept = [n for n in batch.schema.names if n != "decoded"]
            yield batch.select(kept).append_column("decoded", pa.array(texts, pa.string()))

    return run


def _rows(lists: pa.ListArray) -> Iterator[list[int] | None]:
    """Each list, or None for a null one, without a Python object for each Arrow value."""
    flat, ends, known = lists.values.to_numpy(), lists.offsets.to_numpy().tolist(), lists.is_valid().to_pylist()
    return (flat[a:b].tolist() if k else None for a, b, k in zip(ends[:-1], ends[1:], known, strict=True))


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, model_path: str, add_eos: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, starts, ends)``, one row for each row of ``docs``.

    Spans are byte offsets in the UTF-8 text; the end id spans nothing at the
    text's end. Null and empty texts have the end id only. Null or repeated ids
    are carried along; other columns are not read. The model file (half a
    megabyte) is read on the driver and sent with the task.
    """
    model = read_model(model_path)
    rows = _input(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(encode_batches(model, add_eos), f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """``tokens`` (doc_id, ids, ...) with the column ``decoded``, null where ``ids`` is; a column of that name is replaced."""
    schema = "".join(f"`{n}` {t}, " for n, t in tokens.dtypes if n != "decoded") + "decoded string"
    return tokens.mapInArrow(decode_batches(read_model(model_path)), schema)
