"""MPEG transport streams: bytes are muxed as 8-bit samples, and streams are parsed back.

Writing: a payload becomes access units of ``UNIT`` samples, each an elementary
packet with its presentation time, cut into 188-byte packets. Program tables
stand before every random-access point. Reading: program tables give the
elementary stream, continuity counters are checked, elementary packets are
reassembled, and their times are stored with the random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]

# Fixed values of the transport stream format.
PACKET, SYNC, PAT_PID = 188, 0x47, 0
PRIVATE_STREAM, PRIVATE_TYPE, CLOCK = 0xBD, 0x06, 90_000
# Our stream's own choices.
PROGRAM, PMT_PID, ES_PID = 1, 0x100, 0x101
BLOCK = 192  # payloads are padded to a multiple of this
UNIT = 64 * BLOCK  # samples in an access unit
RATE = 8_000  # samples a second
RAP_EVERY = 4  # access units from one random-access point to the next


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


PAT = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0"))


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def pad(data: bytes) -> bytes:
    """``data`` and spaces, up to a positive multiple of ``BLOCK`` bytes."""
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b" ")


def mux(payload: bytes) -> bytes:
    """The transport stream of one payload."""
    out, cc, tables = [], 0, 0
    for n, at in enumerate(range(0, len(payload), UNIT)):
        unit, rap, pts = payload[at : at + UNIT], n % RAP_EVERY == 0, at * CLOCK // RATE % (1 << 33)
        if rap:
            out += [p[:3] + bytes([0x10 | tables & 15]) + p[4:] for p in (PAT, PMT)]
            tables += 1
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, pts) + unit
        clock = bytes([0x40 * rap | 0x10]) + (pts << 15 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 4 - 1 - len(clock)
        first, rest = pes[:room], pes[room:]
        clock = clock.ljust(PACKET - 5 - len(first), b"\xff")
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 255, 0x30 | cc & 15, len(clock)]) + clock + first)
        full, tail = divmod(len(rest), PACKET - 4)
        if full:
            packets = np.empty((full, PACKET), dtype=np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
            packets[:, 3] = 0x10 | (cc + 1 + np.arange(full)) & 15
            packets[:, 4:] = np.frombuffer(rest, dtype=np.uint8, count=full * (PACKET - 4)).reshape(full, PACKET - 4)
            out.append(packets.tobytes())
        if tail:
            fill = PACKET - 5 - tail
            field = (b"\0" if fill else b"").ljust(fill, b"\xff")
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 255, 0x30 | cc + 1 + full & 15, fill]) + field + rest[len(rest) - tail :])
        cc = cc + 1 + full + bool(tail) & 15
    return b"".join(out)


@dataclass
class Parsed:
    """One elementary stream read back; the arrays have an element for each elementary packet.

    ``damaged`` marks packets that end early, because transport packets were lost;
    what arrived of them before the loss is in ``payload``. ``streams`` lists
    (program, pid, type) of all elementary streams that the tables name.
    """

    payload: bytes
    program: int
    pid: int
    stream_type: int
    packets: int
    continuity_errors: int
    pts: np.ndarray
    offset: np.ndarray
    random_access: np.ndarray
    damaged: np.ndarray
    streams: list[tuple[int, int, int]]


def _sections(rows: np.ndarray, start: np.ndarray, begins: np.ndarray, breaks: np.ndarray) -> Iterator[bytes]:
    """Whole sections with a right checksum; they may run over several packets, and several may share one."""
    lost = set(breaks.tolist())
    buffer: bytes | None = None
    for k, (row, at, begin) in enumerate(zip(rows, start.tolist(), begins.tolist(), strict=True)):
        data = row[at:].tobytes()
        if k in lost:
            buffer = None
        parts = [(buffer, data)]
        if begin:
            pointer = data[0] + 1 if data else 1
            parts = [(buffer, data[1:pointer]), (b"", data[pointer:])]
        for held, more in parts:
            buffer = None if held is None else held + more
            while buffer and len(buffer) >= 3 and buffer[0] != 0xFF:
                size = 3 + ((buffer[1] & 15) << 8 | buffer[2])
                if len(buffer) < size:
                    break
                if crc32_mpeg(buffer[:size]) == 0:
                    yield buffer[:size]
                buffer = buffer[size:]
            if buffer and buffer[0] == 0xFF:  # what follows is filling
                buffer = None


def _continuous(rows: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For the packets of one pid: (those that do not repeat the one before, breaks, errors).

    A break stands before a packet, of those that stay, that does not continue
    the counter; it is an error unless the packet is flagged as discontinuous.
    """
    keep = np.ones(len(rows), dtype=bool)
    alike = np.flatnonzero((rows[1:, 3] == rows[:-1, 3]) & (start[1:] == start[:-1])) + 1
    for k in alike.tolist():  # a repeated packet may differ in its clock only
        keep[k] = (rows[k, start[k] :] != rows[k - 1, start[k] :]).any() or (rows[k, 1:3] != rows[k - 1, 1:3]).any()
    left = rows[keep]
    counter = left[:, 3] & 15
    breaks = np.flatnonzero(((counter[1:] - counter[:-1]) & 15) != 1) + 1
    told = ((left[breaks, 3] & 0x20) > 0) & (left[breaks, 4] > 0) & ((left[breaks, 5] & 0x80) > 0)
    return keep, breaks, int((~told).sum())


def demux(stream: bytes, program: int | None = None, pid: int | None = None) -> Parsed:
    """Parse a transport stream, which must begin on a packet; of its elementary streams, read the first.

    ``program`` and ``pid`` choose another. Repeated packets are dropped. A lost
    packet ends the elementary packet it belongs to: that one is marked as
    damaged, and no byte of another takes the place of what is missing.
    """
    if len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(stream, dtype=np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pids = (p[:, 1] & 0x1F).astype(np.int32) << 8 | p[:, 2]
    carries = (p[:, 3] & 0x10) > 0
    starts = np.minimum(4 + np.where((p[:, 3] & 0x20) > 0, p[:, 4].astype(np.int32) + 1, 0), PACKET)

    def packets(wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(packets, starts of their data, whether a unit begins, breaks, errors) of one pid."""
        mine = (pids == wanted) & carries
        rows, start = p[mine], starts[mine]
        keep, breaks, errors = _continuous(rows, start)
        rows, start = rows[keep], start[keep]
        return rows, start, (rows[:, 1] & 0x40) > 0, breaks, errors

    def table(wanted: int, kind: int, number: int | None = None) -> tuple[bytes, int]:
        *found, errors = packets(wanted)
        for s in _sections(*found):
            if s[0] == kind and number in (None, int.from_bytes(s[3:5], "big")):
                return s, errors
        raise ValueError(f"no table {kind}")

    pat, errors = table(PAT_PID, 0)
    programs = [(n, int.from_bytes(pat[k + 2 : k + 4], "big") & 0x1FFF) for k in range(8, len(pat) - 4, 4) if (n := int.from_bytes(pat[k : k + 2], "big"))]
    streams: list[tuple[int, int, int]] = []
    for number, pmt_pid in programs:
        pmt, more = table(pmt_pid, 2, number)
        errors += more
        at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
        while at < len(pmt) - 4:
            streams.append((number, int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF, pmt[at]))
            at += 5 + ((pmt[at + 3] & 15) << 8 | pmt[at + 4])
    chosen = next((s for s in streams if program in (None, s[0]) and pid in (None, s[1])), None)
    if chosen is None:
        raise ValueError("no such elementary stream")
    rows, start, begins, breaks, more = packets(chosen[1])
    size = PACKET - start
    data = rows[np.arange(PACKET) >= start[:, None]].tobytes()
    place = np.append(0, np.cumsum(size))
    heads = np.flatnonzero(begins)
    until = np.append(heads[1:], len(rows)) if len(heads) else heads
    # A unit ends before the first break in it.
    stop = np.minimum(until, np.append(breaks, len(rows))[np.searchsorted(breaks, heads + 1)])
    access = ((rows[heads, 3] & 0x20) > 0) & (rows[heads, 4] > 0) & ((rows[heads, 5] & 0x40) > 0)
    parts, pts, damaged = [], [], []
    for a, b, whole in zip(place[heads].tolist(), place[stop].tolist(), (stop == until).tolist(), strict=True):
        unit = data[a:b]
        if unit[:3] != b"\0\0\1":
            raise ValueError("no elementary packet where one should start")
        if len(unit) < 9 or len(unit) < 9 + unit[8]:
            parts.append(b"")
            pts.append(-1)
            damaged.append(True)
            continue
        t = unit[9:14] if unit[7] & 0x80 else None
        pts.append(-1 if t is None else (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
        length = int.from_bytes(unit[4:6], "big")
        parts.append(unit[9 + unit[8] : 6 + length if length else None])
        damaged.append(len(unit) < 6 + length if length else not whole)
    lengths = np.array([len(x) for x in parts], dtype=np.int64)
    return Parsed(b"".join(parts), chosen[0], chosen[1], chosen[2], len(p), errors + more, np.array(pts, dtype=np.int64), np.cumsum(lengths) - lengths, access, np.array(damaged, dtype=bool), streams)


def mux_batches(batches: Batches) -> Batches:
    """(doc_id, text) to (doc_id, n_bytes, media)."""
    for whole in batches:
        for k in range(0, len(whole), 256):
            batch = whole.slice(k, 256)
            raw = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
            media = [mux(pad(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


#: The columns that parsing adds.
PARSED = "payload binary, program int, pid int, stream_type int, packets long, continuity_errors long, pts array<long>, unit_offset array<long>, random_access array<boolean>, damaged array<boolean>"
FOUND = [c.split()[0] for c in PARSED.split(", ")]


def demux_batches(batches: Batches) -> Batches:
    """Adds to (.., media) what parsing finds: payload, program, counters, times and random-access points."""
    for batch in batches:
        found = [demux(x.as_py()) for x in batch.column("media")]
        batch = batch.select([n for n in batch.schema.names if n not in FOUND])
        for name, kind, of in (
            ("payload", pa.binary(), lambda s: s.payload),
            ("program", pa.int32(), lambda s: s.program),
            ("pid", pa.int32(), lambda s: s.pid),
            ("stream_type", pa.int32(), lambda s: s.stream_type),
            ("packets", pa.int64(), lambda s: s.packets),
            ("continuity_errors", pa.int64(), lambda s: s.continuity_errors),
            ("pts", pa.list_(pa.int64()), lambda s: s.pts),
            ("unit_offset", pa.list_(pa.int64()), lambda s: s.offset),
            ("random_access", pa.list_(pa.bool_()), lambda s: s.random_access),
            ("damaged", pa.list_(pa.bool_()), lambda s: s.damaged),
        ):
            batch = batch.append_column(name, pa.array([of(s) for s in found], kind))
        yield batch


def digest_batches(batches: Batches) -> Batches:
    """The stream's digests and features in place of its bytes."""
    for b in batches:
        rows = []
        for media, payload, program, pid, kind, packets, errors, pts, access in zip(*(b.column(n) for n in ("media", "payload", "program", "pid", "stream_type", "packets", "continuity_errors", "pts", "random_access")), strict=True):
            media, payload, pts, access = media.as_py(), payload.as_py(), pts.values.to_numpy(), access.values.to_numpy(zero_copy_only=False)
            level = int(np.frombuffer(payload, dtype=np.uint8).sum(dtype=np.int64)) / len(payload)
            feature = f"program={program};pid={pid};type={kind};packets={packets};pes={len(pts)};pts={pts[0]}-{pts[-1]};rap={','.join(map(str, pts[access]))};cc_errors={errors};mean={level:.6f}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def mux_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text as a transport stream.

    Null and empty texts are 192 spaces. Null and repeated ids are carried
    along; an empty table gives an empty table; other columns are not read.
    """
    rows = _input(docs, id_col, text_col)
    return rows.mapInArrow(mux_batches, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, media binary")


def demux_column(streams: DataFrame) -> DataFrame:
    """``streams`` (with a column ``media``, not null) and what parsing it finds; columns of these names are replaced."""
    schema = "".join(f"`{n}` {t}, " for n, t in streams.dtypes if n not in FOUND)
    return streams.mapInArrow(demux_batches, schema + PARSED)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests and features of each text's stream, parsed from the stored bytes in the same task."""
    rows = _input(docs, id_col, text_col)
    steps: Callable[[Batches], Batches] = lambda b: digest_batches(demux_batches(mux_batches(b)))
    return rows.mapInArrow(steps, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
