import hashlib
import random
import zlib

import pytest

from polynym.llm import transport_stream as M


def test_round_trip_of_every_length():
    rnd = random.Random(5)
    for n in [0, 1, 15, 162, 163, 191, 192, 193, 384, M.UNIT - 1, M.UNIT, M.UNIT + 1, 5 * M.UNIT + 77, 200_000] + [rnd.randint(0, 3000) for _ in range(60)]:
        data = M.pad(rnd.randbytes(n))
        stream = M.mux(data)
        s = M.demux(stream)
        assert s.payload == data and len(stream) % 188 == 0
        assert (s.program, s.pid, s.stream_type, s.continuity_errors) == (1, 0x101, 6, 0)
        assert s.pts.tolist() == [k * M.UNIT * 90000 // 8000 for k in range(len(s.pts))]
        assert s.random_access.tolist() == [k % 4 == 0 for k in range(len(s.pts))]


def test_any_pes_length_fits():
    for n in range(1, 600):
        s = M.mux(b"x" * n)
        assert M.demux(s).payload == b"x" * n


def packets(stream):
    return [stream[k : k + 188] for k in range(0, len(stream), 188)]


def test_lost_packet_damages_its_unit_only():
    data = random.Random(6).randbytes(3 * M.UNIT)
    whole = packets(M.mux(data))
    for k in range(3, len(whole)):
        s = M.demux(b"".join(whole[:k] + whole[k + 1 :]))
        head = whole[k][1] & 0x40 > 0
        # The last packet's loss breaks no counter, but its unit is short; a lost head loses the unit.
        assert s.continuity_errors == (k + 1 < len(whole))
        assert s.damaged.sum() == (not head) and len(s.pts) == 3 - head
        ends = [*s.offset.tolist()[1:], len(s.payload)]
        for at, end, pts, bad in zip(s.offset.tolist(), ends, s.pts.tolist(), s.damaged.tolist(), strict=True):
            true = data[pts * M.RATE // M.CLOCK :][: M.UNIT]
            got = s.payload[at:end]
            assert true.startswith(got) if bad else got == true
    with pytest.raises(ValueError):
        M.demux(b"\0" + b"".join(whole)[1:])


def test_repeated_and_discontinuous_packets():
    data = random.Random(7).randbytes(2 * M.UNIT)
    whole = packets(M.mux(data))
    for k in range(len(whole)):
        s = M.demux(b"".join(whole[: k + 1] + whole[k:]))
        assert s.payload == data and s.continuity_errors == 0 and not s.damaged.any()
    # The second unit's counter starts anew, which its head announces.
    head = next(k for k in range(4, len(whole)) if whole[k][1] & 0x40)
    moved = [x if k < head else x[:3] + bytes([x[3] & 0xF0 | (x[3] + 5) & 15]) + x[4:] for k, x in enumerate(whole)]
    assert M.demux(b"".join(moved)).continuity_errors == 1
    moved[head] = moved[head][:5] + bytes([moved[head][5] | 0x80]) + moved[head][6:]
    s = M.demux(b"".join(moved))
    assert s.continuity_errors == 0 and s.payload == data and not s.damaged.any()


def test_two_programs_and_a_long_section():
    rnd = random.Random(8)
    one, two = rnd.randbytes(30_000), rnd.randbytes(20_000)
    second = [x[:1] + bytes([x[1] & 0xE0 | 0x02, 0x22]) + x[3:] for x in packets(M.mux(two)) if (x[1] & 0x1F, x[2]) == (1, 1)]
    first = [x for x in packets(M.mux(one)) if (x[1] & 0x1F, x[2]) == (1, 1)]
    pat = M._table_packet(0, M._section(0, 1, b"\0\0\xe0\x10" + b"\0\x01\xe1\x00" + b"\0\x02\xe2\x00"))
    # Descriptors of 300 bytes: the section runs over two packets.
    entry = bytes([0x06]) + (0xE101).to_bytes(2, "big") + (0xF000 | 300).to_bytes(2, "big") + rnd.randbytes(300)
    long = M._section(2, 1, (0xE101).to_bytes(2, "big") + b"\xf0\0" + entry + bytes([0x0F, 0xE1, 0x05, 0xF0, 0]))
    pmt1 = [bytes([0x47, 0x41, 0, 0x10, 0]) + long[:183], (bytes([0x47, 0x01, 0, 0x11]) + long[183:]).ljust(188, b"\xff")]
    pmt2 = M._table_packet(0x200, M._section(2, 2, b"\xe2\x22\xf0\0" + bytes([0x06, 0xE2, 0x22, 0xF0, 0])))
    body, queues = [], [first[:], second[:]]
    while any(queues):
        body.append(rnd.choice([q for q in queues if q]).pop(0))
    stream = b"".join([pat, *pmt1, pmt2, *body])
    s = M.demux(stream)
    assert s.payload == one and s.streams == [(1, 0x101, 6), (1, 0x105, 15), (2, 0x222, 6)] and s.continuity_errors == 0
    assert M.demux(stream, program=2).payload == two and M.demux(stream, pid=0x222).program == 2
    with pytest.raises(ValueError):
        M.demux(stream, program=3)


def test_queries(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "é" * 1000, None), (3, "é" * 1000, None), (None, "a", 1), (7, "z" * 300_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media long")
    got = sorted(map(tuple, M.media_digests(docs).collect()), key=str)
    want = []
    for i, t, _ in rows:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted(want, key=str) == sorted((g[:5] for g in got), key=str)
    parsed = M.demux_column(M.mux_column(docs)).collect()
    assert sorted(len(r.payload) for r in parsed) == sorted(w[2] for w in want)
    assert M.media_digests(docs.where("false")).count() == 0
    clash = M.mux_column(docs).selectExpr("*", "'mine' AS payload", "7 AS pid", "'kept' AS other")
    assert {(type(r.payload) is str, r.pid, r.other) for r in M.demux_column(clash).collect()} == {(False, 0x101, "kept")}
