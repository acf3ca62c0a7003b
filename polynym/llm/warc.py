"""WARC archives: writing, reading, and resolving repeated payloads to revisit records.

Archives lie in a folder that the driver and executors share (or any store that
pyarrow's file systems reach by URI). Each record is a gzip member of its own,
so a record is read by its place alone. Files are written under a name of the
attempt's own and moved into place whole, so a task that runs twice does no harm.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polynym.operators.materialize import materialize, shared_dir

Batches = Iterator[pa.RecordBatch]

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Records in one file at most; files of one task follow each other.
FILE_RECORDS = 4000


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n".encode()
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one decompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    headers = {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    size = int(headers["content-length"])
    if rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    return headers, rest[:size]


def members(stream, piece: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, content) of each gzip member, reading ``piece`` bytes at a time."""
    at, rest, z, out, size = 0, b"", zlib.decompressobj(31), [], 0
    while True:
        data = rest or stream.read(piece)
        rest = b""
        if not data:
            if size:
                raise ValueError("archive ends inside a record")
            return
        out.append(z.decompress(data))
        size += len(data)
        if z.eof:
            rest = z.unused_data
            size -= len(rest)
            yield at, size, b"".join(out)
            at, z, out, size = at + size, zlib.decompressobj(31), [], 0


class _Writer:
    """Writes records to numbered files of one task."""

    def __init__(self, folder: str):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.records, self.stream, self.names = 0, None, []

    def add(self, data: bytes) -> None:
        if self.stream is None or self.records == FILE_RECORDS:
            self.close()
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.stream, self.records = self.fs.open_output_stream(f"{self.folder}/.{self.name}.part", compression=None), 0
        self.stream.write(data)
        self.records += 1

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.fs.move(f"{self.folder}/.{self.name}.part", f"{self.folder}/{self.name}")
            self.names.append(self.name)
            self.stream = None


def _uuid(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16])}>"


def _safe(value: str) -> str:
    """A URI on one line; escapes that it has stay as they are."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _id(value: object) -> str:
    """An id on one line; ``unquote`` gives it back."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _response(page_id, uri: str, payload: bytes, digest: str) -> bytes:
    block = HTTP % len(payload) + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", _uuid("response", page_id, uri, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-ID", _id(page_id)))
    return record(headers, block)


def _new_folder(spark: SparkSession, label: str) -> str:
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    return folder


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a response record for each row; returns the written ``(folder, file)``, one row per file.

    A null ``html`` is an empty payload, a null ``url`` an empty one; a null
    ``page_id`` is left out of the headers.
    """

    def run(batches: Batches) -> Batches:
        out = _Writer(folder)
        for b in batches:
            for i, url, html in zip(b.column(0), b.column(1), b.column(2).cast(pa.binary()), strict=True):
                payload = html.as_py() or b""
                out.add(_response(i.as_py(), _safe(url.as_py() or ""), payload, hashlib.sha256(payload).hexdigest()))
        out.close()
        if out.names:
            yield pa.RecordBatch.from_arrays([pa.array([folder] * len(out.names)), pa.array(out.names)], ["folder", "file"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return materialize(rows.mapInArrow(run, "folder string, file string"), "warc-files")


def _by_file(rows: DataFrame, files: int) -> DataFrame:
    """``rows`` dealt out by file, in so many partitions that most hold one file; a number given is not merged by adaptive execution."""
    return rows.repartition(max(1, 2 * files), "file")


def _headers(name: str, at: int, size: int, h: dict[str, str], number: bool) -> tuple:
    page = h.get("x-page-id")
    refers = h.get("x-refers-to-page-id")
    cast = (lambda v: int(v) if v is not None else None) if number else (lambda v: unquote(v) if v is not None else None)
    return name, at, size, h["warc-type"], h["warc-record-id"], h.get("warc-target-uri", ""), cast(page), h["warc-payload-digest"].removeprefix("sha256:"), int(h["x-payload-length"]), cast(refers)


def read_headers(files: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The headers of every record in ``files``; payloads are checked against their digests and left behind."""
    number = id_type in ("bigint", "int", "smallint", "tinyint")
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64() if number else pa.string(), pa.string(), pa.int64(), pa.int64() if number else pa.string()]
    names = ["file", "offset", "size", "type", "record_id", "uri", "page_id", "digest", "length", "refers_to"]

    def run(batches: Batches) -> Batches:
        for b in batches:
            for folder, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files_at, path = fs.FileSystem.from_uri(f"{folder}/{name}")
                rows: list[tuple] = []
                with files_at.open_input_stream(path, compression=None) as stream:
                    for at, size, data in members(stream):
                        h, block = parse(data)
                        row = _headers(name, at, size, h, number)
                        if row[3] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            if len(payload) != row[8] or hashlib.sha256(payload).hexdigest() != row[7]:
                                raise ValueError(f"payload of {row[4]} does not match its digest")
                        rows.append(row)
                        if len(rows) == FILE_RECORDS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kind = "bigint" if number else "string"
    spread = _by_file(files, files.count())
    return spread.mapInArrow(run, f"file string, offset long, size long, type string, record_id string, uri string, page_id {kind}, digest string, length long, refers_to {kind}")


def resolve(headers: DataFrame, least: int = 100) -> DataFrame:
    """For each record ``(file, offset, size, original)``: the original response's headers, or null if it stays a response.

    Records with one payload digest and at least ``least`` payload bytes revisit
    the one with the smallest page id (nulls last; among equal ids, by place).
    Only headers are shuffled. The smallest is found with map-side combine, and
    joined back by a join that adaptive execution may split.
    """
    own = F.struct(F.col("page_id").isNull().alias("late"), "page_id", "file", "offset", "record_id", "uri")
    large = headers.where(F.col("length") >= least)
    first = large.groupBy("digest").agg(F.min(own).alias("first"))
    joined = headers.join(first, "digest", "left")
    revisit = (F.col("length") >= least) & ((F.col("file") != F.col("first.file")) | (F.col("offset") != F.col("first.offset")))
    return joined.select("file", "offset", "size", F.when(revisit, F.struct("first.page_id", "first.record_id", "first.uri")).alias("original"))


def write_resolved(source: str, decisions: DataFrame, folder: str, files: int) -> DataFrame:
    """Write the records of ``files`` archives again with fresh headers: responses whole, revisits without payload."""

    def run(batches: Batches) -> Batches:
        out, opened, stream = _Writer(folder), None, None
        for b in batches:
            for name, at, size, original in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if name != opened:
                    files_at, path = fs.FileSystem.from_uri(f"{source}/{name}")
                    stream, opened = files_at.open_input_file(path), name
                h, block = parse(zlib.decompress(stream.read_at(size, at), 31))
                if original is None:
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    out.add(_response(unquote(h["x-page-id"]) if "x-page-id" in h else None, h.get("warc-target-uri", ""), payload, h["warc-payload-digest"].removeprefix("sha256:")))
                    continue
                headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", _uuid("revisit", h["warc-record-id"], name, at)), ("WARC-Date", DATE), ("WARC-Target-URI", h.get("warc-target-uri", "")), ("WARC-Profile", PROFILE), ("WARC-Refers-To", original["record_id"]), ("WARC-Refers-To-Target-URI", original["uri"]), ("WARC-Payload-Digest", h["warc-payload-digest"]), ("X-Payload-Length", h["x-payload-length"]), ("Content-Type", "application/http; msgtype=response")]
                headers += [("X-Page-ID", h["x-page-id"])] if "x-page-id" in h else []
                headers += [("X-Refers-To-Page-ID", _id(original["page_id"]))] if original["page_id"] is not None else []
                out.add(record(headers, HTTP % int(h["x-payload-length"])))
        out.close()
        if out.names:
            yield pa.RecordBatch.from_arrays([pa.array([folder] * len(out.names)), pa.array(out.names)], ["folder", "file"])

    # A file has FILE_RECORDS records at most, so a piece of work is bounded and in the order of its places.
    placed = _by_file(decisions, files).sortWithinPartitions("file", "offset")
    return materialize(placed.mapInArrow(run, "folder string, file string"), "warc-files")


def dedup_archives(pages: DataFrame, least: int = 100) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html), deduplicated, read back: one row per page.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to, file)``.
    Null html is an empty payload; payloads under ``least`` bytes are never
    revisits; repeated page ids are resolved by place; an empty table gives an
    empty result; other columns are not read.
    """
    spark = pages.sparkSession
    kind = dict(pages.dtypes)["page_id"]
    raw, fresh = _new_folder(spark, "warc"), _new_folder(spark, "warc-resolved")
    written = write_archives(pages, raw)
    headers = materialize(read_headers(written, kind), "warc-headers")
    found = read_headers(write_resolved(raw, resolve(headers, least), fresh, written.count()), kind)
    return found.select(F.col("page_id").cast(kind), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").cast(kind), "file")


def oracle(least: int, table: str = "pages") -> str:
    """DuckDB SQL for the same rows of ``dedup_archives`` but ``file``, for ids that are not null and not repeated."""
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM {table}),
f AS (SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= {least} GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.original <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.original <> p.page_id THEN f.original END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND p.payload_bytes >= {least}"""
