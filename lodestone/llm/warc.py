"""WARC archives: a writer, and a reader that salvages what it can from damaged ones.

Writing: a gzip member a record, archives of bounded size in a folder that driver and executors share. Of records with
equal payloads of at least ``least`` bytes, that of the smallest page_id is a response and the others are revisits.
A manifest row an archive is itself a table: a retried task writes archives under new names, and only those in the
manifest are read.

Reading: each record is checked (header, length, payload digest). After a failed check the reader searches for the
next gzip member that begins with a WARC version line (or, uncompressed, the next such line), goes on from there, and
logs the bytes between as a quarantined gap.

Defined cases: null html is an empty payload; payloads under ``least`` bytes are responses; rows that repeat a
page_id with the same payload are the same page, so each is a response where that id is the smallest; a null page_id
comes after all others; an empty table gives an empty archive; other columns are left out.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, new_path, ship

ROLL = 8 << 20
VERSION = b"WARC/1."
RECORD = "archive string, at long, record_type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
GAP = "archive string, gap_start long, gap_end long, reason string"


# ---- one record -----------------------------------------------------------------------------------------------


def urn(page_id) -> str:
    return f"<urn:lodestone:page:{'' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    tail = (value or "").rpartition(":")[2].rstrip(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def record(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if revisit:
        lines += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(raw: bytes) -> tuple[dict, int]:
    """(fields, bytes of the record) of the record at the start of raw; ValueError if a check fails."""
    if not raw.startswith(VERSION):
        raise ValueError("no version line")
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("header without end")
    fields: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isdigit():
        raise ValueError("no content length")
    n = int(size)
    if len(rest) < n:
        raise ValueError("block is cut short")
    if rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("no end of record")
    block, kind = rest[:n], fields.get("warc-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind != "revisit" and digest and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload digest differs")
    size = fields.get("x-payload-length", "")
    return {"record_type": kind, "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "payload_digest": digest or hashlib.sha256(payload).hexdigest(), "payload_bytes": int(size) if size.isdigit() else len(payload), "payload": payload}, len(head) + 4 + n + 4


BLOCK, PIECE = 1 << 20, 1 << 14


class Bytes:
    """A file read by blocks, at any place: an archive is never held whole."""

    def __init__(self, file) -> None:
        self.file, self.size, self.low, self.block = file, file.size(), 0, b""

    def get(self, at: int, n: int) -> memoryview:
        """The n bytes at ``at``, fewer at the end of the file."""
        if at < self.low or at + n > self.low + len(self.block) and self.low + len(self.block) < self.size:
            self.low, self.block = at, self.file.read_at(min(max(n, BLOCK), max(0, self.size - at)), at)
        return memoryview(self.block)[at - self.low : at - self.low + n]


def inflate(data: Bytes, at: int) -> tuple[bytes, int]:
    """(content, bytes taken) of the gzip member at ``at``; what follows it is read by no more than a piece."""
    z, out, to = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            piece = data.get(to, PIECE)
            if not piece:
                raise ValueError("gzip member is cut short")
            out.append(z.decompress(piece))
            to += len(piece)
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from e
    return b"".join(out), to - len(z.unused_data) - at


def starts_record(data: Bytes, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data.get(at, 4096), len(VERSION)).startswith(VERSION)
    except zlib.error:
        return False


def next_start(data: Bytes, at: int) -> int:
    """Where the next member with a version line, or bare version line, begins (the size of data: nowhere)."""
    first = at
    while at < data.size:
        block = bytes(data.get(at, PIECE + 16))  # pieces overlap by more than a mark is long
        found = sorted((at + m.start(), m[0]) for m in _MARK.finditer(block) if m.start() < PIECE)
        for place, mark in found:
            if mark == VERSION and (place in (0, first) or bytes(data.get(place - 1, 1)) == b"\n"):
                return place
            if mark != VERSION and starts_record(data, place):
                return place
        at += PIECE
    return data.size


_MARK = re.compile(rb"\x1f\x8b\x08|" + re.escape(VERSION))


def salvage(file):
    """('record', offset, fields) for each sound record and ('gap', start, end, reason) for each stretch that isn't.

    ``file``: bytes, or an Arrow file with read_at(). Time grows with the file's size, whatever its members are.
    """
    data = Bytes(pa.BufferReader(file) if isinstance(file, bytes) else file)
    at = 0
    while at < data.size:
        try:
            if bytes(data.get(at, 2)) == b"\x1f\x8b":
                raw, size = inflate(data, at)
                fields, used = parse(raw)
                if used != len(raw):
                    raise ValueError("more than a record in a member")
            else:
                fields, size = parse(bare_record(data, at))
            yield "record", at, fields
            at += size
        except ValueError as e:
            end = next_start(data, at + 1)
            yield "gap", at, end, str(e)
            at = end


def bare_record(data: Bytes, at: int) -> bytes:
    """The uncompressed record at ``at``, or its header where the length can't be told."""
    n = PIECE
    while (end := bytes(data.get(at, n)).find(b"\r\n\r\n")) < 0:
        if n >= BLOCK or at + n >= data.size or not bytes(data.get(at, len(VERSION))).startswith(VERSION):
            raise ValueError("header without end")
        n *= 2
    head = bytes(data.get(at, end + 4))
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            size = end + 4 + int(value) + 4
            if at + size > data.size:
                raise ValueError("block is cut short")
            return bytes(data.get(at, size))
    return head


# ---- tables ---------------------------------------------------------------------------------------------------


def plan_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """pages as (page_id, url, html, digest, refers_to): refers_to is null for responses."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size"))
    first = rows.where(F.col("size") >= least).groupBy(F.col("digest").alias("same")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, rows.digest == F.col("same"), "left").select("page_id", "url", "html", "digest", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(planned: DataFrame, roll: int = ROLL) -> DataFrame:
    """Writes the archives of (page_id, url, html, digest, refers_to); the manifest (archive, bytes, records)."""
    spark = planned.sparkSession
    ship(spark)
    top = new_path(spark, "warc")

    def write(batches):
        store, base = pafs.FileSystem.from_uri(top)
        store.create_dir(base, recursive=True)
        held, size, made = [], 0, []

        def close():
            nonlocal held, size
            name = f"{base}/{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(name, compression=None) as f:
                f.write(b"".join(held))
            made.append((os.path.basename(name), size, len(held)))
            held, size = [], 0

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = member(record(page_id, url, (html or "").encode(), digest, refers_to, refers_to is not None))
                held.append(raw)
                size += len(raw)
                if size >= roll:
                    close()
        if held:
            close()
        if made:
            a, b, c = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([f"{top}/{x}" for x in a]), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["archive", "bytes", "records"])

    return Table(planned.mapInArrow(write, "archive string, bytes long, records long"), "manifest").df


def _read(archives: DataFrame, schema: str, pick) -> DataFrame:
    spark = archives.sparkSession
    ship(spark)
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = pafs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with store.open_input_file(path) as f:
                    for found in salvage(f):
                        if (row := pick(uri, found)) is not None:
                            rows.append(row)
                            size += len(row[-1] or b"")
                            if len(rows) >= 2000 or size >= 4 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                                rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select("archive").repartition(max(1, spark.sparkContext.defaultParallelism * 2)).mapInArrow(read, schema)


def read_records(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The sound records of (archive): RECORD's columns; payload=False leaves the payloads null."""

    def pick(uri, found):
        if found[0] == "record":
            _, at, x = found
            return uri, at, x["record_type"], x["record_id"], x["uri"], x["refers_to"], x["payload_digest"], x["payload_bytes"], x["payload"] if payload else None

    return _read(archives, RECORD, pick)


def read_gaps(archives: DataFrame) -> DataFrame:
    """The quarantined byte gaps of (archive)."""
    return _read(archives, GAP, lambda uri, found: (uri, *found[1:]) if found[0] == "gap" else None)


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from the archives of pages."""
    number = lambda c: F.regexp_extract(c, r":(-?\d+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    got = read_records(write_archives(plan_revisits(pages, least)), payload=False)
    return got.select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", as_id("refers_to")).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
