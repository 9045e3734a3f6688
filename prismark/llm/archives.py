"""WARC records in ZIP packages, and a reader that takes ranges only.

A package is a ZIP file of stored (uncompressed) members: `archive/*.warc.gz`
with each record in a gzip member of its own, `indexes/index.cdxj` with a line
per record (kind, offset, length), and `datapackage.json`. The reader finds
them from the end of the file: end record, ZIP64 locator and directory where
present, central directory, then the member's own local header. Records are
read by the index's ranges; nothing is extracted.

Of records with equal payloads of at least `least` bytes, the one with the
smallest id is a `response`; the others are `revisit`s that refer to it and
keep the payload's digest and, in their HTTP header, its length.

Cases: null html counts as empty; rows repeated under one id are each a record,
of the kind that their own payload gives them (equal payloads under the smallest
id are all responses); a null url is written as `urn:none`; rows with a null
page_id are left out; very long payloads are one member each; empty tables give
no packages and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prismark.llm.store import AtomicFile, RangeReader, keyed_join, scratch, small_batches, written

#: Bytes of payload that one package should hold.
PACKAGE_BYTES = 16 << 20
#: Index lines whose records one reading step takes.
STEP_RECORDS = 500
#: Revisits, of some 100 bytes each, that may be broadcast to their pages; more are joined by shuffle.
BROADCAST_ROWS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MANY = 0xFFFFFFFF


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or (payload None) a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {url or 'urn:none'}",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of one record's bytes; header names in lower case."""

    def fields(part: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in part.decode().split("\r\n")[1:])}

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    if len(block) != int(warc["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is not what its header states")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


class PackageWriter:
    """A ZIP file of stored members, each written in one go or in parts.

    zip64: use ZIP64 fields even where 32 bits would do.
    """

    def __init__(self, uri: str, zip64: bool = True):
        self.out, self.zip64 = AtomicFile(uri), zip64
        self.entries: list[tuple[bytes, int, int, int]] = []

    def member(self, name: str, parts: list[bytes]) -> None:
        size, crc, at, raw = sum(map(len, parts)), 0, self.out.position, name.encode()
        for part in parts:
            crc = zlib.crc32(part, crc)
        wide = self.zip64 or size >= MANY
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        short = MANY if wide else size
        self.out.write(LOCAL + struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra)) + raw + extra)
        for part in parts:
            self.out.write(part)
        self.entries.append((raw, crc, size, at))

    def close(self) -> None:
        start = self.out.position
        for raw, crc, size, at in self.entries:
            wide = self.zip64 or max(size, at) >= MANY
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            short = MANY if wide else size
            self.out.write(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, MANY if wide else at) + raw + extra)
        size, n, end = self.out.position - start, len(self.entries), self.out.position
        if self.zip64 or start >= MANY or n >= 0xFFFF:
            self.out.write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start) + LOCATOR64 + struct.pack("<IQI", 0, end, 1))
            n, size, start = min(n, 0xFFFF), min(size, MANY), MANY
        self.out.write(END + struct.pack("<HHHHIIH", 0, 0, n, n, size, start, 0))
        self.out.__exit__(None, None, None)

    def drop(self, error: BaseException) -> None:
        self.out.__exit__(type(error), error, None)


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int


class Package:
    """A ZIP file's stored members, by ranges."""

    TAIL = 22 + 0xFFFF

    def __init__(self, uri: str):
        self.file = RangeReader(uri)
        self.members = {m.name: m for m in self._directory()}

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.file.size - self.TAIL)
        tail = self.file.read(tail_at, self.file.size - tail_at)
        at = tail.rfind(END, 0, max(0, len(tail) - 18))  # the record has 22 bytes at least
        while at >= 0 and at + 22 + struct.unpack("<H", tail[at + 20 : at + 22])[0] != len(tail):
            at = tail.rfind(END, 0, at)  # the same bytes within a comment
        if at < 0:
            raise ValueError("no end record: not a ZIP file, or cut short")
        n, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        locator_at = tail_at + at - 20
        locator = self.file.read(locator_at, 20) if locator_at >= 0 else b""
        if locator[:4] == LOCATOR64:
            end = self.file.read(struct.unpack("<Q", locator[8:16])[0], 56)
            if end[:4] != END64:
                raise ValueError("the ZIP64 locator points elsewhere")
            n, size, start = struct.unpack("<QQQ", end[32:56])
        directory, at = self.file.read(start, size), 0
        for _ in range(n):
            if directory[at : at + 4] != CENTRAL:
                raise ValueError("the central directory is damaged")
            method, = struct.unpack("<H", directory[at + 10 : at + 12])
            packed, plain, name_size, extra_size, comment_size = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
            header, = struct.unpack("<I", directory[at + 42 : at + 46])
            name = directory[at + 46 : at + 46 + name_size].decode()
            extra = directory[at + 46 + name_size : at + 46 + name_size + extra_size]
            while len(extra) >= 4:
                kind, length = struct.unpack("<HH", extra[:4])
                if kind == 1:  # only what doesn't fit, in this order
                    wide = list(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                    plain = wide.pop(0) if plain == MANY else plain
                    packed = wide.pop(0) if packed == MANY else packed
                    header = wide.pop(0) if header == MANY else header
                extra = extra[4 + length :]
            yield Member(name, method, packed, header)
            at += 46 + name_size + extra_size + comment_size

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        head = self.file.read(member.header, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"{name} has no local header where the directory says")
        return member.header + 30 + sum(struct.unpack("<HH", head[26:30]))

    def read(self, name: str) -> bytes:
        return self.file.read(self.start(name), self.members[name].size)


def with_kinds(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html (null for revisits), size, digest, refers_to."""
    spark, pages = pages.sparkSession, pages.filter("page_id is not null")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = {"sha1": F.unhex(F.sha1(F.encode(html, "UTF-8"))), "size": F.octet_length(html).cast("long")}
    keys = written(pages.select(F.col("page_id").cast("long"), *(v.alias(k) for k, v in own.items())), scratch(spark, "warc-keys"))
    # The payloads that recur: pre-aggregated, a row each.
    first = keys.filter(F.col("size") >= least).groupBy("sha1", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    first = written(first, scratch(spark, "warc-firsts"))
    revisits = written(keyed_join(keys, first, ["sha1", "size"], "n", keys.count()).filter(F.col("page_id") > F.col("refers_to")).distinct(), scratch(spark, "warc-revisits"))
    revisits = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    return (
        pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), *(v.alias(k) for k, v in own.items()))
        .join(revisits, ["page_id", "sha1", "size"], "left")
        .withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    )


def write_packages(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write all pages to packages in `folder`; a row per package: path, records."""
    small_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = 0
        members, lines, size = [], [], 0
        paths, counts = [], []

        def flush():
            nonlocal number, members, lines, size
            name = f"part-{TaskContext.get().partitionId():06d}-{number:04d}"
            package = PackageWriter(f"{folder}/{name}.wacz")
            try:
                package.member(f"archive/{name}.warc.gz", members)
                package.member("indexes/index.cdxj", ["\n".join(lines).encode()])
                package.member("datapackage.json", [json.dumps({"profile": "data-package", "records": len(lines)}).encode()])
            except BaseException as error:
                package.drop(error)
                raise
            package.close()
            paths.append(f"{folder}/{name}.wacz")
            counts.append(len(lines))
            number, members, lines, size = number + 1, [], [], 0

        at = 0
        for batch in batches:
            for page_id, url, html, length, sha1, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "size", "sha1", "refers_to"))):
                payload = html.as_buffer().to_pybytes() if html.is_valid else None
                whole = record(page_id.as_py(), url.as_py(), payload, base64.b32encode(sha1.as_py()).decode(), length.as_py(), refers.as_py())
                packed = gzip.compress(whole, 1, mtime=0)
                lines.append(f"{page_id.as_py()} {'revisit' if refers.is_valid else 'response'} {at} {len(packed)}")
                members.append(packed)
                at += len(packed)
                size += len(whole)
                if size >= PACKAGE_BYTES:
                    flush()
                    at = 0
        if lines:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return with_kinds(pages, least).mapInArrow(write, "path string, records long")


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and (payloads) payload of every record."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                package = Package(path)
                lines = package.read("indexes/index.cdxj").decode().split("\n")
                (name,) = (m for m in package.members if m.startswith("archive/"))
                base = package.start(name)
                for i in range(0, len(lines), STEP_RECORDS):
                    ranges = [tuple(map(int, x.split()[2:])) for x in lines[i : i + STEP_RECORDS]]
                    batch_of = _records(package.file, base, ranges)
                    yield batch_of if payloads else batch_of.drop_columns(["payload"])
                package.file.close()

    n = packages.count()
    dealt = packages.repartitionByRange(n, "path") if n > 1 else packages
    return dealt.mapInArrow(steps, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def _records(file: RangeReader, base: int, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
    rows: dict[str, list] = {k: [] for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
    for offset, length in ranges:
        warc, http, payload = parse_record(zlib.decompress(file.read(base + offset, length), 31))
        digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
        if kind == "response" and (len(payload) != int(http["content-length"]) or payload_digest(payload) != digest):
            raise ValueError(f"{warc['warc-record-id']} does not hold the payload that it states")
        number = lambda x: int(x.strip("<>").rpartition(":")[2])
        values = (number(warc["warc-record-id"]), warc["warc-target-uri"], int(http["content-length"]), digest, kind, number(warc["warc-refers-to"]) if kind == "revisit" else None, payload)
        for column, value in zip(rows.values(), values):
            column.append(value)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))
