"""Media columns: content-addressed payloads in tar shards, read back by ranges.

A payload is stored once as the member `<sha256>.png` of a tar shard, a
lossless 8-bit greyscale image 24 samples wide. A row carries its digest, and
by it the shard, offset and length of the stored bytes. Metadata columns
(width, height, bit depth) come from the 33 header bytes alone; features and
checksums from the whole member, decoded.

Each writing task keeps one copy of what it met lately; where several copies of
a payload were stored, the first address by (shard, offset) is the payload's
address and the other copies are never read.

Cases: null texts count as empty; an empty text is one block of padding; equal
texts share one address; a repeated row points where the first does; a very long
text is one member, held in memory alone; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prismark.llm.store import AtomicFile, RangeReader, discard, keyed_join, scratch, small_batches, written
from prismark.llm.words import release_worker, text_slices

#: Payload lengths are multiples of this: 24 rows of 24 samples.
BLOCK = 576
WIDTH = 24
#: Bytes that pad a payload; UTF-8 text has none of them.
PAD = b"\xff"
HEADER = 33
PNG = b"\x89PNG\r\n\x1a\n"
#: Bytes of members that one shard holds at most (one member at least).
SHARD_BYTES = 64 << 20
#: Stored payloads that one reading task takes.
READ_ROWS = 4000
#: Payloads whose addresses a writing task remembers; beyond that it may store a payload once more.
KNOWN = 100_000


def padded(text: bytes) -> bytes:
    return text + PAD * (max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """A greyscale image with `payload` as its samples, row by row."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first HEADER bytes."""
    if head[:8] != PNG or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    if colour:
        raise ValueError("not a greyscale image")
    return width, height, depth


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png made."""
    width, height, _ = png_header(data[:HEADER])
    at, packed = 8, []
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation and a 64-bit average hash of the samples in an 8 x 8 grid, as text."""
    samples = np.frombuffer(payload, np.uint8)
    edges = np.arange(64) * len(samples) // 64
    sums = np.add.reduceat(samples.astype(np.int64), edges)
    means = sums / np.diff(edges, append=len(samples))
    bits = np.packbits(means > np.median(means)).tobytes().hex()
    return f"{samples.mean():.4f}:{samples.std():.4f}:{bits}"


def write_shards(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, digest, shard (a file of `folder`), offset, length of each text's stored payload."""
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release_worker()
        task, number = TaskContext.get().partitionId(), 0
        known: dict[str, tuple[str, int, int]] = {}
        out = None
        try:
            for batch in (part for whole in batches for part in text_slices(whole)):
                found = []
                if len(known) > KNOWN:
                    known.clear()
                for text in batch.column("text"):
                    payload = padded(text.as_buffer().to_pybytes() if text.is_valid else b"")
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in known:
                        image = to_png(payload)
                        if out is None or out.position + len(image) > SHARD_BYTES and out.position:
                            if out is not None:
                                out.write(b"\0" * 1024)
                                out.__exit__(None, None, None)
                            shard, number = f"shard-{task:06d}-{number:04d}.tar", number + 1
                            out = AtomicFile(f"{folder}/{shard}")
                        member = tarfile.TarInfo(f"{digest}.png")
                        member.size = len(image)
                        out.write(member.tobuf(tarfile.USTAR_FORMAT))
                        known[digest] = shard, out.write(image), len(image)
                        out.write(b"\0" * (-len(image) % 512))
                    found.append((digest, *known[digest]))
                columns = list(zip(*found)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["doc_id", "digest", "shard", "offset", "length"])
        except BaseException as error:
            if out is not None:
                out.__exit__(type(error), error, None)
            raise
        if out is not None:
            out.write(b"\0" * 1024)
            out.__exit__(None, None, None)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(write, "doc_id long, digest string, shard string, offset long, length long")


def addresses(rows: DataFrame) -> DataFrame:
    """digest, shard, offset, length: one address for each payload, and how many documents have it."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"), F.count("*").alias("documents")).select("digest", "at.*", "documents")


def _by_shard(at: DataFrame) -> DataFrame:
    """Addresses dealt so that a task reads neighbours in few shards."""
    return at.repartitionByRange(max(1, -(-at.count() // READ_ROWS)), "shard", "offset").sortWithinPartitions("shard", "offset")


def _readers(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[RangeReader, int, int]]]]:
    """Each batch, and an open file, offset and length for each of its rows; one file is open at a time."""
    release_worker()
    opened: dict[str, RangeReader] = {}

    def rows(batch: pa.RecordBatch):
        for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length"))):
            if shard not in opened:
                for reader in opened.values():
                    reader.close()
                opened.clear()
                opened[shard] = RangeReader(f"{folder}/{shard}")
            yield opened[shard], offset, length

    for batch in batches:
        yield batch, rows(batch)


def header_columns(at: DataFrame, folder: str) -> DataFrame:
    """`at` with width, height and bit_depth, from header bytes alone."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _readers(batches, folder):
            found = np.array([png_header(file.read(offset, HEADER)) for file, offset, _ in rows], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, i]) for i in range(3))], [*batch.schema.names, "width", "height", "bit_depth"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in at.schema)
    return _by_shard(at).mapInArrow(look, f"{schema}, width long, height long, bit_depth long")


def payload_columns(at: DataFrame, folder: str) -> DataFrame:
    """`at` with what reading each member whole gives: lengths, checksums, feature."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch, rows in _readers(batches, folder):
            found = {n: [] for n in names}
            for file, offset, length in rows:
                image = file.read(offset, length)
                payload = from_png(image)
                values = (len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(payload))
                for name, value in zip(names, values):
                    found[name].append(value)
            kinds = dict.fromkeys(("payload_sha256", "media_sha256", "feature"), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, kinds.get(n, pa.int64())) for n, v in found.items())], [*batch.schema.names, *names])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in at.schema)
    return _by_shard(at).mapInArrow(look, f"{schema}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_table(docs: DataFrame, folder: str) -> DataFrame:
    """Every document with its payload's address, header columns, checksums and feature."""
    spark = docs.sparkSession
    rows = written(write_shards(docs, folder), scratch(spark, "media-rows"))
    paths = [scratch(spark, f"media-{part}") for part in ("addresses", "headers")]
    # Headers and payloads in jobs of their own: one Python worker a task at a time.
    headers = written(header_columns(written(addresses(rows), paths[0]), folder), paths[1])
    discard(spark, paths[0])
    read = written(payload_columns(headers, folder), scratch(spark, "media-read"))
    discard(spark, paths[1])
    return keyed_join(rows.select("doc_id", "digest"), read, ["digest"], "documents", rows.count())
