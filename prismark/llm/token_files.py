"""Token-id files: frequency-ranked ids in a byte-aligned variable-length coding.

An id is stored as its rank by corpus frequency, little-endian in as few bytes
(1 to 4) as hold it. Lengths stand apart from the data: a control byte has the
lengths less one of four consecutive ranks, two bits each, lowest first. A
reader turns control bytes into lengths by looking them up in a 256 x 4 table.

A file holds documents in ascending doc_id, after a header:

    magic "FRQ1", 4 bytes; documents, tokens, data bytes: uint64 each
    doc_id: int64 each; tokens of each: uint64 each; control bytes; data bytes

The rank table (rank to id) is one separate file of the set, `ranks.bin`.

Cases: null text counts as empty and gives the end id alone; repeated rows
stay, each with its own ids; rows with a null doc_id come first in the order
and read back as null; an empty table gives no files and no rows; further
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F

from prismark.llm.store import AtomicFile, RangeReader, discard, scratch, small_batches, written
from prismark.llm.tokens import batch_encoder
from prismark.llm.words import plain_strings, release_worker, text_slices

MAGIC = b"FRQ1"
#: Stands for a null doc_id in a file.
NULL_ID = np.iinfo(np.int64).min
#: For each control byte the four lengths it states.
LENGTHS = 1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8)
#: Documents' compressed ids that one file should hold, in bytes.
FILE_BYTES = 12 << 20
#: Tokens that a reader decodes at a time; a longer document passes alone.
BLOCK_TOKENS = 1 << 19
#: Files whose sizes are summed up at a time, and tasks that read files at most.
LOT, MOST_TASKS = 10_000, 50_000


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of `ranks`, each below 2^32."""
    ranks = ranks.astype(np.uint32)
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = lengths - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4) < lengths[:, None]
    return control.astype(np.uint8).tobytes(), ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The `count` ranks that encode_ranks stored."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    stored = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = np.zeros(count, np.uint32)
    for k in range(4):
        longer = lengths > k
        if not longer.any():
            break
        out[longer] |= stored[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def rank_by_frequency(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id of each rank, rank of each id): most frequent first, ties by id."""
    by_rank = np.lexsort((np.arange(len(counts)), -counts)).astype(np.uint32)
    rank_of = np.empty(len(counts), np.uint32)
    rank_of[by_rank] = np.arange(len(counts), dtype=np.uint32)
    return by_rank, rank_of


def token_rows(docs: DataFrame, tokenizer: str, blanks: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian uint32, or uint16 where the vocabulary allows; zstd) and, in rows of their own, id counts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(tokenizer, blanks)
        size = max(encoder.splitting.get_vocab_size(), end_id + 1)
        unit = np.uint16 if size <= 1 << 16 else np.uint32
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for part in text_slices(batch):
                ids, offsets = encoder.encode(plain_strings(part.column("text")), end_id)
                counts += np.bincount(ids, minlength=size)
                small = ids.astype(unit)
                squeeze = zstandard.ZstdCompressor(level=1).compress
                packed = [squeeze(small[offsets[i] : offsets[i + 1]].tobytes()) for i in range(len(offsets) - 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary()), pa.nulls(len(packed), pa.binary())], ["doc_id", "ids", "counts"])
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["doc_id", "ids", "counts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, ids binary, counts binary")


def _summed(counts: DataFrame) -> np.ndarray | None:
    """One sum of the count vectors of all tasks; their length is that of the vocabulary."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column("counts"):
                vector = np.frombuffer(row.as_buffer(), np.int64)
                total = vector.copy() if total is None else total + vector
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    partial = counts.coalesce(16).mapInArrow(add, "counts binary")
    vectors = [np.frombuffer(r.counts, np.int64) for r in partial.toLocalIterator()]
    return sum(vectors[1:], vectors[0]) if vectors else None


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, blanks: str, end_id: int) -> DataFrame:
    """Encode whole texts and write them to `folder`; a row per file: path, first position, documents, tokens."""
    spark = small_batches(docs.sparkSession)
    step = scratch(spark, "token-rows")
    rows = written(token_rows(docs, tokenizer, blanks, end_id), step)
    counts = _summed(rows.filter("counts is not null").select("counts"))
    if counts is None:
        return spark.createDataFrame([], "path string, start long, documents long, tokens long")
    wide = len(counts) > 1 << 16
    by_rank, rank_of = rank_by_frequency(counts)
    with AtomicFile(f"{folder}/ranks.bin") as out:
        out.write(by_rank.astype("<u4").tobytes())
    shared = spark.sparkContext.broadcast(rank_of)  # as long as the vocabulary

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release_worker()
        doc_ids, sizes, controls, parts, carried = [], [], [], [], np.zeros(0, np.uint32)
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in text_slices(batch, "ids", 1 << 20):
                doc_ids.append(part.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                ids = [np.frombuffer(unpack(x.as_buffer()), np.uint32 if wide else np.uint16) for x in part.column("ids")]
                sizes.append(np.array([len(x) for x in ids], np.uint64))
                ranks = np.concatenate([carried, *(shared.value[x] for x in ids)])
                whole = len(ranks) // 4 * 4  # a control byte has four
                control, data = encode_ranks(ranks[:whole])
                controls.append(control)
                parts.append(data)
                carried = ranks[whole:]
        if not doc_ids:
            return
        control, data = encode_ranks(carried)
        control, data = b"".join(controls) + control, b"".join(parts) + data
        doc_ids, sizes = np.concatenate(doc_ids), np.concatenate(sizes)
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.frq"
        with AtomicFile(path) as out:
            out.write(MAGIC + np.array([len(sizes), sizes.sum(), len(data)], "<u8").tobytes())
            for section in (doc_ids.astype("<i8"), sizes.astype("<u8")):
                out.write(section.tobytes())
            out.write(control)
            out.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(sizes)], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.array([TaskContext.get().partitionId()], pa.int64())], ["path", "documents", "tokens", "ord"])

    coded = rows.filter("counts is null").select("doc_id", "ids")
    weight = coded.agg(F.sum(F.length("ids"))).first()[0] or 0
    files = coded.repartitionByRange(max(1, -(-weight // FILE_BYTES)), "doc_id").sortWithinPartitions("doc_id", "ids")
    # Tasks of one job write the files and state their sizes.
    told = written(files.mapInArrow(write, "path string, documents long, tokens long, ord long"), scratch(spark, "token-manifest"))
    shared.destroy()
    discard(spark, step)
    # First positions: summed up within lots of files, then over the lots.
    rows = told.withColumn("lot", F.floor(F.col("ord") / LOT))
    own = F.sum("tokens").over(W.partitionBy("lot").orderBy("ord")) - F.col("tokens")
    lots = rows.groupBy("lot").agg(F.sum("tokens").alias("all"))
    before = lots.select("lot", (F.sum("all").over(W.orderBy("lot")) - F.col("all")).alias("before"))  # a row for each LOT files
    return rows.withColumn("own", own).join(F.broadcast(before), "lot").select("path", (F.col("before") + F.col("own")).alias("start"), "documents", "tokens")


class TokenFile:
    """One file, read by ranges."""

    def __init__(self, path: str):
        self.reader = RangeReader(path)
        head = self.reader.read(0, 28)
        if head[:4] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.documents, self.tokens, self.data_bytes = (int(x) for x in np.frombuffer(head[4:], "<u8"))

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """doc_ids, token counts and ranks of some documents after the other, about BLOCK_TOKENS tokens at a time."""
        at, n = 28, self.documents
        doc_ids = np.frombuffer(self.reader.read(at, 8 * n), "<i8")
        sizes = np.frombuffer(self.reader.read(at + 8 * n, 8 * n), "<u8").astype(np.int64)
        control = np.frombuffer(self.reader.read(at + 16 * n, -(-self.tokens // 4)), np.uint8)
        data_at = at + 16 * n + len(control)
        spare = len(control) * 4 - self.tokens  # the last control byte states one byte for each of these
        quads = np.concatenate(([0], np.cumsum(LENGTHS.sum(axis=1)[control], dtype=np.int64)))
        quads[-1] -= spare
        ends = np.cumsum(sizes)
        i = 0
        while i < n:
            low = int(ends[i] - sizes[i])
            j = max(i + 1, int(np.searchsorted(ends, low + BLOCK_TOKENS, side="right")))
            high = int(ends[j - 1])
            a, b = low // 4, -(-high // 4)
            data = self.reader.read(data_at + int(quads[a]), int(quads[b] - quads[a]))
            ranks = decode_ranks(control[a:b].tobytes(), data, min(4 * b, self.tokens) - 4 * a)
            yield doc_ids[i:j], sizes[i:j], ranks[low - 4 * a : high - 4 * a]
            i = j


def read_token_files(manifest: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (ids) ids of every document in the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        by_rank = None
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                if by_rank is None:
                    with RangeReader(f"{folder}/ranks.bin") as table:
                        by_rank = np.frombuffer(table.read(0, table.size), "<u4")
                for doc_ids, sizes, ranks in TokenFile(path).blocks():
                    ends, values = np.cumsum(sizes), by_rank[ranks]
                    raw = memoryview(values.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                    columns = [pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values.astype("<i4"), pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    start += int(ends[-1])

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids]
    return _a_file_a_task(manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def _a_file_a_task(manifest: DataFrame) -> DataFrame:
    files = manifest.count()
    return manifest.repartitionByRange(min(files, MOST_TASKS), "path") if files > 1 else manifest
