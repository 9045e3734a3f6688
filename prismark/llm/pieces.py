"""SentencePiece encoding and decoding (byte-pair models) by suffix-array matching.

The distinct chunks of a batch (a chunk begins where a blank follows another
character; no piece crosses that) are concatenated and indexed by a suffix
array. Every piece of the vocabulary is binary-searched for its range of
occurrences; these are edges from position to position, sorted by where they
end, and relaxed from left to right in all chunks at once.

A byte-pair encoding is not the path of best total score, but it has one
property that relaxing can use: a sequence of pieces is the encoding of its
text exactly if each two neighbours are the encoding of theirs. So an edge is
followed only when its piece may stand after the one that ends where it
begins, and one path remains. Whether two pieces may meet is worked out once,
by merging the characters of both, and remembered. Runs of blanks, whose
pieces all have one score, break that rule; chunks with such a run are merged
directly, best neighbours first by a heap.

Cases: null texts count as empty and have no ids; characters outside the
vocabulary become their bytes' pieces; a very long chunk is indexed in parts
that overlap by a piece, a very long run of blanks costs n log n; repeated rows
are encoded again; empty tables give empty results; columns other than doc_id
and text are passed through.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from prismark.llm.store import small_batches
from prismark.llm.words import WordBatch, WordMemory, held_in_worker, plain_strings, ragged_take, text_slices

BLANK = "\u2581"
#: Characters of new chunks that one suffix array indexes.
INDEXED = 300_000
#: Chunks longer than this are relaxed one by one.
LONG = 2_000
#: Stands between chunks in the indexed text: a code that no text has.
BETWEEN = 0xD800
#: Pairs of pieces whose meeting is remembered.
MEETS = 2_000_000
CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def suffix_array(codes: np.ndarray, width: int) -> np.ndarray:
    """Positions of `codes` in order of the `width` codes from there on, by doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while step < width:
        later = np.zeros(len(rank), np.int64)
        later[:-step] = rank[step:] + 1
        key = rank * (len(rank) + 2) + later
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        step *= 2
    return order


class PieceModel:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(size)]
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.score = [model.get_score(i) for i in range(size)]
        self.id = {t: i for i, (t, s) in enumerate(zip(self.text, special)) if not s}
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.text) if model.is_byte(i)}
        self.unknown = size  # an edge of one character that has no piece
        self.ids = np.array(sorted(self.id.values(), key=lambda i: self.text[i]))
        self.sorted = np.array([self.text[i] for i in self.ids])
        self.lengths = np.array([len(self.text[i]) for i in self.ids])
        self.width = int(self.lengths.max())
        self.meets: dict[int, bool] = {}

    def merge(self, text: str) -> list[int]:
        """The encoding of `text`: the best-scored neighbours are merged first, the leftmost of equals."""
        n = len(text)
        size = [1] * n + [0]  # of the part that begins here; 0: none does
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int) -> tuple[float, int, int] | None:
            """What merging the part at i with the next one would give, if that is a piece."""
            j = after[i]
            if j < n and size[i] + size[j] <= self.width:
                piece = self.id.get(text[i : j + size[j]])
                if piece is not None:
                    return -self.score[piece], i, size[i] + size[j]
            return None

        heap = [p for p in map(pair, range(n - 1)) if p]
        heapify(heap)
        while heap:
            _, i, whole = heappop(heap)
            j = after[i] if size[i] else n
            if j == n or size[i] + size[j] != whole:
                continue  # one of the two has been merged meanwhile
            size[i], size[j] = whole, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p in [pair(k) for k in (before[i], i) if k >= 0]:
                if p:
                    heappush(heap, p)
        out, i = [], 0
        while i < n:
            out.append(self.id.get(text[i : i + size[i]], self.unknown))
            i = after[i]
        return out

    def may_meet(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether right[i] may follow left[i] (negative: a chunk's start)."""
        free = (left < 0) | (left == self.unknown) | (right == self.unknown)
        code = left * (self.unknown + 1) + right
        codes, place = np.unique(code[~free], return_inverse=True)
        known = np.empty(len(codes), bool)
        if len(self.meets) > MEETS:
            self.meets.clear()
        for i, c in enumerate(codes.tolist()):
            known[i] = self._meet(c)
        free[~free] = known[place]
        return free

    def _meet(self, code: int) -> bool:
        answer = self.meets.get(code)
        if answer is None:
            a, b = divmod(code, self.unknown + 1)
            answer = self.meets[code] = self.merge(self.text[a] + self.text[b]) == [a, b]
        return answer

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all occurrences of pieces in a text of code points."""
        order = suffix_array(codes, self.width)
        padded = np.concatenate((codes, np.zeros(self.width, codes.dtype)))
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.width)[order]
        keys = np.ascontiguousarray(windows.astype("<u4")).view(f"<U{self.width}").ravel()
        low = np.searchsorted(keys, self.sorted, "left")
        last = np.array([t + chr(0x10FFFF) * (self.width - len(t)) for t in self.sorted.tolist()])
        high = np.searchsorted(keys, last, "right")
        many = high - low
        start = order[ragged_take(low, many)]
        return start, start + np.repeat(self.lengths, many), np.repeat(self.ids, many)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of the encodings of chunks."""
        found: list[list[int]] = [[]] * len(chunks)
        relaxed = []
        for i, chunk in enumerate(chunks):
            if BLANK * 2 in chunk:
                found[i] = self.merge(chunk)
            elif len(chunk) > LONG:
                found[i] = self._relax_long(chunk)
            else:
                relaxed.append(i)
        i = 0
        while i < len(relaxed):
            j, size = i, 0
            while j < len(relaxed) and size < INDEXED:
                size += len(chunks[relaxed[j]]) + 1
                j += 1
            for k, ids in zip(relaxed[i:j], self._relax([chunks[x] for x in relaxed[i:j]])):
                found[k] = ids
            i = j
        out = []
        for i, ids in enumerate(found):
            if self.unknown in ids:
                texts, at = chunks[i], 0
                whole = []
                for piece in ids:
                    if piece == self.unknown:
                        whole += [self.bytes[b] for b in texts[at].encode()]
                        at += 1
                    else:
                        whole.append(piece)
                        at += len(self.text[piece])
                ids = whole
            out.append(ids)
        return np.fromiter(map(len, out), np.int64, len(out)), np.fromiter((x for ids in out for x in ids), np.int32)

    def _relax(self, chunks: list[str]) -> list[list[int]]:
        codes = np.frombuffer(" ".join([*chunks, ""]).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        begins = np.cumsum(sizes + 1) - sizes - 1
        codes[begins + sizes] = BETWEEN
        start, end, piece = self.edges(codes)
        single = np.zeros(len(codes), bool)
        single[start[end == start + 1]] = True
        single[begins + sizes] = True  # between chunks
        lone = np.flatnonzero(~single)
        start, end, piece = np.concatenate((start, lone)), np.concatenate((end, lone + 1)), np.concatenate((piece, np.full(len(lone), self.unknown)))
        begin_of = np.repeat(begins, sizes + 1)
        depth = end - begin_of[start]
        order = np.argsort(depth, kind="stable")
        start, end, piece, depth = start[order], end[order], piece[order], depth[order]
        last = np.full(len(codes) + 1, -2, np.int64)  # -2: not reached, -1: a chunk's start
        came = np.zeros(len(codes) + 1, np.int64)
        last[begins] = -1
        cuts = np.searchsorted(depth, np.arange(1, int(sizes.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            reached = last[s] > -2
            s, e, p = s[reached], e[reached], p[reached]
            fits = self.may_meet(last[s], p)
            last[e[fits]], came[e[fits]] = p[fits], s[fits]
        result = []
        for b, n in zip(begins.tolist(), sizes.tolist()):
            at, ids = b + n, []
            while at > b:
                ids.append(int(last[at]))
                at = int(came[at])
            result.append(ids[::-1])
        return result


    def _relax_long(self, chunk: str) -> list[int]:
        """The same for one chunk, from left to right over parts of INDEXED characters."""
        n, unknown = len(chunk), self.unknown
        last, came = array("i", [-2]) * (n + 1), array("q", [0]) * (n + 1)
        last[0] = -1
        for at in range(0, n, INDEXED):
            part = chunk[at : at + INDEXED + self.width]
            start, end, piece = self.edges(np.frombuffer(part.encode("utf-32-le"), "<u4").astype(np.int64))
            here = start < INDEXED
            start, end, piece = start[here], end[here], piece[here]
            order = np.argsort(start, kind="stable")
            cuts = np.searchsorted(start[order], np.arange(min(INDEXED, n - at) + 1))
            ends, found = (end[order] + at).tolist(), piece[order].tolist()
            if len(self.meets) > MEETS:
                self.meets.clear()
            for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()), at):
                left = last[k]
                if left == -2:
                    continue
                free, single = left < 0 or left == unknown, False
                for i in range(a, b):
                    p, e = found[i], ends[i]
                    single = single or e == k + 1
                    if free or self._meet(left * (unknown + 1) + p):
                        last[e], came[e] = p, k
                if not single:
                    last[k + 1], came[k + 1] = unknown, k
        at, ids = n, []
        while at > 0:
            ids.append(last[at])
            at = came[at]
        return ids[::-1]


class PieceCoder:
    """Encodes and decodes arrays of texts."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.memory = WordMemory(lambda words: self.model.encode_chunks([w if w.startswith(BLANK) else BLANK + w for w in words]))
        m = self.model
        turned = {i: b for b, i in m.bytes.items()}
        self.surface = [bytes([turned[i]]) if i in turned else t.replace(BLANK, " ").encode() for i, t in enumerate(m.text)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets)."""
        # Where every blank stands between two words, a chunk is a word with its blank.
        odd = pc.match_substring_regex(texts, f"  |^ | $|\\x00|{BLANK}").to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._coded(pc.split_pattern(texts, " "))
        ids, offsets = self._coded(pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts), " "))
        chunks = [CHUNK.findall(BLANK + t.replace(" ", BLANK)) for t in texts.filter(pa.array(odd)).to_pylist()]
        odd_ids, odd_offsets = self._coded(pa.array(chunks, pa.list_(pa.large_string())))
        number = np.cumsum(odd) - 1
        parts = [odd_ids[odd_offsets[number[i]] : odd_offsets[number[i] + 1]] if odd[i] else ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _coded(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        batch = WordBatch(chunks)
        starts, lengths, flat = self.memory.lists(batch.words)
        sizes = lengths[batch.codes]
        ids = flat[ragged_take(starts[batch.codes], sizes)] if len(batch.codes) else np.zeros(0, np.int32)
        return ids, np.concatenate(([0], np.cumsum(sizes)))[batch.offsets]

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def coder(path: str) -> PieceCoder:
    """One for each Python worker, so that chunks stay remembered between tasks."""
    return held_in_worker(("pieces", path), lambda: PieceCoder(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with piece_ids, the encoding of each whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                ids, offsets = coder(path).encode(plain_strings(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "piece_ids"])

    plain = docs.drop("piece_ids").withColumn("text", F.col("text").cast("string"))
    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("piece_ids", ArrayType(IntegerType()))]))


def decode(rows: DataFrame, path: str, column: str = "piece_ids") -> DataFrame:
    """`rows` with piece_text, the text of the ids in `column` (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [coder(path).decode(ids or []) for ids in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "piece_text"])

    plain = rows.drop("piece_text")
    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("piece_text", StringType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), restored: whether decoding gives the text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                texts = plain_strings(part.column("text"))
                ids, offsets = coder(path).encode(texts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                same = [coder(path).decode(ids[a:b].tolist()) == t for a, b, t in zip(offsets[:-1], offsets[1:], texts.to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "restored"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, restored boolean")
