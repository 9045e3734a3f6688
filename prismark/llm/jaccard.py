"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Two texts link when their sets of five-word shingles (by 52-bit hashes) have a
Jaccard similarity of at least `num` / `den`. A set of n shares at least
k = ceil(n * num / den) with a partner, so in any global order of shingles the
first n - k + 1, its 1-prefix, hold one that its partner's 1-prefix holds too;
and prefixes l - 1 longer share l.

1. Clusters. Shingles are ordered by how many sets hold them, rare ones first,
   as a table of CELLS counters over all texts tells: a counter sums the
   shingles of its hash, so the order is global whatever its precision. Sets
   that share a shingle of their LEVEL-prefixes and are near enough in size meet
   within tasks, then in buckets of shingles. More than FEW of them are chained;
   a shingle of a thousand sets makes a thousand edges. Of a chain a task sends
   its first and last set in each band of sizes, so whatever is near any member
   of the chain is near one that was sent; what meets such a set is chained too.
   Where all sets of a shingle are there and no more than FEW, each pair gets a
   point, and pairs with LEVEL points (or as many as the smaller set must share,
   if less) have an edge: the more texts there are, the more of them share one
   shingle or two by chance. Linked sets are in one connected cluster.
   Where a cluster stays large, its texts alone are counted and chained again:
   fewer texts share the counters, which then tell rare shingles better.
2. Links. Clusters are dealt in blocks of bounded size. In a block, shingles
   are ordered by their counts there. Each set lengthens its prefix as long as
   the estimated cost falls: postings to scan plus candidates (postings divided
   by l) to verify. Two sets must share as many prefix shingles as the smaller
   of their two l says, within those prefixes, before they are verified. Pairs
   that are connected already are not verified again.
   A cluster of several blocks is first compared block by block, with some
   pivots in all of its blocks. Sets of its greatest component so far need no
   comparing with each other any more; only the others go to every block, in
   rounds of so many that a round's shuffle is bounded by the sets themselves.
3. Components of the links.

Texts with equal sets are one class from the start and never make pairs. A
class is told by two 64-bit sums over its set and the set's size. Two shingles
of a text of n have one hash with a chance of n^2 / 2^53 (at a million shingles
one text in ten thousand counts one too few).

Cases: null texts, texts without words: empty set, no links; fewer than five
words: the whole sequence is the one shingle; equal texts and repeated rows
share a class; ties are broken by doc_id; rows without a doc_id are left out;
rows of one doc_id with several texts count as documents of their own; very
long texts are cut nowhere and handled one at a time; empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from prismark.llm.store import Steps, keyed_join, scratch, small_batches, written
from prismark.llm.words import WordBatch, WordMemory, held_in_worker, plain_strings, release_held, release_worker, text_slices, whitespace_words

SHINGLE = 5
#: Counters of shingles (16 bits each in tasks, 8 bits when shared: 16 MB), and segments in which they are summed.
#: The order that they give decides costs, never results.
CELLS, SEGMENTS = 1 << 24, 64
#: Tasks' counters that are summed at a time (3 at least, so that each round leaves fewer).
LOT = 256
#: Prefix entries that a task sorts at a time, and that one bucket should hold.
TASK_ENTRIES, BUCKET_ENTRIES = 1_000_000, 400_000
#: Shingles of their prefixes that two sets of a cluster share, unless one of those is in more sets than FEW.
LEVEL, FEW = 4, 4
#: Sets, and shingles, in one block of a cluster, and in one bin of small clusters, about.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000
#: Texts whose ids may be broadcast to fetch them; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Blocks from which a cluster's texts are counted and chained again, and the rounds of that at most.
LARGE_BLOCKS, ROUNDS = 8, 3
#: Sets of a large cluster that all of its blocks see.
PIVOTS = 4
#: Shingles, about, of the sets that are shuffled in one round, and rounds at most for small clusters; large
#: clusters take as many as they need, with one lot of visitors at least.
ROUND_SHINGLES, SMALL_ROUNDS = 1 << 28, 8
#: Class keys that a task remembers, so as to send copies once.
SEEN = 200_000
#: Cost of verifying a candidate, in postings, for each shingle of the set.
VERIFY_COST = 0.5
HASH_BITS = np.uint64(52)
SLICE_ROWS = 4096

_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes of texts."""

    def __init__(self):
        self.memory = WordMemory(self._hash, dtype=np.int64)

    @staticmethod
    def _hash(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        import xxhash

        return np.ones(len(words), np.int64), np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words)).view(np.int64)

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, offsets): the sorted distinct hashes of each text."""
        batch: WordBatch = whitespace_words(texts, lower_ascii=True)
        starts, _, flat = self.memory.lists(batch.words)
        h = flat[starts].view(np.uint64)[batch.codes] if len(batch.codes) else np.zeros(0, np.uint64)
        counts = batch.counts
        many = np.maximum(counts - SHINGLE + 1, (counts > 0).astype(np.int64))
        owner = np.repeat(np.arange(len(counts), dtype=np.uint64), many)
        at = np.repeat(batch.offsets[:-1] - (np.cumsum(many) - many), many) + np.arange(len(owner))
        padded = np.concatenate((h, np.zeros(SHINGLE, np.uint64)))
        short = np.repeat(counts < SHINGLE, many)
        with np.errstate(over="ignore"):
            value = np.zeros(len(owner), np.uint64)
            for k in range(SHINGLE):
                word = padded[at + k]
                if short.any():
                    word[short & (k >= np.repeat(counts, many))] = 0
                value = value * _P + word
            # One number holds text and hash, so that one sort makes the sets.
            keys = owner << HASH_BITS | _mix(value) >> (np.uint64(64) - HASH_BITS)
        keys.sort()
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
        return keys & ((np.uint64(1) << HASH_BITS) - np.uint64(1)), np.concatenate(([0], np.cumsum(np.bincount((keys >> HASH_BITS).astype(np.int64), minlength=len(counts)))))


def _class_keys(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each set, equal for equal sets; with the size they name a class."""
    keys = []
    with np.errstate(over="ignore"):
        for turn in (_P, np.uint64(0xC2B2AE3D27D4EB4F)):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(hashes * turn + _P))))
            keys.append(_mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64))
    return keys[0], keys[1]


def _text_sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch, with their sets (hashes, offsets) and both class keys."""
    for start in range(0, batch.num_rows, SLICE_ROWS):
        for part in text_slices(batch.slice(start, SLICE_ROWS)):
            hashes, offsets = held_in_worker("shingles", Shingler).sets(plain_strings(part.column("text")))
            yield part, hashes, offsets, *_class_keys(hashes, offsets)


class _Seen:
    """The classes that a task met lately; forgetting some costs time only."""

    def __init__(self):
        self.keys: set[int] = set()

    def new(self, keys: np.ndarray) -> np.ndarray:
        if len(self.keys) > SEEN:
            self.keys.clear()
        out = np.zeros(len(keys), bool)
        for i, key in enumerate(keys.tolist()):
            if key not in self.keys:
                self.keys.add(key)
                out[i] = True
        return out


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(CELLS)).astype(np.int64)


def set_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n, key, key2 of each document's set; in rows without doc_id, segments (key) of tasks' counters."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        counters = np.zeros(CELLS, np.uint16)
        names = ["doc_id", "n", "key", "key2", "counters"]
        for batch in batches:
            for part, hashes, offsets, keys, keys2 in _text_sets(batch):
                n = np.diff(offsets)
                cells, times = np.unique(_cells(hashes[np.repeat(seen.new(keys), n)]), return_counts=True)  # copies count once
                counters[cells] = np.minimum(counters[cells].astype(np.int64) + times, 65535)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys), pa.array(keys2), pa.nulls(len(n), pa.binary())], names)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for i, segment in enumerate(np.split(counters, SEGMENTS)):
            if segment.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([i], pa.int64()), pa.nulls(1, pa.int64()), pa.array([squeeze(segment.tobytes())], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(look, "doc_id long, n long, key long, key2 long, counters binary")


def _bounds_of(counts: np.ndarray) -> np.ndarray:
    """Ascending bounds, 254 at most, that tell counts apart: by quantiles, and above those by a growing factor."""
    bounds = np.unique(np.quantile(counts, np.linspace(0, 1, 129)[1:]))
    top = max(float(bounds[-1]), 1.0)
    return np.concatenate((bounds, top * 2.0 ** (np.arange(1, 255 - len(bounds)) / 4)))


def shingle_counters(steps: Steps, rows: DataFrame) -> np.ndarray:
    """All tasks' counters summed, as levels from 0 to 255 in the same order.

    Sums are made of at most LOT tasks' counters at a time, lot by lot until one is left.
    """
    segment, bounds = CELLS // SEGMENTS, None

    def summed(kind: type, out: type | None) -> Callable[[pa.Table], pa.Table]:
        def add(table: pa.Table) -> pa.Table:
            release_held()
            total = np.zeros(segment, np.int64)
            unpack, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
            for blob in table.column("counters"):
                total += np.frombuffer(unpack(blob.as_buffer()), kind)
            if out is None:  # the last lot: levels
                total = np.searchsorted(bounds, total, "left").astype(np.uint8)
            else:
                total = np.minimum(total, np.iinfo(out).max).astype(out)
            return pa.table({"key": table.column("key").slice(0, 1), "counters": pa.array([squeeze(total.tobytes())], pa.binary())})

        return add

    told, kind = rows.filter("counters is not null").select("key", "counters"), np.uint16
    while True:
        many = told.groupBy("key").count().agg(F.max("count")).first()[0] or 0
        if many <= LOT:
            break
        lot = F.pmod(F.xxhash64("key", "counters"), F.lit(-(-2 * many // LOT)))
        told, kind = steps.table(told.groupBy("key", lot.alias("lot")).applyInArrow(summed(kind, np.uint32), "key long, counters binary"), "counters"), np.uint32
    # Hashes spread shingles alike over all segments, so one tells the bounds.
    one = told.filter("key = 0").groupBy("key").applyInArrow(summed(kind, np.uint32), "key long, counters binary").first()
    unpack = zstandard.ZstdDecompressor().decompress
    bounds = _bounds_of(np.frombuffer(unpack(one.counters), np.uint32) if one else np.arange(2))
    levels = np.zeros(CELLS, np.uint8)
    summed_up = steps.table(told.groupBy("key").applyInArrow(summed(kind, None), "key long, counters binary"), "counters")
    for r in summed_up.toLocalIterator():  # SEGMENTS rows, whatever the input
        levels[r.key * segment : (r.key + 1) * segment] = np.frombuffer(unpack(r.counters), np.uint8)
    return levels


def least_shared(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles that a set of n shares with any partner, at least."""
    return -(-n * num // den)


def _bands(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Bands of sizes, ascending: any two sizes of one band are near enough for a link."""
    if num >= den:
        return n
    least, top = [1], int(n.max(initial=1))
    while least[-1] <= top:
        least.append(least[-1] * den // num + 1)
    return np.searchsorted(np.array(least), n, "right")


def _packed(values: np.ndarray) -> bytes:
    """Ascending numbers in few bytes: equal bytes of their differences lie together."""
    steps = np.diff(values, prepend=values[:1] * 0)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _unpacked(blob: pa.Buffer | bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _chain(shingle: np.ndarray, key: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, kept): edges between neighbours in size among the sets of a shingle, and a mask of members that stand for their chain.

    The arrays are sorted by (shingle, n). A gap in size that no link can cross ends a chain.
    Kept are a chain's first and last member in each band of sizes, so that kept neighbours are near enough
    in size for a link: a set that is near any member, or between two, is near a kept one.
    """
    joined = (shingle[1:] == shingle[:-1]) & (n[1:] * num <= n[:-1] * den)
    band = _bands(n, num, den)
    inner = joined & (band[1:] == band[:-1])
    kept = np.ones(len(key), bool)
    kept[1:-1] = ~(inner[1:] & inner[:-1])
    a, b = np.minimum(key[1:], key[:-1])[joined], np.maximum(key[1:], key[:-1])[joined]
    different = a != b
    if not different.any():
        return a[:0], b[:0], kept
    edges = np.unique(np.stack((a[different], b[different])), axis=1)
    return edges[0], edges[1], kept


def _of_chains(shingle: np.ndarray, n: np.ndarray, marked: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """For each member its chain's number of members, and whether any of them is marked; arrays as for _chain."""
    first = np.ones(len(n), bool)
    first[1:] = ~((shingle[1:] == shingle[:-1]) & (n[1:] * num <= n[:-1] * den))
    chain = np.cumsum(first) - 1
    return np.bincount(chain)[chain], (np.bincount(chain, marked) > 0)[chain]


def _points(shingle: np.ndarray, key: np.ndarray, n: np.ndarray, num: int, den: int) -> pa.Table:
    """a, b, need, points: pairs near enough in size that share shingles, of FEW members each; need points make an edge."""
    pairs = []
    for k in range(1, FEW):
        at = np.flatnonzero((shingle[k:] == shingle[:-k]) & (n[k:] * num <= n[:-k] * den) & (key[k:] != key[:-k]))
        pairs.append((np.minimum(key[at], key[at + k]), np.maximum(key[at], key[at + k]), np.minimum(LEVEL, least_shared(n[at], num, den))))
    a, b, need = (np.concatenate(x) for x in zip(*pairs))
    order = np.lexsort((b, a))
    a, b, need = a[order], b[order], need[order]
    starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    return pa.table({"a": a[starts], "b": b[starts], "need": np.minimum.reduceat(need, starts) if len(a) else need, "points": np.diff(np.append(starts, len(a)))})


def cluster_edges(docs: DataFrame, rows: DataFrame, counters: Broadcast, num: int, den: int) -> DataFrame:
    """a, b: keys of sets that belong to one cluster."""
    total = rows.filter("doc_id is not null").agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + LEVEL)).first()[0] or 0
    buckets = int(max(1, -(-total // BUCKET_ENTRIES)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            shingle, key, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((n, shingle))
            shingle, key, n = shingle[order], key[order], n[order]
            _, _, kept = _chain(shingle, key, n, num, den)
            _, cut = _of_chains(shingle, n, ~kept, num, den)
            a, b, _ = _chain(shingle[cut], key[cut], n[cut], num, den)
            # Negative sizes are of sets that stand for others.
            shingle, key, n = shingle[kept], key[kept], np.where(cut, -n, n)[kept].astype(np.int32)
            bucket = ((shingle >> HASH_BITS - np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ascending
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            stops = np.append(starts[1:], len(bucket))
            blobs = [[_packed(shingle[i:j]) for i, j in zip(starts, stops)], [key[i:j].tobytes() for i, j in zip(starts, stops)], [_packed(n[i:j]) for i, j in zip(starts, stops)]]
            edges = [b""] * len(starts)
            if len(starts):
                edges[0] = np.stack((a, b)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), *(pa.array(x, pa.binary()) for x in blobs), pa.array(edges, pa.binary())], ["bucket", "shingles", "keys", "sizes", "edges"])

        for batch in batches:
            for _, hashes, offsets, keys, _ in _text_sets(batch):
                n = np.diff(offsets)
                new = seen.new(keys) & (n > 0)
                # Hashes are sorted within each set; a stable sort by (set, count) keeps that among equals.
                owner = np.repeat(np.arange(len(n), dtype=np.uint64), n)
                rank = counters.value[_cells(hashes)].astype(np.uint64)
                hashes = hashes[np.argsort(owner << np.uint64(16) | rank, kind="stable")]
                first = np.where(new, n - least_shared(n, num, den) + np.minimum(LEVEL, least_shared(n, num, den)), 0)
                take = np.repeat(offsets[:-1] - (np.cumsum(first) - first), first) + np.arange(int(first.sum()))
                held.append((hashes[take], np.repeat(keys, first), np.repeat(n, first)))
                if sum(len(x[0]) for x in held) > TASK_ENTRIES:
                    yield from flush()
        if any(len(x[0]) for x in held):
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        release_held()
        shingle, n = (np.concatenate([_unpacked(x.as_buffer(), kind) for x in table.column(name)]) for name, kind in (("shingles", np.uint64), ("sizes", np.int32)))
        key, n = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("keys")]), n.astype(np.int64)
        marked, n = n < 0, np.abs(n)
        order = np.lexsort((~marked, key, n, shingle))
        shingle, key, n, marked = shingle[order], key[order], n[order], marked[order]
        once = np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1]) | (n[1:] != n[:-1])))
        shingle, key, n, marked = shingle[once], key[once], n[once], marked[once]
        many, cut = _of_chains(shingle, n, marked, num, den)
        chained = cut | (many > FEW)
        a, b, _ = _chain(shingle[chained], key[chained], n[chained], num, den)
        earlier = [np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1) for x in table.column("edges")]
        a, b = _forest(np.concatenate([a, *(e[0] for e in earlier)]), np.concatenate([b, *(e[1] for e in earlier)]))
        none = np.zeros(len(a), np.int64)
        return pa.concat_tables([pa.table({"a": a, "b": b, "need": none, "points": none}), _points(shingle[~chained], key[~chained], n[~chained], num, den)])

    entries = docs.select(F.col("text").cast("string")).mapInArrow(prefixes, "bucket long, shingles binary, keys binary, sizes binary, edges binary")
    found = entries.groupBy("bucket").applyInArrow(meet, "a long, b long, need long, points long")
    return found.groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("points").alias("points")).filter("points >= need").select("a", "b")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) of the components of edges (a, b); roots are least members."""
    if not len(a):
        return a, b
    names, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([find(x) for x in range(len(names))])
    member = np.flatnonzero(roots != np.arange(len(names)))
    return names[roots[member]], names[member]


def components(steps: Steps, edges: DataFrame) -> DataFrame:
    """node, root of every node of `edges` (a, b); the root is the component's least node.

    Large-star and small-star rounds over edges, each written to the shared
    folder. Tasks first keep a spanning forest of their edges; once all edges
    fit into one task, that task ends the work.
    """

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_held()
        held, size, most = [], 0, TASK_ENTRIES

        def forest() -> tuple[np.ndarray, np.ndarray]:
            return _forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += batch.num_rows
            if size > most:
                held = [forest()]
                size, most = len(held[0][0]), max(TASK_ENTRIES, 2 * len(held[0][0]))
        a, b = forest() if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def state(table: DataFrame):
        return table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    # a < b throughout.
    current = steps.table(edges.select("a", "b").mapInArrow(thin, "a long, b long"), "cc")
    before = state(current)
    while before[0]:
        if before[0] <= TASK_ENTRIES:
            current = steps.table(current.coalesce(1).mapInArrow(thin, "a long, b long"), "cc")
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: greater neighbours of a go to the least of a and its neighbours.
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # Small star: a node's lesser neighbours, and the node, go to the least of them.
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        pairs = large.join(lowest, "b")
        small = pairs.select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b").unionByName(lowest.select(F.col("m").alias("a"), "b")).distinct()
        current = steps.table(small, "cc")
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _levels(ranks: np.ndarray, offsets: np.ndarray, df: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each set (df of its shingles in order, between offsets), the l of least estimated cost."""
    longest = least_shared(n, num, den)
    first = n - longest + 1
    scan = np.concatenate(([0], np.cumsum(df[ranks])))
    best = np.full(len(n), np.inf)
    chosen = np.ones(len(n), np.int64)
    level = 1
    while level <= longest.max(initial=0):
        here = np.minimum(level, longest)
        postings = scan[offsets[:-1] + first + here - 1] - scan[offsets[:-1]]
        cost = postings + VERIFY_COST * n * postings / here
        better = cost < best
        best[better], chosen[better] = cost[better], here[better]
        level *= 2
    return chosen


def link_sets(keys: np.ndarray, sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join the sets of one cluster as all links would.

    side: 0 for all sets where each is compared with each, or 0 and 1 where only sets of different sides are.
    """
    m = len(sets)
    if m < 2:
        return []
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    n, sets, keys, side = n[order], [sets[i] for i in order], keys[order], side[order]
    crossing = side.any() and not side.all()
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(place)
    by_count = np.empty(len(values), np.int64)
    by_count[np.lexsort((values, df))] = np.arange(len(values))
    counts = np.sort(df)
    offsets = np.concatenate(([0], np.cumsum(n)))
    owner = np.repeat(np.arange(m), n)
    ranks = by_count[place]
    ranks = ranks[np.lexsort((ranks, owner))]
    wanted = _levels(ranks, offsets, counts, n, num, den)
    first = n - least_shared(n, num, den) + 1
    position = np.arange(len(ranks)) - offsets[owner]
    level = np.maximum(1, position - first[owner] + 2)
    inside = (position < (first + wanted - 1)[owner]) & (counts[ranks] > 1)  # a shingle of one set meets none
    p_rank, p_owner, p_level = ranks[inside], owner[inside], level[inside]
    p_offsets = np.concatenate(([0], np.cumsum(np.bincount(p_owner, minlength=m))))
    by_rank = np.argsort(p_rank, kind="stable")
    l_owner, l_level = p_owner[by_rank], p_level[by_rank]
    low, high = np.searchsorted(p_rank[by_rank], p_rank, "left"), np.searchsorted(p_rank[by_rank], p_rank, "right")
    component = np.arange(m)
    links = []
    smallest = np.searchsorted(n, -(-n * num // den), "left")  # partners before this are too small
    for x in range(1, m):
        mine = slice(p_offsets[x], p_offsets[x + 1])
        sizes = high[mine] - low[mine]
        at = np.repeat(low[mine] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        y = l_owner[at]
        need = np.minimum(wanted[x], wanted)
        hit = (y < x) & (y >= smallest[x]) & (l_level[at] <= need[y]) & (np.repeat(p_level[mine], sizes) <= need[y])
        if not hit.any():
            continue
        shared = np.bincount(y[hit], minlength=x)
        maybe = np.flatnonzero((shared >= need[: len(shared)]) & (shared > 0))
        if crossing:
            maybe = maybe[side[maybe] != side[x]]
        mine_set = ranks[offsets[x] : offsets[x + 1]]
        for other in maybe[np.argsort(-shared[maybe], kind="stable")].tolist():
            if component[other] == component[x]:
                continue
            both = len(np.intersect1d(mine_set, ranks[offsets[other] : offsets[other + 1]], assume_unique=True))
            if den * both >= num * (n[x] + n[other] - both):
                links.append((int(keys[other]), int(keys[x])))
                component[component == component[other]] = component[x]
    return links


def with_classes(docs: DataFrame) -> DataFrame:
    """`docs` (its doc_id and text at least) with n, key and key2, which name a row's class."""
    kept = [c for c in docs.columns if c not in ("n", "key", "key2")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, offsets, keys, keys2 in _text_sets(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(offsets)), pa.array(keys), pa.array(keys2)], [*part.schema.names, "n", "key", "key2"])

    small_batches(docs.sparkSession)
    plain = docs.select(*kept).withColumn("text", F.col("text").cast("string"))
    fields = [StructField(c, LongType()) for c in ("n", "key", "key2")]
    return plain.mapInArrow(look, StructType([*plain.schema.fields, *fields]))


def _with_reps(docs: DataFrame, members: DataFrame, many: int) -> DataFrame:
    """The text of each member's least document, with the member's columns."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join((F.broadcast(members) if many <= BROADCAST_IDS else members).withColumnRenamed("rep", "doc_id"), "doc_id")


def member_sets(docs: DataFrame, members: DataFrame, many: int) -> DataFrame:
    """node, root, blocks, block, hashes of `members` (node, rep, n, key, key2, root, blocks)."""
    names = ["node", "root", "blocks"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes, offsets, keys, keys2 in _text_sets(batch):
                blobs = [_packed(hashes[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
                whole = pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(blobs, pa.binary())], [*names, "hashes"])
                # Another text under the same doc_id is not the member that is asked for.
                yield whole.filter(pa.array((keys == part.column("key").to_numpy()) & (keys2 == part.column("key2").to_numpy())))

    sets = _with_reps(docs, members, many).select(*names, "key", "key2", "text").mapInArrow(look, "node long, root long, blocks int, hashes binary")
    return sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _compared(dealt: DataFrame, num: int, den: int, *by: str) -> DataFrame:
    """a, b: links among the sets (node, root, side, hashes) of each group that are in one cluster."""

    def compare(table: pa.Table) -> pa.Table:
        release_held()
        table = table.select(["root", "node", "side", "hashes"]).sort_by([("root", "ascending"), ("node", "ascending"), ("side", "ascending")])
        root, node = table.column("root").to_numpy(), table.column("node").to_numpy()
        side, hashes = table.column("side").to_numpy(), table.column("hashes").combine_chunks()
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (root[1:] != root[:-1])  # repeated rows, pivots and guests in their own block came twice; guests stay as hosts, for other guests
        root, node, side, hashes = root[new], node[new], side[new], hashes.filter(pa.array(new))
        links = []
        starts = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1]))) if len(root) else []
        for a, b in zip(starts, [*starts[1:], len(root)]):
            links += link_sets(node[a:b], [_unpacked(hashes[i].as_buffer(), np.uint64) for i in range(a, b)], side[a:b], num, den)
        pairs = np.sort(np.array(links, np.int64).reshape(-1, 2), axis=1)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return dealt.groupBy(*by).applyInArrow(compare, "a long, b long")


def links_within(steps: Steps, docs: DataFrame, members: DataFrame, num: int, den: int) -> list[DataFrame]:
    """a, b: links that join the members of each cluster as all links would."""
    facts = members.agg(F.count("*"), F.sum("n"), F.max("blocks")).first()
    many, blocks = facts[0], facts[2] or 0
    bins = max(1, -(-many // BLOCK_SETS), -(-(facts[1] or 0) // BLOCK_SHINGLES))
    sets_of = lambda rows, many: member_sets(docs, rows, many).withColumn("side", F.lit(0).cast("long"))
    # Small clusters share a bin. Where they have many texts, those are fetched in rounds, so that their ids can be
    # broadcast and only a round's sets, no texts, are on disk.
    rounds = min(SMALL_ROUNDS, max(1, -(-many * 11 // (BROADCAST_IDS * 10)) if many > BROADCAST_IDS else 1, -(-(facts[1] or 0) // ROUND_SHINGLES)))
    found = []
    for turn in range(rounds):
        now = members.filter("blocks = 1").filter(F.pmod(F.xxhash64(F.lit("round"), "root"), F.lit(rounds)) == turn)
        small = sets_of(now, many if rounds == 1 else now.count()).withColumn("bin", F.pmod(F.xxhash64("root"), F.lit(bins)))
        found.append(steps.table(_compared(small, num, den, "bin"), "links"))
    if blocks < 2:
        return found
    wide = members.filter("blocks > 1")
    size = wide.agg(F.count("*"), F.sum("n")).first()
    large = steps.table(sets_of(wide, size[0]), "cluster-sets")  # read several times
    # PIVOTS sets of each large cluster, one for each order of hashes, come into all of its blocks.
    pivots = large.groupBy("root").agg(*(F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("h"), "node", "hashes")).alias(f"p{i}") for i in range(PIVOTS)), F.max("blocks").alias("blocks"))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    pivots = pivots.select("root", "blocks", everywhere, F.explode(F.array(*(f"p{i}" for i in range(PIVOTS)))).alias("p")).select("root", "block", "p.node", "p.hashes", F.lit(0).cast("long").alias("side"))
    within = large.select("root", "block", "node", "hashes", "side").unionByName(pivots)
    found.append(steps.table(_compared(within, num, den, "root", "block"), "links"))
    # What is not in its cluster's greatest component yet meets every block.
    joined = components(steps, found[-1])
    part = large.select("node", "root", "blocks").distinct().join(joined.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    part = steps.table(part, "cluster-parts")
    sizes = part.groupBy("root", "part").count()
    greatest = sizes.groupBy("root").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    rest = part.join(F.broadcast(greatest) if greatest.count() <= BROADCAST_IDS else greatest, "root").filter("part <> main").select("node")
    rest = steps.table(rest, "cluster-rest")
    left = rest.count()
    if left:
        away = large.join(F.broadcast(rest) if left <= BROADCAST_IDS else rest, "node")
        # Dealt in blocks as well: each comparison is of one block with one block of the rest.
        visits = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        share = steps.table(away.groupBy("root").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("lots")), "cluster-lots")
        few = share.agg(F.count("*"), F.max("lots")).first()
        share = F.broadcast(share) if few[0] <= BROADCAST_IDS else share
        away = steps.table(away.join(share, "root").withColumn("lot", F.pmod(F.xxhash64(F.lit("lot"), "node"), F.col("lots")).cast("int")), "cluster-visitors")
        at_once = max(1, ROUND_SHINGLES // (2 * size[1]))
        for start in range(0, few[1], at_once):
            stop = min(start + at_once, few[1]) - 1
            guests = away.filter(F.col("lot").between(start, stop)).withColumn("block", visits).select("root", "block", "lot", "node", "hashes", F.lit(1).cast("long").alias("side"))
            hosts = large.join(share, "root").filter(F.col("lots") > start).withColumn("lot", F.explode(F.sequence(F.lit(start), F.least(F.col("lots") - 1, F.lit(stop))))).select("root", "block", "lot", "node", "hashes", "side")
            found.append(steps.table(_compared(hosts.unionByName(guests), num, den, "root", "block", "lot"), "links"))
    return found


def clusters(steps: Steps, docs: DataFrame, rows: DataFrame, classes: DataFrame, total: int, num: int, den: int) -> DataFrame:
    """node, rep, n, key, key2, root, blocks of the classes that share a cluster with others."""
    spark = docs.sparkSession
    before, current, done = None, docs, None
    for turn in range(ROUNDS):
        counters = spark.sparkContext.broadcast(shingle_counters(steps, rows))  # CELLS bytes
        edges = steps.table(cluster_edges(current, rows, counters, num, den), "cluster-edges")
        counters.destroy()
        release_worker()
        found = components(steps, edges).withColumnRenamed("node", "key")
        members = (classes if turn == 0 else again).join(found, "key").select("node", "rep", "n", "key", "key2", "root")
        size = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("members"))
        members = steps.table(keyed_join(members, steps.table(size, "cluster-sizes"), ["root"], "members", total), "cluster-members")
        large = F.col("blocks") >= LARGE_BLOCKS
        small = members.filter(~large)
        done = small if done is None else done.unionByName(small)
        again = members.filter(large).drop("root", "blocks")
        many = again.count()
        if not many or before is not None and many > 0.8 * before or turn == ROUNDS - 1:
            return done.unionByName(members.filter(large))
        before = many
        current = steps.table(_with_reps(docs, again.select("rep").distinct(), many), "cluster-texts")
        rows = steps.table(set_rows(current), "set-rows")
    return done


def classified(held: Steps, docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n, key, key2 (the class of its text) and component_id of every document; the result reads tables of `held`."""
    spark = small_batches(docs.sparkSession)
    rows = held.table(set_rows(docs), "set-rows")
    own = rows.filter("doc_id is not null").drop("counters")
    with Steps(spark) as steps:
        grouped = own.filter("n > 0").groupBy("key", "n", "key2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
        classes = steps.table(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
        total = own.count()
        with Steps(spark) as brief:
            members = steps.table(clusters(brief, docs, rows, classes.drop("copies"), total, num, den), "clusters")
        with Steps(spark) as brief:
            links = links_within(brief, docs, members, num, den)
            roots = steps.table(components(brief, reduce(DataFrame.unionByName, links)), "roots")
        grouped = steps.table(classes.join(roots, "node").select("node", "root", "rep", "copies"), "class-groups")
        least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n_classes"))
        named = keyed_join(grouped.select("node", "root"), steps.table(least, "components"), ["root"], "n_classes", total).select("node", "component_id")
        named = classes.join(named, "node", "left").select("key", "n", "key2", F.coalesce("component_id", "rep").alias("component_id"), "copies")
        named = held.table(named, "class-components")
    found = keyed_join(own.filter("n > 0"), named, ["key", "n", "key2"], "copies", total)
    return found.select("doc_id", "n", "key", "key2", "component_id").unionByName(own.filter("n = 0").select("doc_id", "n", "key", "key2", F.col("doc_id").alias("component_id")))


def similarity_classes(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of its component) of every document."""
    return classified(Steps(docs.sparkSession), docs, num, den).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """`docs` without rows that are near copies of a document with a smaller doc_id.

    Rows repeated under one doc_id are one document, unless their texts are of different
    classes: then those of a class that goes are removed and the others stay. Rows without
    a doc_id stay.
    """
    spark = docs.sparkSession
    with Steps(spark) as steps:
        found = classified(steps, docs, num, den)
        copies = written(found.filter("doc_id <> component_id").select("doc_id", "key", "key2").distinct(), scratch(spark, "copies"))
        # Ids of which some texts go and others stay.
        mixed = written(found.filter("doc_id = component_id").select("doc_id").distinct().join(copies.select("doc_id"), "doc_id", "left_semi"), scratch(spark, "mixed-ids"))

    def bounded(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    out = docs.join(bounded(copies.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)
    if mixed.isEmpty():
        return out
    odd = with_classes(docs.join(bounded(mixed), "doc_id", "left_semi").select(*docs.columns))
    named = copies.toDF("_id", "_key", "_key2")
    stay = odd.join(named, (F.col("doc_id") == F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("key2") == F.col("_key2")), "left_anti")
    return out.unionByName(stay.select(*docs.columns))
