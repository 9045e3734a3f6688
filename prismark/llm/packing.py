"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Only the first piece of a document can be shorter than a sequence, so only
those are placed; full pieces are sequences of their own. Pieces of over half a
sequence cannot share one and open one each.

A round:

1. Pieces and gaps are range-sorted together, the longest first, with the id as
   a tie-break, so a length that a third of all rows have is cut into ranges too.
2. Each task sweeps its range: every piece, longest first, takes its successor,
   the smallest gap that holds it; what it leaves of the gap may be taken again.
3. Pieces left over look to the ranges before theirs. A task tells how many
   pieces it has left, how long they are at most, and how many of its gaps hold
   any piece of a later range. From these numbers, a few for each range, runs of
   pieces are assigned to runs of gaps, the nearest range first; where several
   want a gap, the lower rank has it. Rows find each other by (range, rank).
4. Gaps are updated, and the next round begins.

Where most pieces found no gap, as many sequences as all waiting tokens need
are opened; they are gaps like others. Once what waits fits into one task, that
task ends the work: best fit over all gaps, new sequences where none holds a piece.

Cases: a null length counts as 0 and is placed like any other; a length above
the capacity is an error; repeated rows and rows without a doc_id are pieces of
their own; a very long text is many pieces; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from prismark.llm.store import scratch, small_batches, written
from prismark.llm.tokens import batch_encoder
from prismark.llm.words import plain_strings, release_held, text_slices

#: Rows, about, of the range that a task sweeps, and that the last task takes at most; ranges at most, which then hold more rows.
RANGE_ROWS, MOST_RANGES = 25_000, 50_000
#: Share of the waiting pieces above which a round that leaves so many makes new sequences be opened.
STALLED = 0.7


def pieces(docs: DataFrame, tokenizer: str, blanks: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, full: each document's ids, its end id last, cut at the front.

    The first piece takes the remainder, so all later ones are full.
    """

    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(tokenizer, blanks)
        for batch in batches:
            for part in text_slices(batch):
                ids, offsets = encoder.encode(plain_strings(part.column("text")), end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                sizes = np.diff(offsets)
                number = -(-sizes // capacity)
                first = sizes - (number - 1) * capacity
                owner = np.repeat(np.arange(len(sizes)), number)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[owner], capacity)
                at = (offsets[owner] + start) * 4
                crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


#: Kinds of rows of a swept range.
PIECE, GAP, LEFT, HELD = 0, 1, 2, 3
#: Pieces: id, size, and where they went (sequence_id, offset) or their rank among those left over.
#: Gaps: id (their sequence), size (what is left), and their rank among those that hold any piece of a later range.
#: A LEFT row: id pieces are left over, sizes from offset to size; rank gaps are left in all.
#: HELD rows: from rank on, id gaps of at least `size` that hold any piece of a later range.
_SWEPT = "kind int, range int, id long, size long, sequence_id long, offset long, rank long"
#: Sequences opened where no gap holds a piece are numbered from here; those of pieces of over half a sequence from 0.
OPENED = 1 << 61


def best_fit(lengths: list[int], gaps: list[tuple[int, int]], capacity: int, opened: int | None = None) -> tuple[list[int | None], list[int], list[tuple[int, int]]]:
    """(sequence or None, offset) of each piece as two lists; gaps left as (gap, sequence), ascending.

    Pieces come longest first; each takes the smallest gap that holds it, of equal ones the
    one that has been there longest. opened: the next free sequence number, where pieces without
    a gap open one. Gaps lie by value, of which there are few, so a step costs the same however many they are.
    """
    free: dict[int, deque[int]] = {}
    for gap, sequence in sorted(gaps):
        free.setdefault(gap, deque()).append(sequence)
    values = sorted(free)
    where: list[int | None] = []
    offsets: list[int] = []
    for length in lengths:
        i = bisect_left(values, length)
        if i < len(values):
            gap = values[i]
            sequence = free[gap].popleft()
            if not free[gap]:
                del free[gap], values[i]
        elif opened is not None:
            gap, sequence, opened = capacity, opened, opened + 1
        else:
            where.append(None)
            offsets.append(0)
            continue
        where.append(sequence)
        offsets.append(capacity - gap)
        if gap > length:
            rest = gap - length
            if rest not in free:
                insort(values, rest)
                free[rest] = deque()
            free[rest].append(sequence)
    return where, offsets, [(gap, sequence) for gap in values for sequence in free[gap]]


def _swept(rows: DataFrame, capacity: int, opened: int | None = None) -> DataFrame:
    """Best fit in each range of `rows` (kind, id, size), which are sorted; pieces may open sequences from `opened` on."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release_held()
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        kind, ids, size = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("kind", "id", "size"))
        piece, gap = kind == PIECE, kind == GAP
        where, offsets, free = best_fit(size[piece].tolist(), list(zip(size[gap].tolist(), ids[gap].tolist())), capacity, opened)
        n, m = len(where), len(free)
        over = np.array([w is None for w in where], bool)
        gaps = np.array([g for g, _ in free], np.int64)
        # Any piece of a later range is no longer than the least value of this one.
        first = int(np.searchsorted(gaps, max(1, int(size.min()))))
        cuts = [first]
        while cuts[-1] < m:
            cuts.append(int(np.searchsorted(gaps, 2 * gaps[cuts[-1]])))
        left = size[piece][over]
        k = len(cuts) - 1
        rank = np.full(n, -1, np.int64)
        rank[over] = np.arange(len(left))
        columns = {
            "kind": (np.repeat([PIECE, GAP, LEFT, HELD], [n, m, 1, k]), pa.int32()),
            "range": (np.full(n + m + 1 + k, TaskContext.get().partitionId()), pa.int32()),
            "id": ([*ids[piece].tolist(), *(s for _, s in free), len(left), *np.diff(cuts).tolist()], pa.int64()),
            "size": ([*size[piece].tolist(), *gaps.tolist(), int(left.max(initial=0)), *gaps[cuts[:-1]].tolist()], pa.int64()),
            "sequence_id": ([*where, *[None] * (m + 1 + k)], pa.int64()),
            "offset": ([*offsets, *[0] * m, int(left.min(initial=capacity)), *[0] * k], pa.int64()),
            "rank": ([*rank.tolist(), *(np.arange(m) - first).tolist(), m, *(np.array(cuts[:-1], np.int64) - first).tolist()], pa.int64()),
        }
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))

    return rows.mapInArrow(sweep, _SWEPT)


def flows(told: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(range, first rank, pieces, range of gaps, first gap rank, pieces in each gap) of runs of pieces to runs of gaps.

    told: (range, kind, id, size, rank) of LEFT and HELD rows. The pieces of a range go to the nearest range
    before it, to the smallest of its gaps first; a gap serves one range in a round.
    """
    out, free = [], []
    for number, kind, count, size, rank in sorted(told, key=lambda t: (t[0], t[1], -t[3])):
        if kind == HELD:
            free.append([number, rank, count, size])
            continue
        at = 0
        while count and free:
            of, gap_rank, gaps, room = free[-1]
            each = max(1, room // size) if size else count
            take = min(count, gaps * each)
            out.append((number, at, take, of, gap_rank, each))
            used = -(-take // each)
            at, count = at + take, count - take
            free[-1][1:3] = gap_rank + used, gaps - used
            if gaps == used:
                free.pop()
    return out


def _matched(over: DataFrame, gaps: DataFrame, runs: DataFrame, capacity: int) -> DataFrame:
    """id, length, sequence_id, offset of the pieces (range, rank, id, size) that runs give a gap."""
    nth = F.col("rank") - F.col("first")
    chosen = over.join(runs, _in_run(over)).select("id", F.col("size").alias("length"), F.col("of").alias("range"), (F.col("gap") + F.floor(nth / F.col("each"))).alias("rank"), nth.alias("nth"))
    in_gap = W.partitionBy("sequence_id").orderBy("nth")  # as many as a gap holds of them
    met = chosen.join(gaps.select("range", "rank", F.col("id").alias("sequence_id"), F.col("size").alias("room")), ["range", "rank"])
    return met.select("id", "length", "sequence_id", (F.lit(capacity) - F.col("room") + F.sum("length").over(in_gap) - F.col("length")).alias("offset"))


def _in_run(over: DataFrame):
    return (over["range"] == F.col("in_range")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))


def pack(items: DataFrame, capacity: int, stored: bool = False) -> DataFrame:
    """id, length, sequence_id, offset for each (id, length) of `items`; ids are distinct.

    stored: `items` is a table as it lies in files, which gives the same rows whenever it is read.
    """
    spark = items.sparkSession
    plain = items.select(F.col("id").cast("long"), F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length"))
    plain = plain if stored else written(plain, scratch(spark, "pack-items"))
    facts = plain.agg(F.max("length"), F.count_if(F.col("length") * 2 <= capacity)).first()
    if (facts[0] or 0) > capacity:
        raise ValueError("a piece is longer than a sequence")
    half = F.col("length") * 2 > capacity
    alone = scratch(spark, "pack-alone")
    placed, swept = [alone], []
    opening = written(plain.filter(half).select("id", "length", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset")), alone)
    gaps = opening.select(F.col("sequence_id").alias("id"), (F.lit(capacity) - F.col("length")).alias("size")).filter("size > 0")
    waiting, left, opened = plain.filter(~half).select("id", F.col("length").alias("size")), facts[1], OPENED
    many = gaps.count() if left else 0
    order = [F.desc("size"), F.desc("kind"), F.asc("id")]
    while left:
        rows = waiting.select(F.lit(PIECE).alias("kind"), "id", "size").unionByName(gaps.select(F.lit(GAP).alias("kind"), "id", "size"))
        last = left + many <= RANGE_ROWS
        dealt = rows.coalesce(1) if last else rows.repartitionByRange(min(MOST_RANGES, -(-(left + many) // RANGE_ROWS)), *order)
        swept.append(scratch(spark, "pack-swept"))
        table = written(_swept(dealt.sortWithinPartitions(*order), capacity, opened if last else None), swept[-1])
        if last:
            break
        told = [tuple(r) for r in table.filter(F.col("kind").isin(LEFT, HELD)).select("range", "kind", "id", "size", "rank", "offset").collect()]  # at most a dozen a range
        before, left = left, sum(t[2] for t in told if t[1] == LEFT)
        if not left:
            break
        least = min(t[5] for t in told if t[1] == LEFT and t[2])
        many = sum(t[4] for t in told if t[1] == LEFT)
        over, gaps = table.filter((F.col("kind") == PIECE) & F.col("sequence_id").isNull()), table.filter(F.col("kind") == GAP)
        runs = flows([t[:5] for t in told])
        if runs:
            to = F.broadcast(spark.createDataFrame(runs, "in_range int, first long, n long, of int, gap long, each long"))
            placed.append(scratch(spark, "pack-matched"))
            met = written(_matched(over, gaps, to, capacity), placed[-1])
            left -= sum(r[2] for r in runs)
            over = over.join(to, _in_run(over), "left_anti")
            gaps = gaps.join(met.groupBy(F.col("sequence_id").alias("id")).agg(F.sum("length").alias("filled")), "id", "left").withColumn("size", F.col("size") - F.coalesce("filled", F.lit(0)))
        waiting, gaps = over.select("id", "size"), gaps.select("id", "size").filter(F.col("size") >= max(1, least))
        if left > before * STALLED:
            need = -(-waiting.agg(F.sum("size")).first()[0] // capacity) + 1
            gaps = gaps.unionByName(spark.range(opened, opened + need).select("id", F.lit(capacity).cast("long").alias("size")))
            opened, many = opened + need, many + need
    result = spark.read.schema("id long, length long, sequence_id long, offset long").parquet(*placed)
    if swept:
        rows = spark.read.schema(_SWEPT).parquet(*swept).filter((F.col("kind") == PIECE) & F.col("sequence_id").isNotNull())
        result = result.unionByName(rows.select("id", F.col("size").alias("length"), "sequence_id", "offset"))
    return result


def packed_pieces(cut: DataFrame, capacity: int) -> DataFrame:
    """`cut` (see pieces) with sequence_id and offset.

    Placed sequences are numbered from 0, those of one full piece by negative
    numbers. Pieces are told apart by a row number that is written with them, so
    repeated and null doc_ids are rows like any other.
    """
    spark = cut.sparkSession
    cut = written(cut.withColumn("_row", F.monotonically_increasing_id()), scratch(spark, "pack-pieces"))
    short = F.col("length") < capacity
    placed = pack(cut.filter(short).select(F.col("_row").alias("id"), "length"), capacity, stored=True).select(F.col("id").alias("_row"), "sequence_id", "offset")
    full = cut.filter(~short).withColumns({"sequence_id": -1 - F.col("_row"), "offset": F.lit(0).cast("long")})
    return cut.filter(short).join(placed, "_row").select(*full.columns).unionByName(full).drop("_row")
