"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions only.

A fingerprint holds every hash of a five-word shingle that falls below a fixed
fraction of the hash range, and the least hash in any case, so that a short
text has one too. Sketches of one fraction merge by union, and the share of one
in another estimates containment however unequal the texts are.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text with fewer than
five is one shingle, without words it has none and an empty fingerprint.

Cases: null texts count as empty; two empty fingerprints are alike (1), an
empty and another one are not (0); equal texts have equal fingerprints; the
document after another is the next one in ascending doc_id (repeated ids: in
order of their texts), after the last the first, a lone one follows itself; rows with a null doc_id
come first; very long texts are sketched whole; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: One shingle in 2^KEEP_BITS is kept.
KEEP_BITS = 3
SHINGLE = 5
#: Bytes of text that one range of documents should hold.
RANGE_BYTES = 8 << 20
#: Quantiles of doc_id that tell the ranges; ranges looked through at a time; firsts of ranges that may be broadcast; tasks at most.
KNOTS, LOT, BROADCAST_RANGES, MOST_TASKS = 500, 10_000, 500_000, 50_000


def words(text: Column) -> Column:
    """Words of `text` in order, A-Z lower-cased."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _sketch(hashes: Column) -> Column:
    """Sorted distinct shingle hashes of a text's word hashes that the sketch keeps."""
    n = F.size(hashes)
    shingles = F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(SHINGLE))))).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    return shingles


def _kept(shingles: Column) -> Column:
    below = F.filter(shingles, lambda h: F.shiftrightunsigned(h, 64 - KEEP_BITS) == 0)
    # As unsigned numbers, the least hash is the least with its sign turned.
    turned = F.array_min(F.transform(shingles, lambda h: h.bitwiseXOR(F.lit(-(1 << 63)))))
    least = F.when(F.size(shingles) > 0, F.array(turned.bitwiseXOR(F.lit(-(1 << 63))))).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.array_distinct(F.when(F.size(below) > 0, below).otherwise(least)))


def with_sketch(df: DataFrame, text: str, into: str) -> DataFrame:
    """`df` with the sketch of column `text` as an array of hashes.

    Three projections, so that no array is computed again for each element.
    """
    step = df.withColumn(f"_{into}_words", _word_hashes(F.col(text)))
    step = step.withColumn(f"_{into}_all", _sketch(F.col(f"_{into}_words"))).drop(f"_{into}_words")
    return step.withColumn(into, _kept(F.col(f"_{into}_all"))).drop(f"_{into}_all")


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.hex(h)), ",")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together (but for least hashes kept for short ones)."""
    return F.array_sort(F.array_union(a, b))


def _places(plain: DataFrame, key: Column) -> tuple[Column, int]:
    """Number of a document's range, ascending with its key, and how many there are; they hold RANGE_BYTES of text each, about.

    KNOTS quantiles of the keys, however many documents there are, with straight lines between them.
    """
    size = plain.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    ranges = max(1, min(size.n, -(-(size.b or 0) // RANGE_BYTES)))
    knots = min(KNOTS, ranges)
    cuts = [] if ranges == 1 else sorted({int(c) for c in plain.select(key.alias("k")).stat.approxQuantile("k", [i / knots for i in range(knots + 1)], 0.2 / knots)})
    if len(cuts) < 2:
        return F.lit(0).cast("long"), 1
    each = -(-ranges // (len(cuts) - 1))
    # The last knot at or below the key, by bisection over a constant array.
    table = F.array(*(F.lit(c).cast("long") for c in cuts))
    at = F.greatest(F.lit(0), F.least(F.lit(len(cuts) - 2), F.size(F.filter(table, lambda c: c <= key)) - 1))
    low, high = F.get(table, at), F.get(table, at + 1)
    step = F.floor((key.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double")) * each)
    return at.cast("long") * each + F.greatest(F.lit(0), F.least(F.lit(each - 1), step)).cast("long"), each * (len(cuts) - 1)


def _heads(dealt: DataFrame, key: Column) -> DataFrame:
    """The first document of each range, with the number of the range before it as its place."""
    firsts = dealt.groupBy("place").agg(F.min(key).alias("first"))
    # The next range that holds any document: looked up in lots of LOT ranges, then between lots.
    lot = firsts.withColumn("lot", F.floor(F.col("place") / LOT))
    in_lot = W.partitionBy("lot").orderBy("place")
    inner = lot.withColumn("before", F.lag("place").over(in_lot))
    edges = lot.groupBy("lot").agg(F.max("place").alias("last")).withColumn("group", F.lit(0))
    over = W.partitionBy("group").orderBy("lot")  # a row for each LOT ranges
    ends = edges.select("lot", F.coalesce(F.lag("last").over(over), F.max("last").over(W.partitionBy("group"))).alias("end"))
    before = inner.join(ends, "lot").select("first", F.coalesce("before", "end").alias("place"))
    small = before.count() <= BROADCAST_RANGES
    texts = dealt.select("doc_id", "text", key.alias("first"))
    # Equal ids stay in one range; only the first text of the range's first id is sent ahead.
    return texts.join(F.broadcast(before) if small else before, "first").groupBy("doc_id", "place").agg(F.min("text").alias("text"))


def followed(docs: DataFrame) -> DataFrame:
    """doc_id, text, own (sketch), next_text, next_own: each document and the one after it.

    Documents are dealt by ranges of doc_id; the first of each range is also
    sent to the range before it, so no range has to look into another.
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    place, ranges = _places(plain, key)
    dealt = plain.withColumn("place", place)
    rows = dealt.withColumn("ahead", F.lit(False)).unionByName(_heads(dealt, key).select("doc_id", "text", "place", F.lit(True).alias("ahead")))
    # The window below needs no other exchange.
    rows = with_sketch(rows.repartitionByRange(min(ranges, MOST_TASKS), "place"), "text", "own")
    in_order = W.partitionBy("place").orderBy("ahead", "doc_id", "text")
    after = F.lead(F.struct("text", "own")).over(in_order)
    return rows.withColumn("after", after).filter(~F.col("ahead")).select("doc_id", "text", "own", F.col("after.text").alias("next_text"), F.col("after.own").alias("next_own"))


def with_edits(docs: DataFrame) -> DataFrame:
    """followed()'s columns, n_chars, edited: the last half replaced by the next document's beginning."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    return followed(docs).withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    table = with_edits(docs).withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    table = with_sketch(table, "edited", "changed")
    return table.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
