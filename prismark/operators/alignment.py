"""Joins that audit what they align: pairs, foreign keys, three-way joins, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def paired_audit(baseline: DataFrame, candidate: DataFrame, key: str, references: list[str]) -> DataFrame:
    """matched, left_only, right_only, mismatched: one full join tells all four."""
    a = baseline.select(key, F.struct(*references).alias("a"))
    b = candidate.select(key, F.struct(*references).alias("b"))
    j = a.join(b, key, "full")
    return j.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"),
        F.count_if(F.col("b").isNull()).alias("left_only"),
        F.count_if(F.col("a").isNull()).alias("right_only"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("mismatched"),
    )


def align(baseline: DataFrame, candidate: DataFrame, key: str, references: list[str]) -> DataFrame:
    """Inner pairs as structs b and c; raises unless keys are unique, equal on both sides, and references agree."""
    for name, side in (("baseline", baseline), ("candidate", candidate)):
        twice = side.groupBy(key).count().filter("count > 1").limit(3).collect()
        if twice:
            raise ValueError(f"{name} has duplicate keys, such as {[r[0] for r in twice]}")
    found = paired_audit(baseline, candidate, key, references).first()
    if found.left_only or found.right_only or found.mismatched:
        raise ValueError(f"the two sides differ: {found.asDict()}")
    return baseline.select(key, F.struct("*").alias("b")).join(candidate.select(key, F.struct("*").alias("c")), key)


def foreign_key_counts(parents: DataFrame, children: DataFrame, key: str, expected: Column) -> DataFrame:
    """Parents whose number of children is not `expected`, with both numbers."""
    counts = children.groupBy(key).agg(F.count("*").alias("found"))
    return parents.join(counts, key, "left").select(key, expected.alias("expected"), F.coalesce("found", F.lit(0)).alias("found")).filter("expected <> found")


def resume_prefix(expected: DataFrame, done: DataFrame, key: str, order: str) -> DataFrame:
    """One row: how many of `expected` are done, the length of the done prefix by (order, key), and done keys that are unknown.

    The prefix ends before the first row that is not done, one value that is
    looked up first; so rows need no numbering.
    """
    rows = expected.select(key, F.struct(F.col(order).alias("o"), F.col(key).alias("k")).alias("place")).join(done.select(key, F.lit(True).alias("is_done")).distinct(), key, "full")
    stop = rows.filter("is_done is null").agg(F.min("place").alias("stop")).first()["stop"]
    within = F.lit(True) if stop is None else F.col("place") < F.struct(F.lit(stop["o"]).alias("o"), F.lit(stop["k"]).alias("k"))
    known = F.col("is_done") & F.col("place").isNotNull()
    return rows.agg(F.count_if(known).alias("n_done"), F.count_if(known & within).alias("prefix_length"), F.count_if(F.col("place").isNull()).alias("n_unknown"))


def missing_work(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do: the idempotent form of resuming."""
    return expected.join(done, key, "left_anti")


def null_safe_diff(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, left_value, right_value of every field that differs, nulls compared as values."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields))).alias("x")).select(key, "x.*")

    return long(left, "left_value").join(long(right, "right_value"), [key, "field"], "full").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """n, lowest, highest, distinct keys, and whether they are exactly 0 .. n - 1."""
    facts = df.agg(F.count("*").alias("n"), F.min(key).cast("bigint").alias("lowest"), F.max(key).cast("bigint").alias("highest"), F.countDistinct(key).alias("n_distinct"))
    return facts.withColumn("dense", (F.col("n") == F.col("n_distinct")) & (F.col("lowest") == 0) & (F.col("highest") == F.col("n") - 1))


def running_offsets(df: DataFrame, group: str, order: str, size: Column) -> DataFrame:
    """`df` with start: the sizes before it in its group."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("start", F.sum(size).over(w) - size)
