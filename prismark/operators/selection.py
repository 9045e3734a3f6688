"""Deterministic panels: hash order, top-k, strata, quotas and splits, all as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prismark.functions.hashing import stable_hash


def stable_order(df: DataFrame, namespace: str, key: str) -> DataFrame:
    """`df` with `h`, by which (then by key) it is to be ordered."""
    return df.withColumn("h", stable_hash(namespace, F.col(key)))


def hash_topk(df: DataFrame, namespace: str, key: str, k: int) -> DataFrame:
    """The k rows of lowest hash: a top-k, never a full sort."""
    return stable_order(df, namespace, key).orderBy("h", key).limit(k)


def lowest_of_each(df: DataFrame, groups: list[str], h: Column, key: str, k: int) -> DataFrame:
    """The k rows of lowest `h` of every group; tasks cut their rows to k a group before they are dealt out."""
    rank = F.row_number().over(W.partitionBy(*groups).orderBy("h", key))
    return df.withColumn("h", h).withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def largest_remainder(weights: DataFrame, key: str, weight: str, total: Column | int) -> DataFrame:
    """`weights` with quota: shares of `total` in whole numbers; leftovers go to the largest fractions, then by key.

    The table has a row per stratum, so a window over all of it is small.
    """
    everything = W.partitionBy()
    share = F.col(weight) * F.lit(total) / F.sum(weight).over(everything)
    rows = weights.filter(F.col(weight) > 0).withColumn("_share", share).withColumn("_floor", F.floor("_share"))
    rest = F.lit(total) - F.sum("_floor").over(everything)
    rank = F.row_number().over(W.orderBy(F.desc(F.round(F.col("_share") - F.col("_floor"), 9)), key))
    return rows.withColumn("quota", (F.col("_floor") + (rank <= rest).cast("int")).cast("bigint")).drop("_share", "_floor")


def ranked_in(df: DataFrame, strata: list[str], namespace: str, key: str) -> DataFrame:
    """`df` with `rank` in hash order within each stratum."""
    return stable_order(df, namespace, key).withColumn("rank", F.row_number().over(W.partitionBy(*strata).orderBy("h", key)))


def within_quotas(df: DataFrame, strata: list[str], quotas: DataFrame, namespace: str, key: str) -> DataFrame:
    """The rows of each stratum up to its quota (`quotas`: strata, quota), lowest hashes first, with `rank`.

    The greatest quota is a constant bound of all ranks, by which tasks cut their rows before they are dealt out.
    """
    most = quotas.agg(F.max("quota")).first()[0] or 0
    picked = ranked_in(df, strata, namespace, key).filter(F.col("rank") <= most)
    return picked.join(quotas, strata).filter(F.col("rank") <= F.col("quota")).drop("quota")


def stratified_sample(df: DataFrame, strata: list[str], total: int, namespace: str, key: str) -> DataFrame:
    """`total` rows, proportional by strata, lowest hashes first in each."""
    name = F.concat_ws("|", *strata)
    quotas = largest_remainder(df.groupBy(*strata).count().withColumn("stratum", name), "stratum", "count", total).select(*strata, "quota")
    return within_quotas(df, strata, quotas, namespace, key)


def task_quota_sample(df: DataFrame, task: str, quotas: DataFrame, namespace: str, key: str) -> DataFrame:
    """As many rows of each task as `quotas` (task, quota) says, lowest hashes first; a task that has fewer is an error."""
    short = quotas.join(df.groupBy(task).agg(F.count("*").alias("_n")), task, "left").filter(F.coalesce("_n", F.lit(0)) < F.col("quota")).collect()  # a row for each task
    if short:
        raise ValueError(f"too few rows for the quotas: {[(r[task], r._n or 0, r.quota) for r in short]}")
    return within_quotas(df, [task], quotas, namespace, key)


def two_level_quota(df: DataFrame, task: str, strata: list[str], total: int, namespace: str, key: str) -> DataFrame:
    """Quota by task first, then within each task by strata."""
    by_task = largest_remainder(df.groupBy(task).count(), task, "count", total).select(task, F.col("quota").alias("task_quota"))
    cells = df.groupBy(task, *strata).count().join(by_task, task).withColumn("stratum", F.concat_ws("|", *strata))
    inside = W.partitionBy(task)
    share = F.col("count") * F.col("task_quota") / F.sum("count").over(inside)
    cells = cells.withColumn("_share", share).withColumn("_floor", F.floor("_share"))
    rest = F.col("task_quota") - F.sum("_floor").over(inside)
    order = F.row_number().over(inside.orderBy(F.desc(F.round(F.col("_share") - F.col("_floor"), 9)), "stratum"))
    quotas = cells.select(task, *strata, (F.col("_floor") + (order <= rest).cast("int")).alias("quota"))
    return within_quotas(df, [task, *strata], quotas, namespace, key)


def coverage_selection(df: DataFrame, entity: str, extra: int, namespace: str, key: str) -> DataFrame:
    """The first row of every entity in hash order, and `extra` more of the lowest hashes."""
    # An entity gives `extra` more rows at most.
    ranked = ranked_in(df, [entity], namespace, key).filter(F.col("rank") <= extra + 1)
    more = ranked.filter("rank > 1").orderBy("h", key).limit(extra)
    return ranked.filter("rank = 1").withColumn("role", F.lit("cover")).unionByName(more.withColumn("role", F.lit("extra")))


def stratified_split(df: DataFrame, strata: list[str], ratios: tuple[float, float], namespace: str, key: str) -> DataFrame:
    """`df` with split by position in hash order: each stratum of three or more has all three."""
    within = W.partitionBy(*strata)
    ranked = ranked_in(df, strata, namespace, key).withColumn("n", F.count("*").over(within))
    return _positioned(ranked, ratios).drop("n")


def global_split(df: DataFrame, ratios: tuple[float, float], namespace: str, key: str, small: int = 100) -> DataFrame:
    """`df` with split by position in the hash order of all rows: for fewer than `small` rows, whose strata are too thin."""
    n = df.count()
    if n >= small:
        raise ValueError(f"{n} rows are enough for stratified_split")
    ranked = stable_order(df, namespace, key).withColumn("rank", F.row_number().over(W.orderBy("h", key))).withColumn("n", F.lit(n))
    return _positioned(ranked, ratios).drop("n")


def _positioned(ranked: DataFrame, ratios: tuple[float, float]) -> DataFrame:
    train = F.least(F.greatest(F.round(F.col("n") * ratios[0]).cast("bigint"), F.lit(1)), F.col("n") - 2)
    val = F.least(F.greatest(F.round(F.col("n") * ratios[1]).cast("bigint"), F.lit(1)), F.col("n") - train - 1)
    split = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + val, "val").otherwise("test")
    return ranked.withColumn("split", split)


#: Rows of one range that `positions` numbers in a task, and ranges at most.
RANGE_ROWS, MOST_RANGES = 1_000_000, 500


def positions(df: DataFrame, order: str) -> DataFrame:
    """`df` with `at`: 0, 1, .. by `order`, which no two rows share.

    Rows are numbered within ranges of `order`; only the ranges' sizes are summed up. The bounds
    are keys of a few rows, the same whenever they are looked up.
    """
    ranges = min(MOST_RANGES, df.count() // RANGE_ROWS + 1)
    some = sorted(r[0] for r in df.select(order).orderBy(F.xxhash64(order), order).limit(20 * (ranges - 1)).collect()) if ranges > 1 else []
    bounds = F.array(*map(F.lit, some[::20]))
    dealt = df.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col(order))) if some else F.lit(0))
    before = dealt.groupBy("_range").count().select("_range", (F.sum("count").over(W.orderBy("_range")) - F.col("count")).alias("_before"))  # a row for each range
    own = F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn("at", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")
