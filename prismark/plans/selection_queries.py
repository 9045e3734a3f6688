"""Panels, quotas, splits and allocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismark.functions.hashing import stable_hash
from prismark.operators import allocation, selection
from prismark.plans.registry import query
from prismark.plans.views import RECORDS, records, sql_hash, table


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).drop("text", "n_chars")


@query(f"""
    with r as (select *, {sql_hash('panel', 'id')} as h from {RECORDS}),
    c as (select task, entity, count(*) as n, count(*) * 200.0 / sum(count(*)) over () as share from r group by 1, 2),
    q as (select *, floor(share) + (row_number() over (order by round(share - floor(share), 9) desc, task || '|' || entity) <= 200 - sum(floor(share)) over ())::int as quota from c),
    k as (select r.*, row_number() over (partition by task, entity order by h, id) as rank from r)
    select k.id, k.task, k.entity, k.rank from k join q using (task, entity) where k.rank <= q.quota""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 records, proportional by task and entity."""
    return selection.stratified_sample(_keyed(spark, sf_dir), ["task", "entity"], 200, "panel", "id").select("id", "task", "entity", F.col("rank").cast("bigint").alias("rank"))


@query(f"select id, h from (select doc_id as id, {sql_hash('order', 'doc_id')} as h from documents) order by h, id limit 100")
def stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 in hash order: a top-k report."""
    return selection.hash_topk(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "order", "id", 100)


@query(f"select id, lang from (select doc_id as id, lang, {sql_hash('topk', 'doc_id')} as h from documents) order by h, id limit 64")
def hash_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 lowest hashes."""
    return selection.hash_topk(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "topk", "id", 64).drop("h")


@query(f"select id, position from (select doc_id as id, row_number() over (order by {sql_hash('sample', 'doc_id')}, doc_id) as position from documents) where position <= 50")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 rows that keep their place in hash order."""
    from pyspark.sql import Window as W

    top = selection.hash_topk(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "sample", "id", 50)
    return top.select("id", F.row_number().over(W.orderBy("h", "id")).cast("bigint").alias("position"))


@query("""
    with c as (select lang, count(*) as n, count(*) * 137.0 / sum(count(*)) over () as share from documents group by 1)
    select lang, n, (floor(share) + (row_number() over (order by round(share - floor(share), 9) desc, lang) <= 137 - sum(floor(share)) over ())::int)::bigint as quota from c""")
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """137 rows shared among languages."""
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return selection.largest_remainder(counts, "lang", "n", 137)


@query(f"""
    with r as (select *, {sql_hash('twolevel', 'id')} as h from {RECORDS}),
    t as (select task, count(*) * 120.0 / sum(count(*)) over () as share from r group by 1),
    tq as (select task, floor(share) + (row_number() over (order by round(share - floor(share), 9) desc, task) <= 120 - sum(floor(share)) over ())::int as task_quota from t),
    c as (select task, difficulty, split, count(*) as n from r group by 1, 2, 3),
    s as (select c.*, task_quota, n * task_quota::double / sum(n) over (partition by task) as share from c join tq using (task)),
    q as (select *, floor(share) + (row_number() over (partition by task order by round(share - floor(share), 9) desc, difficulty || '|' || split) <= task_quota - sum(floor(share)) over (partition by task))::int as quota from s),
    k as (select *, row_number() over (partition by task, difficulty, split order by h, id) as rank from r)
    select k.id, k.task, k.difficulty, k.split from k join q using (task, difficulty, split) where rank <= quota""")
def two_level_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 records: quotas by task, then by difficulty and split within each."""
    return selection.two_level_quota(_keyed(spark, sf_dir), "task", ["difficulty", "split"], 120, "twolevel", "id").select("id", "task", "difficulty", "split")


@query(f"""
    with k as (select id, entity, {sql_hash('cover', 'id')} as h, row_number() over (partition by entity order by {sql_hash('cover', 'id')}, id) as rank from {RECORDS})
    select id, entity, 'cover' as role from k where rank = 1 union all (select id, entity, 'extra' from k where rank > 1 order by h, id limit 40)""")
def coverage_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity once, and 40 more."""
    return selection.coverage_selection(_keyed(spark, sf_dir), "entity", 40, "cover", "id").select("id", "entity", "role")


@query(f"""
    with k as (select c_custkey as id, c_mktsegment as segment, c_nationkey as nation, row_number() over (partition by c_mktsegment, c_nationkey order by {sql_hash('split', 'c_custkey')}, c_custkey) as rank,
                      count(*) over (partition by c_mktsegment, c_nationkey) as n from customer),
    t as (select *, least(greatest(round(n * 0.8)::bigint, 1), n - 2) as train from k),
    v as (select *, least(greatest(round(n * 0.1)::bigint, 1), n - train - 1) as val from t)
    select id, segment, nation, case when rank <= train then 'train' when rank <= train + val then 'val' else 'test' end as split from v""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits by position in hash order within segment and nation."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return selection.stratified_split(rows, ["segment", "nation"], (0.8, 0.1), "split", "id").select("id", "segment", "nation", "split")


@query(f"""
    with k as (select id, task, row_number() over (partition by task order by {sql_hash('quota', 'id')}, id) as rank from {RECORDS})
    select id, task from k join (values ('en', 30), ('de', 20), ('fr', 10)) q(task, quota) using (task) where rank <= quota""")
def task_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated numbers of rows by task."""
    quotas = spark.createDataFrame([("en", 30), ("de", 20), ("fr", 10)], "task string, quota int")
    return selection.task_quota_sample(_keyed(spark, sf_dir), "task", quotas, "quota", "id").select("id", "task")


def _options(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """The tasks that each entity offers, over all records; the driver gets a row for each pair."""
    out: dict[str, list[str]] = {}
    for r in _keyed(spark, sf_dir).select("entity", "task").distinct().orderBy("entity", "task").collect():
        out.setdefault(r.entity, []).append(r.task)
    return out


def _sizes(spark: SparkSession, sf_dir: str, field: str) -> dict[str, int]:
    """Number of records by a field."""
    return {r[field]: r.n for r in _keyed(spark, sf_dir).groupBy(field).agg(F.count("*").alias("n")).orderBy(field).collect()}


@query()
def flow_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task for each entity, tasks at their quotas."""
    options = _options(spark, sf_dir)
    supply = {t: sum(t in ts for ts in options.values()) for t in sorted({t for ts in options.values() for t in ts})}
    quotas = allocation.capped_quotas({t: float(n) for t, n in supply.items()}, len(options), supply)
    return spark.createDataFrame(sorted(allocation.assign_one_each(options, quotas, "flow").items()), "entity string, task string")


@query()
def greedy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 records by task deficit, three a chart at most.

    A chart gives no more than its three lowest hashes for a task, so the driver needs only those.
    """
    supply = _sizes(spark, sf_dir, "task")
    quotas = allocation.capped_quotas({t: 1.0 for t in sorted(supply)}, 60, supply)
    rows = selection.lowest_of_each(_keyed(spark, sf_dir).withColumn("id", F.col("id").cast("string")), ["task", "chart"], stable_hash("greedy:candidate", F.col("task"), F.col("id")), "id", 3)
    ids = allocation.greedy_selection([(r.id, r.task, r.chart) for r in rows.select("id", "task", "chart").collect()], quotas, 3)
    return spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, position int")


@query()
def disjoint_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in two panels of equal size that share no chart."""
    sizes = _sizes(spark, sf_dir, "chart")
    first = allocation.exact_panel(sizes, sum(sizes.values()) // 2)
    panels = spark.createDataFrame([(c, 1 if c in first else 2) for c in sizes], "chart string, panel int")
    return _keyed(spark, sf_dir).join(F.broadcast(panels), "chart").select(F.col("id").cast("string").alias("id"), "chart", "panel")


@query()
def nested_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tasks for each entity, slot by slot."""
    options = {g: ts for g, ts in _options(spark, sf_dir).items() if len(ts) > 1}
    slots = allocation.nested_slots(options, {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}, 2, "nested")
    return spark.createDataFrame([(g, t, i) for i, given in enumerate(slots) for g, t in sorted(given.items())] or [], "entity string, task string, slot int")
