"""Views of the test tables that stand in for records, predictions and series.

Each has its SQL form beside it, from which the queries' SQL is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prismark.functions.hashing import SEED, content_hash, hash_number
from prismark.functions.text import parse_number
from prismark.shipping import ship_package

MODELS = ("base", "cand")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sql_hash(namespace: str, *parts: str) -> str:
    """The SQL of stable_hash."""
    return f"substr(sha256('{SEED}:{namespace}'{''.join(f' || chr(58) || ({p})::varchar' for p in parts)}), 1, 16)"


def sql_number(namespace: str, *parts: str) -> str:
    """The SQL of hash_number."""
    return f"('0x' || substr({sql_hash(namespace, *parts)}, 1, 8))::bigint"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: entity, chart, task, difficulty, split."""
    share = hash_number("split2", F.col("source")) % 10
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("entity"), F.concat_ws("_", "source", "lang").alias("chart"), F.col("lang").alias("task"),
        F.when(F.col("n_chars") < 500, "easy").when(F.col("n_chars") < 3000, "medium").otherwise("hard").alias("difficulty"),
        F.when(share < 8, "train").when(share == 8, "val").otherwise("test").alias("split"), "n_chars", "text",
    )


RECORDS = f"""(select doc_id as id, source as entity, source || '_' || lang as chart, lang as task,
    case when n_chars < 500 then 'easy' when n_chars < 3000 then 'medium' else 'hard' end as difficulty,
    case when {sql_number('split2', 'source')} % 10 < 8 then 'train' when {sql_number('split2', 'source')} % 10 = 8 then 'val' else 'test' end as split,
    n_chars, text, sha256(text) as content_hash from documents)"""


def hashed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).withColumn("content_hash", content_hash(F.col("text"))).drop("text")


def _money(cents: Column) -> Column:
    return F.concat((F.floor(cents / 100)).cast("bigint").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def predictions(spark: SparkSession, sf_dir: str, models: tuple[str, ...] = MODELS) -> DataFrame:
    """Orders as predictions of their total by two models, right, nearly right or wrong by hash."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), cents.alias("cents"), F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"),
    ).withColumn("answer", _money(F.col("cents")))
    rows = orders.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    # Drawn in a projection of its own, so that each branch below reads it.
    draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.concat(F.lit(f"{SEED}:"), F.col("model")), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("bigint") % 10
    rows, pick = rows.withColumn("_pick", draw), F.col("_pick")
    scaled = lambda by: F.expr(f"cents * {by} div 100")
    prediction = F.when(pick <= 4, F.col("answer")).when(pick <= 6, _money(scaled(103))).when(pick == 7, _money(scaled(108))).when(pick == 8, "n/a").otherwise(F.concat(F.lit("total "), F.col("answer"), F.lit(" usd")))
    return rows.withColumn("prediction", prediction).withColumn("latency", hash_number("lat", F.col("id")) % 1000 / 100.0).drop("cents", "_pick")


_MONEY = "((({c}) // 100)::varchar || '.' || lpad((({c}) % 100)::varchar, 2, '0'))"
PREDICTIONS = f"""(select id, task, status, year, answer, model, latency,
    case when pick <= 4 then answer when pick <= 6 then {_MONEY.format(c='cents * 103 // 100')} when pick = 7 then {_MONEY.format(c='cents * 108 // 100')}
         when pick = 8 then 'n/a' else 'total ' || answer || ' usd' end as prediction
    from (select *, {_MONEY.format(c='cents')} as answer, ('0x' || substr(sha256('{SEED}:' || model || ':' || id), 1, 8))::bigint % 10 as pick,
                 {sql_number('lat', 'id')} % 1000 / 100.0 as latency
          from (select o_orderkey as id, round(o_totalprice * 100)::bigint as cents, o_orderpriority as task, o_orderstatus as status, year(o_orderdate) as year from orders),
               (values ('base'), ('cand')) m(model)))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with exact and relaxed scores."""
    mine, theirs = parse_number(F.col("prediction")), parse_number(F.col("answer"))
    return predictions(spark, sf_dir).withColumns({
        "exact": (F.col("prediction") == F.col("answer")).cast("double"),
        "relaxed": F.when(mine.isNotNull() & theirs.isNotNull(), F.abs(mine - theirs) / F.nullif(F.abs(theirs), F.lit(0.0)) <= 0.05).otherwise(F.col("prediction") == F.col("answer")).cast("double"),
    })


SCORED = f"""(select *, (prediction = answer)::int::double as exact,
    (case when try_cast(prediction as double) is not null then abs(try_cast(prediction as double) - answer::double) / nullif(abs(answer::double), 0) <= 0.05
          else prediction = answer end)::int::double as relaxed from {PREDICTIONS})"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order: its slices, answer, and scores and predictions of both models."""
    return scored(spark, sf_dir).groupBy("id", "task", "status", "year", "answer").agg(
        *(F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{c}_{m}") for m in MODELS for c in ("exact", "relaxed", "prediction")))


PAIRS = f"""(select id, task, status, year, answer,
    {', '.join(f"max(case when model = '{m}' then {c} end) as {c}_{m}" for m in MODELS for c in ("exact", "relaxed", "prediction"))}
    from {SCORED} group by id, task, status, year, answer)"""


def long_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_base").alias("baseline"), F.col(f"{m}_cand").alias("candidate")) for m in ("exact", "relaxed"))))
    return pairs(spark, sf_dir).select("id", "task", "status", "year", metric.alias("x")).select("id", "task", "status", "year", "x.*")


LONG_PAIRS = f"""(select id, task, status, year, 'exact' as metric, exact_base as baseline, exact_cand as candidate from {PAIRS}
    union all select id, task, status, year, 'relaxed', relaxed_base, relaxed_cand from {PAIRS})"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly revenue, cost, profit and users of each nation."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("year", F.year("o_orderdate")).filter(F.col("year").between(1995, 2000))
    sums = joined.groupBy(F.col("c_nationkey").alias("entity"), "year").agg(
        F.sum(price).cast("double").alias("revenue"), F.sum(F.when(F.col("o_orderstatus") == "F", price).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double").alias("cost"), F.countDistinct("c_custkey").alias("users"))
    return sums.withColumn("profit", F.round(F.col("revenue") - F.col("cost"), 2)).withColumn("arpu", F.round(F.col("revenue") / F.col("users"), 4))


SERIES = """(select *, round(revenue - cost, 2) as profit, round(revenue / users, 4) as arpu from (
    select c_nationkey as entity, year(o_orderdate) as year, sum(o_totalprice::decimal(18,2))::double as revenue,
           sum(case when o_orderstatus = 'F' then o_totalprice::decimal(18,2) else 0 end)::double as cost, count(distinct c_custkey) as users
    from orders join customer on o_custkey = c_custkey where year(o_orderdate) between 1995 and 2000 group by 1, 2))"""
