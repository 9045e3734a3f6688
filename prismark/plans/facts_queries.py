"""Facts of series: growth, trends, labels, numeric support."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismark.lineage import cut_lineage
from prismark.operators import facts, questions, scoring
from prismark.plans.registry import query
from prismark.plans.views import SERIES, series, table

_ENDS = f"""(select entity, max(year) - min(year) as periods, arg_min(revenue, year) as r0, arg_max(revenue, year) as r1, arg_min(users, year) as u0, arg_max(users, year) as u1,
    arg_min(cost, year) as c0, arg_max(cost, year) as c1, arg_min(profit, year) as p0, arg_max(profit, year) as p1, arg_min(arpu, year) as a0, arg_max(arpu, year) as a1, min(profit) as least_profit from {SERIES} group by entity)"""
_CHANGES = f"(select entity, periods, least_profit, r0, r1, (r1 / r0 - 1) * 100 as revenue_change, (u1 / u0 - 1) * 100 as users_change, (case when c0 = 0 then 0 else (c1 / c0 - 1) * 100 end) as cost_change, (p1 / r1 - p0 / r0) * 100 as margin_change, a1 / a0 as arpu_ratio from {_ENDS})"


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.first_and_last(series(spark, sf_dir), "entity", "year", ["revenue", "users", "cost", "profit", "arpu"])
    losses = series(spark, sf_dir).groupBy("entity").agg(F.min("profit").alias("least_profit"))
    change = lambda c: facts.change_pct(F.col(f"first_{c}"), F.col(f"last_{c}"))
    return rows.join(losses, "entity").select(
        "entity", "periods", "least_profit", "first_revenue", "last_revenue", *(change(c).alias(f"{c}_change") for c in ("revenue", "users", "cost")),
        ((F.col("last_profit") / F.col("last_revenue") - F.col("first_profit") / F.col("first_revenue")) * 100).alias("margin_change"), (F.col("last_arpu") / F.col("first_arpu")).alias("arpu_ratio"))


@query(f"select entity, year::int as year, revenue, round((revenue / lag(revenue) over w - 1) * 100, 4) as revenue_yoy_pct, round((users / lag(users) over w - 1) * 100, 4) as users_yoy_pct from {SERIES} window w as (partition by entity order by year)")
def yoy_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change on the year before."""
    rows = facts.year_over_year(series(spark, sf_dir), "entity", "year", "revenue")
    return facts.year_over_year(rows, "entity", "year", "users").select("entity", "year", "revenue", "revenue_yoy_pct", "users_yoy_pct")


@query(f"select entity, round(revenue_change, 4) as revenue_change, round(users_change, 4) as users_change, round(margin_change, 4) as margin_change from {_CHANGES}")
def first_last_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change from the first to the last year."""
    return _ends(spark, sf_dir).select("entity", *(F.round(c, 4).alias(c) for c in ("revenue_change", "users_change", "margin_change")))


@query(f"select entity, round(case when r0 > 0 and r1 > 0 and periods > 0 then (pow(r1 / r0, 1.0 / periods) - 1) * 100 else 0 end, 4) as cagr_pct from {_CHANGES}")
def cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound annual growth."""
    return _ends(spark, sf_dir).select("entity", F.round(facts.cagr_pct(F.col("first_revenue"), F.col("last_revenue"), F.col("periods")), 4).alias("cagr_pct"))


def _label(c: str, t: float) -> str:
    return f"case when {c} > {t} then 'increase' when {c} < -{t} then 'decrease' else 'stable' end"


@query(f"select entity, {_label('revenue_change', 3)} as revenue_trend, {_label('users_change', 3)} as users_trend, {_label('margin_change', 2)} as margin_trend from {_CHANGES}")
def trend_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increase, decrease or stable."""
    thresholds = {"revenue": 3.0, "users": 3.0, "margin": 2.0}
    return _ends(spark, sf_dir).select("entity", *(facts.trend_label(F.col(f"{c}_change"), t).alias(f"{c}_trend") for c, t in thresholds.items()))


_TOP_SHARE = "(select s_nationkey as entity, max(n) * 100.0 / sum(n) as top from (select s_nationkey, l_returnflag, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2) group by 1)"


@query(f"""
    select entity, coalesce(nullif(concat_ws(',', case when revenue_change < -5 then 'revenue_decline' end, case when users_change < -8 then 'user_churn' end,
           case when margin_change < -5 then 'margin_pressure' end, case when least_profit < 0 then 'loss_making' end,
           case when users_change > 20 and revenue_change < users_change - 10 then 'monetization_weakness' end, case when arpu_ratio > 1.35 then 'acquisition_cost_pressure' end,
           case when coalesce(top, 0) >= 55 then 'product_concentration' end), ''), 'execution_volatility') as risks,
           concat_ws(',', case when revenue_change > 25 then 'revenue_growth' end, case when users_change > 20 then 'user_growth' end, case when margin_change > 4 then 'margin_expansion' end) as strengths
    from {_CHANGES} left join {_TOP_SHARE} using (entity)""")
def risk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks and strengths by rule, in order."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    mix = lines.groupBy(F.col("s_nationkey").alias("entity"), "l_returnflag").agg(F.count("*").alias("n")).groupBy("entity").agg((F.max("n") * 100.0 / F.sum("n")).alias("top"))
    r, u, m = (F.col(f"{c}_change") for c in ("revenue", "users", "margin"))
    rows = _ends(spark, sf_dir).join(mix, "entity", "left")
    risks = facts.risk_labels(r, u, m, F.col("least_profit") < 0, F.col("arpu_ratio"), F.coalesce("top", F.lit(0.0)))
    return rows.select("entity", F.array_join(risks, ",").alias("risks"), F.array_join(facts.strength_labels(r, u, m, F.lit(0.0)), ",").alias("strengths"))


@query(f"""
    with v as (select entity, year::double as value, 0.0::double as tolerance from {SERIES} union all
               select entity, round(revenue / 100000, 1), greatest(0.2, abs(round(revenue / 100000, 1)) * 0.005) from {SERIES} union all
               select entity, users::double, 0.2::double from {SERIES}),
    d as (select entity, value, max(tolerance) as tolerance from v group by 1, 2)
    select entity, count(*) as n, round(min(value), 4) as least, round(max(value), 4) as most, round(sum(tolerance), 4) as slack from d group by entity""")
def numeric_support_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct stated values of an entity, each with its greatest tolerance."""
    scaled = F.round(F.col("revenue") / 100000, 1)
    entry = lambda value, slack: F.struct(value.cast("double").alias("value"), slack.cast("double").alias("tolerance"))
    rows = series(spark, sf_dir).select("entity", F.explode(F.array(entry(F.col("year"), F.lit(0)), entry(scaled, F.greatest(F.lit(0.2), F.abs(scaled) * 0.005)), entry(F.col("users"), F.lit(0.2)))).alias("x")).select("entity", "x.*")
    sets = facts.numeric_support(rows, "entity", "value", "tolerance")
    total = F.aggregate("support", F.lit(0.0), lambda s, x: s + x["tolerance"])
    return sets.select("entity", F.size("support").cast("bigint").alias("n"), F.round(F.get("support", F.lit(0))["value"], 4).alias("least"), F.round(F.element_at("support", -1)["value"], 4).alias("most"), F.round(total, 4).alias("slack"))


@query("""
    with s as (select l_shipdate::date as day, l_returnflag, sum(l_quantity) as tokens, round(avg(l_discount), 6) as m from lineitem group by 1, 2)
    select l_returnflag, count(*) as shards, round(sum(m * tokens) / greatest(1, sum(tokens)), 6) as mean from s group by 1""")
def weighted_mean_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of shards, rounded, then weighted."""
    shards = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), "l_returnflag").agg(F.sum("l_quantity").alias("tokens"), F.round(F.avg("l_discount"), 6).alias("m"))
    return shards.groupBy("l_returnflag").agg(F.count("*").alias("shards"), F.round(F.sum(F.col("m") * F.col("tokens")) / F.greatest(F.lit(1), F.sum("tokens")), 6).alias("mean"))


@query()
def synthetic_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded source of entities with its facts; no table stands behind it."""
    return facts.entity_facts(facts.synthetic_entities(spark, 192))


@query("select v.* from (values (192 * 8, 192 * 8, 192 * 2, 192, 4, 4)) v(records, ids, charts, entities, least_a_chart, most_a_chart)")
def entity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of 192 synthetic entities: two views each, four questions a view."""
    records = questions.entity_records(facts.synthetic_entities(spark, 192))
    charts = records.groupBy("chart_id", "entity_id").agg(F.count("*").alias("n"), F.collect_list("id").alias("own"))
    return charts.agg(F.sum("n").alias("records"), F.size(F.array_distinct(F.flatten(F.collect_list("own")))).alias("ids"), F.count("*").alias("charts"), F.countDistinct("entity_id").alias("entities"), F.min("n").alias("least_a_chart"), F.max("n").alias("most_a_chart"))


@query("select metric, least::double as least, most::double as most from (values ('evidence', 1.0, 1.0), ('format', 1.0, 1.0), ('length', 1.0, 1.0), ('numeric', 1.0, 1.0), ('overall', 1.0, 1.0), ('risk', 1.0, 1.0), ('trend', 1.0, 1.0)) v(metric, least, most)")
def record_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference answers of generated records, scored as predictions: every component that applies is 1."""
    records = cut_lineage(questions.entity_records(facts.synthetic_entities(spark, 192))).withColumn("prediction", F.col("answer"))
    meta = F.struct(F.col("metadata.scenario").alias("scenario"), F.lit(None).cast("string").alias("question_type"), F.lit(None).cast("array<string>").alias("year_flags"))
    names = ["numeric", "trend", "format", "evidence", "risk", "length", "overall"]
    scored = scoring.score_rows(records.withColumn("metadata", meta)).select(*names)
    return scored.unpivot([], names, "metric", "score").groupBy("metric").agg(F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("most"))
