"""Facts of entity time series: growth, trends, risk and strength labels; and a seeded source of such series."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import DoubleType

from prismark.functions.hashing import SEED
from prismark.operators.allocation import seed_number
from prismark.shipping import ship_package


def change_pct(start: Column, end: Column) -> Column:
    """Relative change in percent; from 0 it is 0."""
    return F.when(start == 0, 0.0).otherwise((end / F.nullif(start, F.lit(0.0)) - 1.0) * 100.0)


def cagr_pct(start: Column, end: Column, periods: Column) -> Column:
    """Compound growth a period in percent; 0 unless all three are positive."""
    fine = (start > 0) & (end > 0) & (periods > 0)
    return F.when(fine, (F.pow(end / F.nullif(start, F.lit(0.0)), 1.0 / F.nullif(periods, F.lit(0))) - 1.0) * 100.0).otherwise(0.0)


def trend_label(change: Column, threshold: float = 3.0) -> Column:
    return F.when(change > threshold, "increase").when(change < -threshold, "decrease").otherwise("stable")


def year_over_year(series: DataFrame, entity: str, year: str, value: str) -> DataFrame:
    """`series` with `<value>_yoy_pct`: null in an entity's first year."""
    before = F.lag(value).over(W.partitionBy(entity).orderBy(year))
    return series.withColumn(f"{value}_yoy_pct", F.round(change_pct(before, F.col(value)), 4))


def first_and_last(series: DataFrame, entity: str, year: str, values: list[str]) -> DataFrame:
    """One row an entity: first_ and last_ of each value, periods."""
    ends = [f(v, year).alias(f"{n}_{v}") for v in values for n, f in (("first", F.min_by), ("last", F.max_by))]
    return series.groupBy(entity).agg((F.max(year) - F.min(year)).alias("periods"), *ends)


def risk_labels(revenue: Column, users: Column, margin: Column, any_loss: Column, acquisition_ratio: Column, top_share: Column) -> Column:
    """Labels whose rule holds, in order; a fallback where none does. Arguments are changes in percent (margin: points)."""
    found = F.array_compact(F.array(
        F.when(revenue < -5.0, F.lit("revenue_decline")),
        F.when(users < -8.0, F.lit("user_churn")),
        F.when(margin < -5.0, F.lit("margin_pressure")),
        F.when(any_loss, F.lit("loss_making")),
        F.when((users > 20.0) & (revenue < users - 10.0), F.lit("monetization_weakness")),
        F.when(acquisition_ratio > 1.35, F.lit("acquisition_cost_pressure")),
        F.when(top_share >= 55.0, F.lit("product_concentration")),
    ))
    return F.when(F.size(found) == 0, F.array(F.lit("execution_volatility"))).otherwise(found)


def strength_labels(revenue: Column, users: Column, margin: Column, conversion: Column) -> Column:
    return F.array_compact(F.array(
        F.when(revenue > 25.0, F.lit("revenue_growth")), F.when(users > 20.0, F.lit("user_growth")),
        F.when(margin > 4.0, F.lit("margin_expansion")), F.when(conversion > 0.8, F.lit("conversion_improvement")),
    ))


def numeric_support(values: DataFrame, entity: str, value: str, tolerance: str) -> DataFrame:
    """entity, support: distinct values with the greatest tolerance of each, in order."""
    best = values.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(entity, value).agg(F.max(tolerance).alias(tolerance))
    return best.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(value, tolerance))).alias("support"))


@F.pandas_udf(DoubleType())
def round_half_even(values: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounding of the exact binary value, ties to even: for parity with decimal places stated elsewhere."""
    return pd.Series([None if v is None or v != v else round(float(v), int(d)) for v, d in zip(values, digits)], dtype="float64")


#: Yearly drift of revenue, users and cost by scenario, in percent.
SCENARIOS = {"steady_growth": (9, 6, 6), "fast_growth": (24, 28, 22), "user_growth_weak_revenue": (2, 22, 8), "margin_squeeze": (5, 4, 14), "decline": (-9, -8, -3), "recovery": (12, 8, 3), "volatile": (3, 2, 3), "concentrated": (8, 5, 5)}
INDUSTRIES = ["retail", "software", "logistics", "media", "health", "energy"]
PRODUCTS = ["core", "premium", "services", "other"]


def synthetic_entities(spark: SparkSession, n: int, seed: int = SEED, years: tuple[int, ...] = (2021, 2022, 2023, 2024, 2025)) -> DataFrame:
    """n entities with five-year series; each is made from a seed of its own, so any partitioning gives the same rows."""
    names = list(SCENARIOS)

    def entity(i: int) -> dict:
        rng = random.Random(seed_number(f"entity:{i}", seed))
        scenario, industry = names[i % len(names)], INDUSTRIES[i // len(names) % len(INDUSTRIES)]
        revenue, users, cost = rng.uniform(200, 2000), rng.uniform(50, 900), 0.0
        cost = revenue * rng.uniform(0.55, 0.95)
        out = {k: [] for k in ("revenue", "cost", "profit", "margin", "users", "arpu", "conversion", "cac")}
        conversion, cac = rng.uniform(1, 6), rng.uniform(20, 200)
        for _ in years:
            r, c, u = round(revenue, 1), round(cost, 1), round(users, 1)
            for k, v in zip(out, (r, c, round(r - c, 1), round((r - c) / r * 100, 1), u, round(r * 100 / u, 1), round(conversion, 1), round(cac, 1))):
                out[k].append(v)
            noise = 8 if scenario == "volatile" else 2
            revenue, users, cost = (max(1.0, x * (1 + (d + rng.uniform(-noise, noise)) / 100)) for x, d in zip((revenue, users, cost), SCENARIOS[scenario]))
            conversion, cac = max(0.1, conversion + rng.uniform(-0.4, 0.5)), cac * (1 + rng.uniform(-0.05, 0.12))
        weights = [rng.gammavariate(3, 1) + (9 if scenario == "concentrated" and k == 0 else 0) for k in range(len(PRODUCTS))]
        shares = [round(100 * w / sum(weights), 1) for w in weights[:-1]]
        mix = dict(zip(PRODUCTS, [*shares, round(100 - sum(shares), 1)]))
        views = ["financial", rng.choice(["operations", "growth", "composition", "dashboard"])]
        return {"entity_id": f"entity_{i:06d}", "industry": industry, "scenario": scenario, "years": list(years), **out, "product_mix_pct": mix, "views": views}

    series = ", ".join(f"{k} array<double>" for k in ("revenue", "cost", "profit", "margin", "users", "arpu", "conversion", "cac"))
    schema = f"entity_id string, industry string, scenario string, years array<int>, {series}, product_mix_pct map<string,double>, views array<string>"
    return ship_package(spark).range(n).mapInPandas(lambda parts: (pd.DataFrame([entity(int(i)) for i in part["id"]]) for part in parts if len(part)), schema)


def entity_facts(entities: DataFrame) -> DataFrame:
    """Changes, trends and labels of synthetic_entities' rows."""
    end = lambda c, i: F.element_at(c, i)
    change = {c: change_pct(end(c, 1), end(c, -1)) for c in ("revenue", "cost", "profit", "users", "arpu")}
    margin = end("margin", -1) - end("margin", 1)
    top = F.array_max(F.map_values("product_mix_pct"))
    return entities.select(
        "entity_id", "industry", "scenario",
        *(F.round(v, 1).alias(f"{c}_change_pct") for c, v in change.items() if c != "profit"),
        F.round(margin, 1).alias("margin_change_pp"),
        F.round(cagr_pct(end("revenue", 1), end("revenue", -1), F.size("years") - 1), 1).alias("revenue_cagr_pct"),
        *(trend_label(v, 5.0 if c == "profit" else 3.0).alias(f"{c}_trend") for c, v in change.items()),
        trend_label(margin, 2.0).alias("margin_trend"),
        risk_labels(change["revenue"], change["users"], margin, F.exists("profit", lambda p: p < 0), end("cac", -1) / end("cac", 1), top).alias("risks"),
        strength_labels(change["revenue"], change["users"], margin, end("conversion", -1) - end("conversion", 1)).alias("strengths"),
    )
