"""Two prediction sets pair by pair: summaries, bootstrap, transitions, attribution, gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from prismark.functions.hashing import SEED
from prismark.functions.text import NUMBER_ATTRIBUTION, list_items, normalize_answer, parse_number

# Section tags, and what marks text as Chinese or as a question for a year.
STRUCTURED_MARKERS = ["【结论】", "【数据依据】", "【风险】", "【建议】"]
CJK = r"[㐀-鿿]"
YEAR_QUESTION = r"(?i)\b(?:year|when)\b|年份|哪年|何时"
EPSILON = 1e-12


def paired_summary(pairs: DataFrame, group: list[str]) -> DataFrame:
    """n, means and mean difference of columns baseline and candidate."""
    return pairs.groupBy(*group).agg(F.count("*").alias("n"), F.round(F.avg("baseline"), 6).alias("baseline_mean"), F.round(F.avg("candidate"), 6).alias("candidate_mean"), F.round(F.avg(F.col("candidate") - F.col("baseline")), 6).alias("delta"))


def transitions(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Regressed, improved and unchanged rows and masses; the 2 x 2 table where all values are 0 or 1."""
    d = F.col("candidate") - F.col("baseline")
    is_one = lambda c: F.abs(F.col(c) - 1) <= EPSILON
    binary = F.bool_and((F.abs(F.col("baseline")) <= EPSILON) | is_one("baseline")) & F.bool_and((F.abs(F.col("candidate")) <= EPSILON) | is_one("candidate"))
    cells = {"both_right": is_one("baseline") & is_one("candidate"), "lost": is_one("baseline") & ~is_one("candidate"), "gained": ~is_one("baseline") & is_one("candidate"), "both_wrong": ~is_one("baseline") & ~is_one("candidate")}
    return pairs.groupBy(*group).agg(
        F.count_if(d < -EPSILON).alias("regressed"), F.count_if(d > EPSILON).alias("improved"), F.count_if(F.abs(d) <= EPSILON).alias("unchanged"),
        F.round(F.sum(F.greatest(-d, F.lit(0.0))), 6).alias("regression_mass"), F.round(F.sum(F.greatest(d, F.lit(0.0))), 6).alias("improvement_mass"),
        *(F.when(binary, F.count_if(c)).alias(n) for n, c in cells.items()),
    )


def resampled_means(deltas: np.ndarray, samples: int, seed: int, cells: int = 1 << 20) -> np.ndarray:
    """Means of `samples` resamples, as by the index matrix `integers(0, n, size=(samples, n), dtype=int32)`.

    The generator's stream is the same however it is cut, so about `cells` indices are drawn at a time.
    Small whole differences have the same sum in any order; others are summed by whole rows.
    """
    n, rng = len(deltas), np.random.default_rng(seed)
    whole = bool(np.all(np.abs(deltas) <= 127) and np.all(deltas == np.rint(deltas)))
    values, means = deltas.astype(np.int8) if whole else deltas, np.empty(samples)
    step = max(1, cells // n)
    for i in range(0, samples, step):
        rows = min(step, samples - i)
        if whole and n > cells:
            means[i] = sum(int(values[rng.integers(0, n, size=min(cells, n - k), dtype=np.int32)].sum(dtype=np.int64)) for k in range(0, n, cells)) / n
        else:
            part = values[rng.integers(0, n, size=(rows, n), dtype=np.int32)]
            means[i : i + rows] = part.sum(axis=1, dtype=np.int64) / n if whole else part.mean(axis=1)
    return means


def bootstrap_numpy(pairs: DataFrame, group: list[str], samples: int = 2000, seed: int = SEED, cells: int = 1 << 20) -> DataFrame:
    """Percentile interval of the mean difference by numpy's generator, the same seed for every group.

    A group's differences lie in one task, as this resampling is defined on the
    whole vector in order of id: for evaluation panels, not for raw corpora
    (see bootstrap_by_value). Spark sorts them, and the task holds no more than
    the differences, at most two rows of the index matrix or `cells` of it.
    """
    kinds = ", ".join(f"{g} {pairs.schema[g].dataType.simpleString()}" for g in group)
    fields = [*(pairs.schema[g] for g in group), *(StructField(c, LongType() if c == "n" else DoubleType()) for c in ("n", "delta", "low", "high", "p_positive"))]
    schema = to_arrow_schema(StructType([StructField(f.name, f.dataType) for f in fields]))

    def estimate(key: tuple, parts: list[np.ndarray]) -> pa.RecordBatch:
        deltas = np.concatenate(parts)
        parts.clear()
        values = resampled_means(deltas, samples, seed, cells)
        row = {"n": len(deltas), "delta": round(float(deltas.mean()), 6), "low": round(float(np.quantile(values, 0.025)), 6), "high": round(float(np.quantile(values, 0.975)), 6), "p_positive": round(float((values > 0).mean()), 6)}
        return pa.RecordBatch.from_pylist([{**dict(zip(group, key)), **row}], schema)

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = (), []
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(g).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for g in group]
            cuts = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1).tolist()
            deltas = batch.column("_delta").to_numpy(zero_copy_only=False)
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
                here = tuple(batch.column(g)[i].as_py() for g in group)
                if parts and here != key:
                    yield estimate(key, parts)
                key = here
                parts.append(deltas[i:j].astype(np.float64))
        if parts:
            yield estimate(key, parts)

    deltas = pairs.select(*group, F.col("id").alias("_id"), (F.col("candidate") - F.col("baseline")).cast("double").alias("_delta"))
    ordered = deltas.repartition(*group).sortWithinPartitions(*group, F.col("_id").asc_nulls_last()).drop("_id")
    return ordered.mapInArrow(by_group, f"{kinds}, n long, delta double, low double, high double, p_positive double")


def bootstrap_by_value(pairs: DataFrame, group: list[str], samples: int = 2000, seed: int = SEED, cells: int = 4_000_000) -> DataFrame:
    """The interval at any number of rows: a resample is a draw of how often each distinct difference occurs.

    Rows are counted by (group, difference) before they are dealt out; a group's task gets its distinct
    differences, three for a metric of 0 and 1. `cells` bounds the counts that are drawn at a time.
    """
    def estimate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("delta")
        values, counts = pdf["delta"].to_numpy(np.float64), pdf["n"].to_numpy(np.int64)
        n, rng, means = int(counts.sum()), np.random.default_rng(seed), []
        step = max(1, cells // len(values))
        for i in range(0, samples, step):
            means.append(rng.multinomial(n, counts / n, size=min(step, samples - i)) @ values / n)
        drawn = np.concatenate(means)
        row = {"n": n, "delta": round(float(counts @ values / n), 6), "replicates": samples, "low": round(float(np.quantile(drawn, 0.025)), 6), "high": round(float(np.quantile(drawn, 0.975)), 6), "p_positive": round(float((drawn > 0).mean()), 6)}
        return pd.DataFrame([{**{g: pdf[g].iloc[0] for g in group}, **row}])

    kinds = ", ".join(f"{g} {pairs.schema[g].dataType.simpleString()}" for g in group)
    counted = pairs.filter("baseline is not null and candidate is not null").groupBy(*group, (F.col("candidate") - F.col("baseline")).alias("delta")).agg(F.count("*").alias("n"))
    return counted.groupBy(*group).applyInPandas(estimate, f"{kinds}, n long, delta double, replicates int, low double, high double, p_positive double")


def behavior(prediction: Column, tokens: Column, most_tokens: int) -> dict[str, Column]:
    """What an output looks like, whatever the answer."""
    return {
        "empty": normalize_answer(prediction) == "",
        "capped": F.coalesce(tokens >= most_tokens, F.lit(False)),
        "marked": F.array_compact(F.array(*(F.when(F.contains(prediction, F.lit(m)), F.lit(m)) for m in STRUCTURED_MARKERS))),
        "cjk": prediction.rlike(CJK),
        "multiline": F.contains(prediction, F.lit("\n")),
        "characters": F.char_length(prediction),
    }


def found_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER_ATTRIBUTION), F.lit(0))


def answer_kind(items: Column) -> Column:
    """numeric, mixed or text, by how many of the items are numbers."""
    n = F.size(F.filter(items, lambda x: parse_number(x).isNotNull()))
    return F.when(n == F.size(items), "numeric").when(n > 0, "mixed").otherwise("text")


def answer_items(answer: Column) -> Column:
    return list_items(answer)


def error_band(error: Column) -> Column:
    return F.when(error <= 0.05, "within_5pct").when(error <= 0.10, "5_to_10pct").otherwise("over_10pct")


def relative_error(target: Column, value: Column) -> Column:
    return F.when(target == 0, F.when(value == 0, 0.0).otherwise(float("inf"))).otherwise(F.abs(value - target) / F.abs(F.nullif(target, F.lit(0.0))))


def reference_embedded(aliases: Column, prediction: Column) -> Column:
    """Whether the output contains an alias: a text of two characters or more, or an equal number."""
    values = F.transform(found_numbers(prediction), parse_number)

    def inside(alias: Column) -> Column:
        text, number = normalize_answer(alias), parse_number(alias)
        return F.when(number.isNotNull(), F.exists(values, lambda v: F.coalesce(F.abs(v - number) <= EPSILON, F.lit(False)))).otherwise((F.char_length(text) >= 2) & F.contains(normalize_answer(prediction), text))

    return F.exists(aliases, inside)


def reason_parts(items: Column, kind: Column, aliases: Column, question: Column, year_flags: Column, baseline: Column, candidate: Column, baseline_tokens: Column, candidate_tokens: Column, most_tokens: int) -> dict[str, Column]:
    """What the rules of `reason` look at, each to be a column of its own, so that it is worked out once."""
    was, now = behavior(baseline, baseline_tokens, most_tokens), behavior(candidate, candidate_tokens, most_tokens)
    target = F.when(F.size(items) == 1, parse_number(F.get(items, F.lit(0))))
    return {
        "_kind": kind, "_empty": now["empty"], "_capped": now["capped"] & ~was["capped"], "_marked": (F.size(now["marked"]) > 0) & (F.size(was["marked"]) == 0),
        "_embedded": reference_embedded(aliases, candidate), "_target": target, "_numbers": found_numbers(candidate), "_value": parse_number(candidate), "_many": F.size(items) > 1,
        "_asks_year": question.rlike(YEAR_QUESTION) | F.coalesce(F.array_contains(F.transform(year_flags, F.upper), "YES"), F.lit(False)), "_changed": normalize_answer(baseline) != normalize_answer(candidate),
    }


def reason() -> Column:
    """Why a pair got worse: the first rule that holds, from the columns of `reason_parts`."""
    kind, target, numbers, value, embedded = (F.col(c) for c in ("_kind", "_target", "_numbers", "_value", "_embedded"))
    year = target.isNotNull() & (target == F.floor(target)) & target.between(1800, 2200) & F.col("_asks_year")
    only = F.when(F.size(numbers) == 1, F.get(numbers, F.lit(0)))
    percent = only.contains("%") & (F.abs(F.translate(only, ",% ", "").try_cast("double") - target) <= EPSILON)
    token = parse_number(only)
    numeric = kind == "numeric"
    return (
        F.when(F.col("_empty"), "empty_prediction")
        .when(F.col("_capped"), "new_token_cap_proxy_hit")
        .when(F.col("_marked"), "structured_template_intrusion")
        .when(embedded & numeric, "numeric_reference_embedded_with_extra_output")
        .when(embedded & (kind == "text"), "text_reference_embedded_with_extra_output")
        .when(embedded, "reference_embedded_with_extra_output")
        .when(numeric & year, "year_value_or_answer_type_error")
        .when(numeric & F.coalesce(percent, F.lit(False)), "numeric_percent_scale_ambiguity")
        .when(numeric & target.isNotNull() & value.isNotNull(), F.concat(F.lit("numeric_value_error_"), error_band(relative_error(target, value))))
        .when(numeric & target.isNotNull() & token.isNotNull(), F.concat(F.lit("numeric_unit_or_text_output_"), error_band(relative_error(target, token))))
        .when(numeric & (F.size(numbers) > 0), "numeric_value_embedded_or_multi_number_error")
        .when(numeric, "numeric_missing_or_non_numeric")
        .when((kind == "mixed") | F.col("_many"), "multi_answer_structure_or_content_error")
        .when(F.col("_changed"), "text_label_or_content_error")
        .otherwise("unclassified_score_change")
    )


def regression_scope(relaxed_delta: Column) -> Column:
    return F.when(relaxed_delta < -EPSILON, "exact_and_relaxed_regression").when(relaxed_delta > EPSILON, "exact_regression_relaxed_improved").otherwise("exact_only_relaxed_unchanged")


def gate_checks(summary: DataFrame, thresholds: DataFrame) -> DataFrame:
    """`thresholds` (kind, metric, min_delta, min_probability) against `summary` (metric, delta, p_positive); a missing metric fails."""
    return thresholds.join(summary, "metric", "left").select(
        "kind", "metric", "delta", "min_delta",
        F.coalesce((F.col("delta") >= F.col("min_delta")) & (F.coalesce("min_probability", F.lit(0.0)) <= F.coalesce("p_positive", F.lit(0.0))), F.lit(False)).alias("passed"),
    )


def verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"), F.bool_and("passed").alias("passed"))
