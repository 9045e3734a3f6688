"""Reports over scored predictions: evaluation, paired comparison, and what moved between two models.

Each is a table with a row for each number, small whatever the input; `nested`
turns one into the document that is written beside a run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from prismark.functions.hashing import SEED
from prismark.operators import comparison
from prismark.operators.alignment import align
from prismark.operators.scoring import METRICS, aliases, question_type
from prismark.functions.rewards import TRUTH

#: Fields by which reports are sliced; those of META are looked up in `metadata` where the row itself has none.
FIELDS = ["dataset", "task_type", "view_type", "industry", "difficulty", "scenario", "task_category", "image_type", "image_style"]
META = {"scenario", "task_category", "image_type", "image_style"}
#: Fields that must agree between two sets of predictions.
COMPARED = ["dataset", "image", "question", "answer", "ground_truth"]
MIGRATED = ["dataset", "split", "image", "question", "answer", "ground_truth", "metadata"]


def slice_value(rows: DataFrame, field: str) -> Column:
    own = F.col(field) if field in rows.columns else F.lit(None).cast("string")
    known = {f.name for f in rows.schema["metadata"].dataType.fields} if "metadata" in rows.columns else set()
    value = F.coalesce(own, F.col(f"metadata.{field}")) if field in META and field in known else own
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("unknown"))


def evaluation_report(scored: DataFrame, metrics: list[str] = METRICS, fields: list[str] = FIELDS) -> DataFrame:
    """field, value, rows, metric, mean: overall and by each field, from one pass; metrics without a finite value are left out."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    rows = scored.select(*(slice_value(scored, f).alias(f) for f in fields), *metrics)
    grouped = rows.groupingSets([[], *([F.col(f)] for f in fields)], *map(F.col, fields)).agg(F.count("*").alias("rows"), *(F.round(F.avg(finite(m)), 6).alias(m) for m in metrics), *(F.grouping(f).alias(f"_{f}") for f in fields))
    which = F.coalesce(*(F.when(F.col(f"_{f}") == 0, F.lit(f)) for f in fields), F.lit("overall"))
    wide = grouped.select(which.alias("field"), F.coalesce(*fields, F.lit("overall")).alias("value"), "rows", *metrics)
    return wide.unpivot(["field", "value", "rows"], metrics, "metric", "mean").filter("mean is not null")


def efficiency_report(rows: DataFrame) -> DataFrame:
    """One row: latencies, throughput and tokens; null where nothing was measured."""
    return rows.agg(
        F.round(F.avg("latency_seconds"), 6).alias("mean_latency_seconds"), F.round(F.median("latency_seconds"), 6).alias("median_latency_seconds"),
        F.round(F.try_divide(F.count("latency_seconds"), F.sum("latency_seconds")), 6).alias("samples_per_second"), F.round(F.avg("completion_tokens"), 3).alias("mean_completion_tokens"))


def _sliced(pairs: DataFrame, fields: list[str], metrics: list[str]) -> DataFrame:
    """id, field, value, metric, baseline, candidate of aligned pairs b and c (scores of both are not null)."""
    scores = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"b.{m}").alias("baseline"), F.col(f"c.{m}").alias("candidate")) for m in metrics))
    flat = pairs.select("b.*", scores.alias("_scores"))
    named = F.array(F.struct(F.lit("overall").alias("field"), F.lit("overall").alias("value")), *(F.struct(F.lit(f).alias("field"), slice_value(flat, f).alias("value")) for f in fields))
    each = flat.select("id", F.explode(named).alias("f"), "_scores").select("id", "f.*", F.explode("_scores").alias("s"))
    return each.select("id", "field", "value", "s.*").filter("baseline is not null and candidate is not null")


def comparison_report(baseline: DataFrame, candidate: DataFrame, metrics: list[str] = METRICS, fields: list[str] = FIELDS, samples: int = 2000, seed: int = SEED, exact: bool = False) -> DataFrame:
    """field, value, metric, n, means, delta, low, high, p_positive of two scored sets, which must hold the same rows.

    exact: resample by numpy's index matrix (for panels); otherwise by distinct differences, at any size.
    """
    long = _sliced(align(baseline, candidate, "id", COMPARED), fields, metrics)
    keys = ["field", "value", "metric"]
    means = comparison.paired_summary(long, keys)
    interval = comparison.bootstrap_numpy(long, keys, samples, seed) if exact else comparison.bootstrap_by_value(long, keys, samples, seed)
    return means.join(interval.select(*keys, "low", "high", "p_positive"), keys)


def migration_pairs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Aligned pairs of two scored sets with what attribution needs: items, kind and type of the answer, and its aliases."""
    pairs = align(baseline, candidate, "id", MIGRATED)
    with_items = pairs.withColumn("items", comparison.answer_items(F.col("b.answer")))
    return with_items.withColumns({"answer_kind": comparison.answer_kind(F.col("items")), "question_type": question_type(F.col("b.metadata")), "dataset": F.col("b.dataset"), "aliases": aliases(F.from_json("b.ground_truth", TRUTH), F.col("b.answer"))})


def migration_groups(pairs: DataFrame, metrics: tuple[str, ...] = ("exact_match", "relaxed_accuracy")) -> DataFrame:
    """field, value, metric with means, moved rows, masses and the 2 x 2 table: overall, by dataset, answer kind and question type."""
    named = F.array(F.struct(F.lit("overall").alias("field"), F.lit("overall").alias("value")), *(F.struct(F.lit(f).alias("field"), F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit("unknown")).alias("value")) for f in ("dataset", "answer_kind", "question_type")))
    scores = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"b.{m}").alias("baseline"), F.col(f"c.{m}").alias("candidate")) for m in metrics))
    long = pairs.select(F.explode(named).alias("f"), scores.alias("s")).select("f.*", F.explode("s").alias("s")).select("field", "value", "s.*").filter("baseline is not null and candidate is not null")
    keys = ["field", "value", "metric"]
    return comparison.paired_summary(long, keys).join(comparison.transitions(long, keys), keys)


def regressions(pairs: DataFrame, most_tokens: int = 128) -> DataFrame:
    """Pairs whose exact match was lost, with reason, scope and relaxed_delta; each is worked out once."""
    lost = pairs.filter("b.exact_match > c.exact_match")
    said = lambda side: F.coalesce(F.col(f"{side}.prediction"), F.lit(""))
    flags = F.coalesce("b.metadata.year_flags", F.array().cast("array<string>"))
    parts = comparison.reason_parts(F.col("items"), F.col("answer_kind"), F.col("aliases"), F.col("b.question"), flags, said("b"), said("c"), F.col("b.completion_tokens"), F.col("c.completion_tokens"), most_tokens)
    delta = F.col("c.relaxed_accuracy") - F.col("b.relaxed_accuracy")
    return lost.withColumns(parts).withColumns({"reason": comparison.reason(), "relaxed_delta": delta, "scope": comparison.regression_scope(delta)}).drop(*parts)


def signatures(lost: DataFrame, most_tokens: int = 128) -> DataFrame:
    """signature, n: flags of lost pairs, ten kinds; one pair may have several."""
    said = lambda side: F.coalesce(F.col(f"{side}.prediction"), F.lit(""))
    was, now = (comparison.behavior(said(s), F.col(f"{s}.completion_tokens"), most_tokens) for s in ("b", "c"))
    marked = lambda side: F.size(side["marked"]) > 0
    flags = {
        "candidate_empty": now["empty"], "candidate_token_cap_proxy": now["capped"], "new_token_cap_proxy": now["capped"] & ~was["capped"],
        "candidate_structured_template": marked(now), "new_structured_template": marked(now) & ~marked(was),
        "new_cjk_output": now["cjk"] & ~was["cjk"], "new_multiline_output": now["multiline"] & ~was["multiline"],
        "reference_embedded_in_wrong_output": comparison.reference_embedded(F.col("aliases"), said("c")),
        "candidate_more_than_2x_baseline_chars": now["characters"] > F.greatest(F.lit(20), 2 * was["characters"]),
    }
    named = F.array(F.concat(F.lit("answer_kind_"), F.col("answer_kind")), *(F.when(c, F.lit(n)) for n, c in flags.items()))
    return lost.select(F.explode(F.array_compact(named)).alias("signature")).groupBy("signature").agg(F.count("*").alias("n"))


def behavior_report(rows: DataFrame, most_tokens: int = 128) -> DataFrame:
    """One row: what a model's outputs look like."""
    facts = comparison.behavior(F.coalesce("prediction", F.lit("")), F.col("completion_tokens"), most_tokens)
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(facts["empty"]).alias("empty_predictions"), F.count_if(facts["capped"]).alias("token_cap_proxy_hits"), F.count_if(F.size(facts["marked"]) > 0).alias("structured_marker_outputs"),
        F.count_if(facts["cjk"]).alias("cjk_outputs"), F.count_if(facts["multiline"]).alias("multiline_outputs"), F.round(F.avg(facts["characters"]), 3).alias("mean_characters"), F.round(F.median(facts["characters"]), 3).alias("median_characters"),
        F.round(F.avg("completion_tokens"), 3).alias("mean_completion_tokens"), F.round(F.median("completion_tokens"), 3).alias("median_completion_tokens"))


def examples(lost: DataFrame, per_reason: int = 5) -> DataFrame:
    """The worst pairs of each reason: greatest loss of the relaxed metric first, then by id. A top-k report."""
    from pyspark.sql import Window as W

    if per_reason < 0:
        raise ValueError("the number of examples cannot be negative")
    rank = F.row_number().over(W.partitionBy("reason").orderBy("relaxed_delta", "id"))
    side = lambda s: [F.col(f"{s}.{c}").alias(f"{n}_{c}") for n in ("baseline" if s == "b" else "candidate",) for c in ("prediction", "completion_tokens", "exact_match", "relaxed_accuracy")]
    return lost.withColumn("rank", rank).filter(F.col("rank") <= per_reason).select("reason", "rank", "id", "dataset", "answer_kind", "question_type", "relaxed_delta", "b.image", "b.question", "b.answer", *side("b"), *side("c"))


def migration_report(baseline: DataFrame, candidate: DataFrame, most_tokens: int = 128, per_reason: int = 5) -> dict[str, DataFrame]:
    """The parts of a migration report by name; every row must have exact_match and relaxed_accuracy."""
    if most_tokens < 1:
        raise ValueError("the token limit must be positive")
    pairs = migration_pairs(baseline, candidate)
    lost = regressions(pairs, most_tokens)
    side = lambda rows, name: behavior_report(rows, most_tokens).withColumn("side", F.lit(name))
    return {
        "groups": migration_groups(pairs), "behavior": side(baseline, "baseline").unionByName(side(candidate, "candidate")),
        "reasons": lost.groupBy("reason").agg(F.count("*").alias("n")), "scopes": lost.groupBy("scope").agg(F.count("*").alias("n")),
        "reasons_by_scope": lost.groupBy("reason", "scope").agg(F.count("*").alias("n")), "signatures": signatures(lost, most_tokens), "examples": examples(lost, per_reason),
    }


def as_counts(report: dict[str, DataFrame]) -> DataFrame:
    """section, name, n of a migration report's counted parts, in one table."""
    parts = [
        report["reasons"].select(F.lit("reason").alias("section"), F.col("reason").alias("name"), "n"),
        report["scopes"].select(F.lit("scope").alias("section"), F.col("scope").alias("name"), "n"),
        report["reasons_by_scope"].select(F.lit("reason_by_scope").alias("section"), F.concat_ws("|", "reason", "scope").alias("name"), "n"),
        report["signatures"].select(F.lit("signature").alias("section"), F.col("signature").alias("name"), "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


def assert_expected(groups: DataFrame, expected: dict[str, float | int | None]) -> None:
    """Compare a migration report's overall means, and rows, with stated ones, to six places."""
    overall = {r.metric: r for r in groups.filter("field = 'overall'").collect()}  # a row for each metric
    wanted = {"paired_rows": ("exact_match", "n"), "baseline_exact": ("exact_match", "baseline_mean"), "candidate_exact": ("exact_match", "candidate_mean"), "baseline_relaxed": ("relaxed_accuracy", "baseline_mean"), "candidate_relaxed": ("relaxed_accuracy", "candidate_mean")}
    for name, value in expected.items():
        metric, column = wanted[name]
        found = overall[metric][column] if metric in overall else None
        if value is not None and (found is None or round(float(found), 6) != round(float(value), 6)):
            raise ValueError(f"{name} is {found}, not {value}")


def nested(table: DataFrame, keys: list[str]) -> dict:
    """A report's table as a nested document: one level for each key, then the other columns. Rows are as few as the report has numbers."""
    out: dict = {}
    for row in table.collect():
        at = out
        for k in keys:
            at = at.setdefault(str(row[k]), {})
        at.update({c: row[c] for c in table.columns if c not in keys})
    return out
