"""Reports over two models' answers: every order is a question, and a hash decides how each model answers it.

The SQL states what each kind of answer must lead to; the engine finds it from the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prismark.functions.hashing import hash_number
from prismark.operators import reports, scoring
from prismark.plans.registry import query
from prismark.plans.views import sql_number, table

#: Kinds of answers, by number: what the candidate does (the baseline is right but in the last two).
REASONS = [
    "empty_prediction", "new_token_cap_proxy_hit", "structured_template_intrusion", "numeric_reference_embedded_with_extra_output", "text_reference_embedded_with_extra_output",
    "reference_embedded_with_extra_output", "year_value_or_answer_type_error", "numeric_percent_scale_ambiguity", "numeric_value_error_within_5pct", "numeric_value_error_5_to_10pct", "numeric_value_error_over_10pct",
    "numeric_unit_or_text_output_within_5pct", "numeric_unit_or_text_output_5_to_10pct", "numeric_unit_or_text_output_over_10pct", "numeric_value_embedded_or_multi_number_error", "numeric_missing_or_non_numeric",
    "multi_answer_structure_or_content_error", "text_label_or_content_error",
]
GAINED, BOTH_WRONG = 18, 19


def _scaled(percent: int) -> Column:
    cents = F.expr(f"cents * {percent} div 100")
    return F.concat(F.floor(cents / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def _chosen(options: list[Column | str]) -> Column:
    """The option whose number is `k`."""
    out = None
    for i, option in enumerate(options):
        value = F.lit(option) if isinstance(option, str) else option
        out = F.when(F.col("k") == i, value) if out is None else out.when(F.col("k") == i, value)
    return out


def answered(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    """Prediction rows of one model, `base` or `cand`."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", cents.alias("cents"), (hash_number("answers", F.col("o_orderkey")) % 20).alias("k"))
    total, about = _scaled(100), lambda p: F.concat(F.lit("about "), _scaled(p), F.lit(" units"))
    rows = rows.withColumn("answer", F.when(F.col("k") == 4, "north wind").when(F.col("k") == 5, "['12', 'north']").when(F.col("k") == 6, "1999").when(F.col("k") == 16, "['a1x', 'b2y']").when(F.col("k") == 17, "north").otherwise(total))
    if model == "base":
        said = F.when(F.col("k") >= GAINED, F.lit("zzz")).otherwise(F.col("answer"))
    else:
        said = _chosen([
            " \n", _scaled(150), "【结论】 x", F.concat(F.lit("total "), total, F.lit(" usd")), "it is north wind now", "it is ['12', 'north'] now", "2001", F.concat(total, F.lit("%")), _scaled(103), _scaled(108), _scaled(150),
            about(103), about(108), about(150), F.concat(_scaled(200), F.lit("\n"), _scaled(300)), "n/a", "other", "south", F.col("answer"), "zzz"])
    key = F.col("o_orderkey")
    scenario = F.when(key % 4 > 0, F.concat(F.lit("s"), (key % 4).cast("string")))
    meta = F.struct(scenario.alias("scenario"), F.when(F.col("k") % 3 == 0, "Reasoning").alias("question_type"), F.array().cast("array<string>").alias("year_flags"))
    return rows.withColumn("prediction", said).select(
        F.concat(F.lit("o"), key.cast("string")).alias("id"), F.when(key % 3 == 0, "charts").otherwise("tables").alias("dataset"), F.lit("val").alias("split"), F.concat(F.lit("images/"), key.cast("string"), F.lit(".png")).alias("image"),
        F.col("o_orderpriority").alias("task_type"), F.col("o_orderstatus").alias("view_type"), F.when(F.col("k") == 6, "In which year was it?").otherwise("What is it?").alias("question"),
        "answer", F.lit("{}").alias("ground_truth"), meta.alias("metadata"), "prediction", F.when((F.col("k") == 1) & F.lit(model == "cand"), 128).otherwise(20).alias("completion_tokens"), (hash_number("lat", key) % 1000 / 100.0).alias("latency_seconds"))


_MONEY = "((cents * {p} // 100) // 100)::varchar || '.' || lpad(((cents * {p} // 100) % 100)::varchar, 2, '0')"
_TOTAL = _MONEY.format(p=100)
_CANDIDATE = " ".join(f"when k = {i} then {v}" for i, v in enumerate([
    "' ' || chr(10)", _MONEY.format(p=150), "'【结论】 x'", f"'total ' || {_TOTAL} || ' usd'", "'it is north wind now'", "'it is [''12'', ''north''] now'", "'2001'", f"{_TOTAL} || '%'", _MONEY.format(p=103), _MONEY.format(p=108), _MONEY.format(p=150),
    *(f"'about ' || {_MONEY.format(p=p)} || ' units'" for p in (103, 108, 150)), f"{_MONEY.format(p=200)} || chr(10) || {_MONEY.format(p=300)}", "'n/a'", "'other'", "'south'", "answer", "'zzz'"]))
#: A row for each pair: kinds, texts, and the scores that they must have.
_PAIRS = f"""(select *, case when k >= {GAINED} then 'zzz' else answer end as base, case {_CANDIDATE} end as cand,
    (k < {GAINED})::int::double as base_exact, (k < {GAINED})::int::double as base_relaxed, (k = {GAINED})::int::double as cand_exact, (k in (6, 8, {GAINED}))::int::double as cand_relaxed,
    case when k in (4, 16, 17) then 'text' when k = 5 then 'mixed' else 'numeric' end as answer_kind, case when k % 3 = 0 then 'Reasoning' else 'unknown' end as question_type,
    case when key % 3 = 0 then 'charts' else 'tables' end as dataset
    from (select *, case k when 4 then 'north wind' when 5 then '[''12'', ''north'']' when 6 then '1999' when 16 then '[''a1x'', ''b2y'']' when 17 then 'north' else {_TOTAL} end as answer
          from (select o_orderkey as key, o_orderpriority as task_type, o_orderstatus as view_type, round(o_totalprice * 100)::bigint as cents, {sql_number('answers', 'o_orderkey')} % 20 as k from orders)))"""
_REASON = "case " + " ".join(f"when k = {i} then '{r}'" for i, r in enumerate(REASONS)) + " end"
_SCOPE = "case when k in (6, 8) then 'exact_only_relaxed_unchanged' else 'exact_and_relaxed_regression' end"
_LONG = f"(select p.*, m.metric, case when m.metric = 'exact_match' then base_exact else base_relaxed end as baseline, case when m.metric = 'exact_match' then cand_exact else cand_relaxed end as candidate from {_PAIRS} p, (values ('exact_match'), ('relaxed_accuracy')) m(metric))"
_SCENARIO = "case when key % 4 > 0 then 's' || (key % 4) else 'unknown' end"
_SLICES = {"overall": "'overall'", "dataset": "dataset", "task_type": "task_type", "view_type": "view_type", "scenario": _SCENARIO, **dict.fromkeys(("industry", "difficulty", "task_category", "image_type", "image_style"), "'unknown'")}


def _scored(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    return scoring.score_rows(answered(spark, sf_dir, model))


@query(" union all ".join(f"select '{f}' as field, {v} as value, count(*) as rows, metric, round(avg(candidate), 6) as mean from {_LONG} group by {v}, metric" for f, v in _SLICES.items()))
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of a model's scores, overall and by nine fields."""
    return reports.evaluation_report(_scored(spark, sf_dir, "cand"))


@query(f"""
    select round(avg(l), 6) as mean_latency_seconds, round(median(l), 6) as median_latency_seconds, round(count(*) / sum(l), 6) as samples_per_second, round(avg(t), 3) as mean_completion_tokens
    from (select {sql_number('lat', 'key')} % 1000 / 100.0 as l, case when k = 1 then 128 else 20 end as t from {_PAIRS})""")
def efficiency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency, throughput and tokens of a model's answers."""
    return reports.efficiency_report(answered(spark, sf_dir, "cand"))


@query(" union all ".join(f"select '{f}' as field, {v} as value, metric, count(*) as n, round(avg(baseline), 6) as baseline_mean, round(avg(candidate), 6) as candidate_mean, round(avg(candidate - baseline), 6) as delta from {_LONG} group by {v}, metric" for f, v in _SLICES.items()))
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired means of two models, overall and by nine fields; its intervals are in comparison_intervals."""
    return reports.comparison_report(_scored(spark, sf_dir, "base"), _scored(spark, sf_dir, "cand"), scoring.PUBLIC).drop("low", "high", "p_positive")


@query()
def comparison_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole comparison report with 2000 resamples for each of its numbers."""
    return reports.comparison_report(_scored(spark, sf_dir, "base"), _scored(spark, sf_dir, "cand"), scoring.PUBLIC)


_CELLS = """count(*) as n, round(avg(baseline), 6) as baseline_mean, round(avg(candidate), 6) as candidate_mean, round(avg(candidate - baseline), 6) as delta,
    count(*) filter (candidate < baseline) as regressed, count(*) filter (candidate > baseline) as improved, count(*) filter (candidate = baseline) as unchanged,
    sum(greatest(baseline - candidate, 0)) as regression_mass, sum(greatest(candidate - baseline, 0)) as improvement_mass, count(*) filter (baseline = 1 and candidate = 1) as both_right,
    count(*) filter (baseline = 1 and candidate = 0) as lost, count(*) filter (baseline = 0 and candidate = 1) as gained, count(*) filter (baseline = 0 and candidate = 0) as both_wrong"""


@query(" union all ".join(f"select '{f}' as field, {v} as value, metric, {_CELLS} from {_LONG} group by {v}, metric" for f, v in {"overall": "'overall'", "dataset": "dataset", "answer_kind": "answer_kind", "question_type": "question_type"}.items()))
def migration_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moved between two models, overall, by dataset, kind of answer and type of question."""
    return reports.migration_groups(reports.migration_pairs(_scored(spark, sf_dir, "base"), _scored(spark, sf_dir, "cand")))


def _regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.regressions(reports.migration_pairs(_scored(spark, sf_dir, "base"), _scored(spark, sf_dir, "cand")))


@query(f"select {_REASON} as reason, count(*) as n from {_PAIRS} where k < {GAINED} group by 1")
def reason_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why exact matches were lost: 18 reasons."""
    return _regressions(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"select {_REASON} as reason, {_SCOPE} as scope, count(*) as n from {_PAIRS} where k < {GAINED} group by 1, 2")
def regression_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons by what the relaxed metric says."""
    return _regressions(spark, sf_dir).groupBy("reason", "scope").agg(F.count("*").alias("n"))


@query(f"""
    with r as (select 'o' || key as id, {_REASON} as reason, cand_relaxed - base_relaxed as delta from {_PAIRS} where k < {GAINED})
    select reason, id, delta, rank from (select *, row_number() over (partition by reason order by delta, id) as rank from r) where rank <= 5""")
def topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five worst of each reason: a top-k report."""
    return reports.examples(_regressions(spark, sf_dir)).select("reason", "id", F.col("relaxed_delta").alias("delta"), F.col("rank").cast("bigint").alias("rank"))


_SIGNATURES = f"""(select unnest(['answer_kind_' || answer_kind, case when k = 0 then 'candidate_empty' end, case when k = 1 then 'candidate_token_cap_proxy' end, case when k = 1 then 'new_token_cap_proxy' end,
    case when k = 2 then 'candidate_structured_template' end, case when k = 2 then 'new_structured_template' end, case when k = 2 then 'new_cjk_output' end, case when k in (0, 14) then 'new_multiline_output' end,
    case when k in (3, 4, 5) then 'reference_embedded_in_wrong_output' end, case when length(cand) > greatest(20, 2 * length(base)) then 'candidate_more_than_2x_baseline_chars' end]) as name from {_PAIRS} where k < {GAINED})"""


@query(f"select name as signature, count(*) as n from {_SIGNATURES} where name is not null group by 1")
def signature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of lost pairs, ten kinds; one pair may have several."""
    return reports.signatures(_regressions(spark, sf_dir))


@query(f"""
    with r as (select {_REASON} as reason, {_SCOPE} as scope from {_PAIRS} where k < {GAINED})
    select 'reason' as section, reason as name, count(*) as n from r group by 2 union all select 'scope', scope, count(*) from r group by 2
    union all select 'reason_by_scope', reason || '|' || scope, count(*) from r group by 2 union all select 'signature', name, count(*) from {_SIGNATURES} where name is not null group by 2""")
def migration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of a migration report in one table."""
    return reports.as_counts(reports.migration_report(_scored(spark, sf_dir, "base"), _scored(spark, sf_dir, "cand")))


@query(f"""
    select side, count(*) as rows, count(*) filter (k = 0 and side = 'candidate') as empty_predictions, count(*) filter (k = 1 and side = 'candidate') as token_cap_proxy_hits,
           count(*) filter (k = 2 and side = 'candidate') as structured_marker_outputs, count(*) filter (k = 2 and side = 'candidate') as cjk_outputs, count(*) filter (k in (0, 14) and side = 'candidate') as multiline_outputs,
           round(avg(length(said)), 3) as mean_characters, round(median(length(said)), 3) as median_characters, round(avg(tokens), 3) as mean_completion_tokens, round(median(tokens), 3) as median_completion_tokens
    from (select k, 'baseline' as side, base as said, 20 as tokens from {_PAIRS} union all select k, 'candidate', cand, case when k = 1 then 128 else 20 end from {_PAIRS}) group by side""")
def behavior_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both models' outputs look like."""
    rows = {side: answered(spark, sf_dir, model) for side, model in (("baseline", "base"), ("candidate", "cand"))}
    parts = [reports.behavior_report(r).withColumn("side", F.lit(side)) for side, r in rows.items()]
    return parts[0].unionByName(parts[1])
