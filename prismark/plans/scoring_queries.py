"""Scores of texts and predictions, their aggregates, comparisons and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from prismark.functions import losses, rewards, text
from prismark.operators import comparison, gates
from prismark.plans.registry import query
from prismark.plans.views import LONG_PAIRS, PREDICTIONS, SCORED, long_pairs, predictions, scored, table


@query(f"select model, round(avg(exact), 6) as exact, round(avg(relaxed), 6) as relaxed from {SCORED} group by model")
def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each metric by model; nulls and values that are not finite do not count."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    return scored(spark, sf_dir).groupBy("model").agg(*(F.round(F.avg(finite(c)), 6).alias(c) for c in ("exact", "relaxed")))


@query(" union all ".join(f"select '{f}' as field, coalesce(nullif({f}::varchar, ''), 'unknown') as value, model, count(*) as n, round(avg(relaxed), 6) as relaxed from {SCORED} group by {f}, model" for f in ("task", "status", "year")))
def slice_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by three slices from one pass."""
    rows = scored(spark, sf_dir).select("model", "relaxed", *(F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.lit("unknown")).alias(f) for f in ("task", "status", "year")))
    fields = ["task", "status", "year"]
    grouped = rows.groupingSets([[F.col("model"), F.col(f)] for f in fields], F.col("model"), *map(F.col, fields)).agg(F.count("*").alias("n"), F.round(F.avg("relaxed"), 6).alias("relaxed"), F.grouping_id().alias("g"))
    which = F.when(F.col("g") == 3, "task").when(F.col("g") == 5, "status").otherwise("year")
    return grouped.select(which.alias("field"), F.coalesce(*fields).alias("value"), "model", "n", "relaxed")


@query(f"select model, count(*) as n, round(avg(latency), 6) as mean_latency, round(median(latency), 6) as median_latency, round(count(*) / sum(latency), 6) as rows_per_second from {PREDICTIONS} group by model")
def efficiency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency and throughput by model."""
    return predictions(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("latency"), 6).alias("mean_latency"), F.round(F.median("latency"), 6).alias("median_latency"), F.round(F.try_divide(F.count("*"), F.sum("latency")), 6).alias("rows_per_second"))


@query(f"select metric, count(*) as n, round(avg(baseline), 6) as baseline_mean, round(avg(candidate), 6) as candidate_mean, round(avg(candidate - baseline), 6) as delta from {LONG_PAIRS} group by metric")
def paired_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of two models and their mean difference."""
    return comparison.paired_summary(long_pairs(spark, sf_dir), ["metric"])


@query(f"""
    select metric, count(*) filter (candidate < baseline) as regressed, count(*) filter (candidate > baseline) as improved, count(*) filter (candidate = baseline) as unchanged,
           round(sum(greatest(baseline - candidate, 0)), 6) as regression_mass, round(sum(greatest(candidate - baseline, 0)), 6) as improvement_mass,
           count(*) filter (baseline = 1 and candidate = 1) as both_right, count(*) filter (baseline = 1 and candidate = 0) as lost,
           count(*) filter (baseline = 0 and candidate = 1) as gained, count(*) filter (baseline = 0 and candidate = 0) as both_wrong from {LONG_PAIRS} group by metric""")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who got better, who worse, and by how much."""
    return comparison.transitions(long_pairs(spark, sf_dir), ["metric"])


@query("""
    select lang, count(*) as n, count(*) filter (trim(text, ' .' || chr(10) || chr(9)) = '') as empty, count(*) filter (regexp_matches(text, '[㐀-鿿]')) as cjk,
           count(*) filter (contains(text, chr(10))) as multiline, round(avg(length(text)), 3) as mean_chars, round(median(length(text)), 3) as median_chars from documents group by lang""")
def behavior_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What outputs look like."""
    facts = comparison.behavior(F.col("text"), F.lit(None).cast("int"), 128)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(facts["empty"]).alias("empty"), F.count_if(facts["cjk"]).alias("cjk"), F.count_if(facts["multiline"]).alias("multiline"),
        F.round(F.avg(facts["characters"]), 3).alias("mean_chars"), F.round(F.median(facts["characters"]), 3).alias("median_chars"))


@query(r"select doc_id, regexp_replace(trim(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '.' || chr(10)), '\s+', ' ', 'g') as normal from documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as answers are compared."""
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_answer(F.col("text")).alias("normal"))


@query(f"select id, model, try_cast(prediction as double) as number from {PREDICTIONS}")
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number a prediction states."""
    return predictions(spark, sf_dir).select("id", "model", text.parse_number(F.col("prediction")).alias("number"))


@query(r"""
    with n as (select doc_id, list_transform(regexp_extract_all(replace(replace(text, ',', ''), '，', ''), '(?:^|[^A-Za-z0-9])([-+]?\d+(?:\.\d+)?)', 1), lambda x: x::double) as v from documents)
    select doc_id, len(v) as n_numbers, coalesce(list_max(v), 0) as greatest from n""")
def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers within texts."""
    v = text.extract_numbers(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(v).cast("bigint").alias("n_numbers"), F.coalesce(F.array_max(v), F.lit(0.0)).alias("greatest"))


@query(f"select id, model, relaxed from {SCORED}")
def relaxed_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement within 5 %, or as text."""
    return predictions(spark, sf_dir).select("id", "model", text.relaxed_accuracy(F.col("prediction"), F.array("answer")).alias("relaxed"))


@query(f"select id, model, exact from {SCORED}")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of normalised texts."""
    return predictions(spark, sf_dir).select("id", "model", text.exact_match(F.col("prediction"), F.array("answer")).alias("exact"))


@query(f"select id, model, levenshtein(prediction, answer) as distance from {PREDICTIONS}")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance of each prediction from its answer."""
    return predictions(spark, sf_dir).select("id", "model", F.levenshtein("prediction", "answer").cast("bigint").alias("distance"))


@query(f"""
    with s as (select id, model, case when greatest(length(prediction), length(answer)) = 0 then 1.0 else 1 - levenshtein(prediction, answer) / greatest(length(prediction), length(answer)) end as s from {PREDICTIONS})
    select id, model, round(case when s >= 0.5 then s else 0 end, 6) as anls from s""")
def anls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit similarity of predictions and answers, with a threshold."""
    return predictions(spark, sf_dir).select("id", "model", F.round(text.anls(F.col("answer"), F.col("prediction")), 6).alias("anls"))


@query("""
    with d as (select doc_id, doc_id % (select count(*) from benchmark) + 1 as nth, regexp_extract_all(lower(text), '[a-z0-9]+') as words from documents),
    b as (select row_number() over (order by item_id) as nth, regexp_extract_all(lower(text), '[a-z0-9]+') as words from benchmark),
    t as (select doc_id, w, count(*) as n from (select doc_id, unnest(words) as w from d) group by 1, 2),
    u as (select nth, w, count(*) as n from (select nth, unnest(words) as w from b) group by 1, 2),
    o as (select d.doc_id, coalesce(sum(least(t.n, coalesce(u.n, 0))), 0) as o from d left join t on t.doc_id = d.doc_id left join u on u.nth = d.nth and u.w = t.w group by 1)
    select d.doc_id, round(case when len(d.words) = 0 or len(b.words) = 0 then (len(d.words) = len(b.words))::int::double when o = 0 then 0 else 2.0 * o / (len(d.words) + len(b.words)) end, 6) as f1
    from d join b using (nth) join o on o.doc_id = d.doc_id""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token overlap of each whole document with one benchmark passage, as multisets."""
    passages = table(spark, sf_dir, "benchmark").select(F.row_number().over(W.orderBy("item_id")).alias("nth"), text.tokens(F.lower("text"), "[a-z0-9]+").alias("b"))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % F.lit(passages.count()) + 1).alias("nth"), text.tokens(F.lower("text"), "[a-z0-9]+").alias("a"))
    return rows.join(passages, "nth").select("doc_id", F.round(text.token_f1(F.col("b"), F.col("a")), 6).alias("f1"))


@query(r"select doc_id, len(list_filter(regexp_split_to_array(text, '[。！？；;\n]+'), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g') <> '')) as n_clauses from documents")
def clause_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses that are not blank."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.clauses(F.col("text"))).cast("bigint").alias("n_clauses"))


@query(f"""
    with n as (select id, model, answer::double as target, list_transform(regexp_extract_all(prediction, '(?:^|[^A-Za-z0-9])([-+]?[0-9]+(?:[.][0-9]+)?)', 1), lambda x: x::double) as v from {PREDICTIONS}),
    h as (select id, model, v, (len(list_filter(v, lambda x: abs(x - target) <= greatest(0.2, abs(target) * 0.005))) > 0)::int::double as recall,
                 case when len(v) = 0 then 0 else len(list_filter(v, lambda x: abs(x - target) <= greatest(0.2, abs(target) * 0.005))) / len(v) end as precision from n)
    select id, model, recall, precision, round(case when recall + precision = 0 then 0 else 2 * recall * precision / (recall + precision) end, 6) as score from h""")
def numeric_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of a target number and support of all stated numbers."""
    target = F.col("answer").cast("double")
    none = F.lit(None)
    truth = F.struct(
        F.array(F.struct(F.lit("total").alias("name"), target.alias("value"), F.lit("usd").alias("unit"), none.cast("double").alias("tolerance"), F.array().cast("array<string>").alias("terms"))).alias("numeric_targets"),
        F.array(F.struct(target.alias("value"), none.cast("double").alias("tolerance"))).alias("numeric_support"))
    rows = predictions(spark, sf_dir).withColumn("truth", truth)
    parts = rewards.numeric_parts(F.col("prediction"), F.col("truth"))
    return rows.select("id", "model", parts.alias("p")).select("id", "model", "p.recall", "p.precision", F.round("p.score", 6).alias("score"))


_KEYS = ["the", "und", "que", "les", "token"]


@query("select doc_id, round((" + " + ".join(f"contains(lower(text), '{k}')::int" for k in _KEYS) + f") / {len(_KEYS)}.0, 6) as coverage from documents")
def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of keywords contained."""
    truth = F.struct(F.array(*map(F.lit, _KEYS)).alias("evidence_keywords"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(rewards.evidence(F.col("text"), truth), 6).alias("coverage"))


@query("""
    select doc_id, round(((contains(text, '亏损') or contains(text, '利润为负') or contains(text, '无法覆盖成本'))::int + contains(lower(text), 'license')::int + contains(lower(text), 'ation')::int) / 3.0, 6) as coverage from documents""")
def alias_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of labels that one of their phrases states."""
    truth = F.struct(F.array(F.lit("loss_making"), F.lit("license"), F.lit("ation")).alias("risk_labels"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(rewards.risk(F.col("text"), truth), 6).alias("coverage"))


@query(r"""
    with c as (select doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[。！？；;\n]+'), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), lambda c: c <> '' and contains(lower(c), 'the')) as named from documents),
    w as (select doc_id, lower(case when len(named) > 0 then array_to_string(named, '。') else text end) as w from c)
    select doc_id, case when (contains(w, 'tion') or contains(w, 'ing')) and not contains(w, 'ver') then 1.0 when contains(w, 'tion') or contains(w, 'ing') then 0.5 else 0.0 end::double as score from w""")
def trend_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against opposite terms where a metric is named."""
    target = F.struct(F.lit("the").alias("metric"), F.lit("up").alias("label"), F.array(F.lit("tion"), F.lit("ing")).alias("terms"), F.array(F.lit("ver")).alias("opposites"))
    return table(spark, sf_dir, "documents").select("doc_id", rewards.trend(F.col("text"), F.struct(F.array(target).alias("trend_targets"))).alias("score"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents turned into tagged answers: thirds of the text are section bodies, tags come and go with doc_id."""
    part = lambda when, tag, body: F.when(when, F.concat(F.lit(f"【{tag}】"), body)).otherwise("")
    i, third = F.col("doc_id"), F.floor(F.char_length("text") / 3).cast("int")
    body = lambda k: F.substring("text", k * third + 1, third)
    answer = F.concat(part(i % 3 != 0, "结论", body(0)), part(i % 4 != 0, "数据依据", body(1)), part(i % 5 == 0, "结论", F.lit("")), part(i % 2 == 0, "建议", F.substring("text", 2 * third + 1, F.char_length("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", answer.alias("answer"))


_TAGGED = """(select doc_id, case when doc_id % 3 <> 0 then '【结论】' || substr(text, 1, t) else '' end || case when doc_id % 4 <> 0 then '【数据依据】' || substr(text, t + 1, t) else '' end
    || case when doc_id % 5 = 0 then '【结论】' else '' end || case when doc_id % 2 = 0 then '【建议】' || substr(text, 2 * t + 1) else '' end as answer from (select doc_id, text, length(text) // 3 as t from documents))"""


def _times(tag: str) -> str:
    return f"((length(answer) - length(replace(answer, '【{tag}】', ''))) // {len(tag) + 2})"


_FORMAT = f"""(select doc_id, greatest(0, least(1, 0.85 * len(present) / 3 + case when len(present) > 0 and list_sort(present) = present then 0.15 else 0 end - least(0.25, extra * 0.08))) as score
    from (select doc_id, list_filter([strpos(answer, '【结论】'), strpos(answer, '【数据依据】'), strpos(answer, '【建议】')], lambda p: p > 0) as present,
                 greatest(0, {_times('结论')} - 1) + greatest(0, {_times('数据依据')} - 1) + greatest(0, {_times('建议')} - 1) as extra from {_TAGGED}))"""


@query(f"select doc_id, round(score, 6) as score from {_FORMAT}")
def format_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, order and repetition of tagged sections."""
    return _tagged(spark, sf_dir).select("doc_id", F.round(rewards.sections(F.col("answer"), ["结论", "数据依据", "建议"]), 6).alias("score"))


_LENGTH = "(case when n_chars between 200 and 1200 then 1.0 when n_chars < 200 then n_chars / 200.0 else greatest(0, 1 - (n_chars - 1200) / 1200.0) end)"


@query(f"select doc_id, round({_LENGTH}, 6)::double as score from documents")
def length_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a range of lengths, falling outside."""
    score = rewards.length_score(F.char_length("text"), F.lit(200), F.lit(1200), F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score, 6).alias("score"))


@query(f"""
    with p as (select d.doc_id, case when d.doc_id % 7 = 0 then null else (contains(lower(text), 'the')::int + contains(lower(text), 'und')::int) / 2.0 end as evidence, f.score as format, {_LENGTH} as length
               from documents d join {_FORMAT} f using (doc_id))
    select doc_id, round((0.15 * format + coalesce(0.15 * evidence, 0) + 0.05 * length) / (0.20 + case when evidence is null then 0 else 0.15 end), 6) as overall from p""")
def weighted_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean over the components that apply."""
    keys = F.when(F.col("doc_id") % 7 != 0, F.array(F.lit("the"), F.lit("und")))
    rows = _tagged(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    parts = {"format": rewards.sections(F.col("answer"), ["结论", "数据依据", "建议"]), "evidence": rewards.evidence(F.col("text"), F.struct(keys.alias("evidence_keywords"))), "length": rewards.length_score(F.char_length("text"), F.lit(200), F.lit(1200), F.lit(True))}
    return rows.select("doc_id", F.round(rewards.weighted(parts), 6).alias("overall"))


@query(f"select id, model, case when try_cast(prediction as double) is not null then 'numeric' else 'text' end as kind from {PREDICTIONS}")
def answer_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer is a number."""
    return predictions(spark, sf_dir).select("id", "model", comparison.answer_kind(F.array("prediction")).alias("kind"))


@query(f"""
    with e as (select model, abs(try_cast(prediction as double) - answer::double) / abs(answer::double) as e from {PREDICTIONS} where try_cast(prediction as double) is not null)
    select model, case when e <= 0.05 then 'within_5pct' when e <= 0.10 then '5_to_10pct' else 'over_10pct' end as band, count(*) as n from e group by 1, 2""")
def error_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative errors by band."""
    error = comparison.relative_error(text.parse_number(F.col("answer")), text.parse_number(F.col("prediction")))
    return predictions(spark, sf_dir).filter(text.parse_number(F.col("prediction")).isNotNull()).groupBy("model", comparison.error_band(error).alias("band")).agg(F.count("*").alias("n"))


@query(f"""
    with f as (select unnest([case when not starts_with(answer, '【结论】') then 'start' end, case when {_times('结论')} <> 1 then 'count_0' end, case when {_times('数据依据')} <> 1 then 'count_1' end,
                              case when strpos(answer, '【结论】') = 0 or strpos(answer, '【数据依据】') = 0 or strpos(answer, '【结论】') > strpos(answer, '【数据依据】') then 'order' end,
                              case when contains(answer, '【风险】') or contains(answer, '【建议】') then 'unexpected' end]) as issue from {_TAGGED})
    select issue, count(*) as n from f where issue is not null group by issue""")
def protocol_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways in which an answer leaves its protocol."""
    return _tagged(spark, sf_dir).select(F.explode(gates.protocol_issues(F.col("answer"), ["结论", "数据依据"])).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("""
    with l as (select vec_id, list_transform(embedding[1:8], lambda x: x::double) as t, list_transform(embedding[9:16], lambda x: x::double) as s from embeddings),
    p as (select vec_id, list_transform(t, lambda x: exp(x) / (list_sum(list_transform(t, lambda y: exp(y))) + 1)) as t, list_transform(s, lambda x: exp(x) / (list_sum(list_transform(s, lambda y: exp(y))) + 1)) as s from l)
    select vec_id, round(list_sum(list_transform(range(1, 9), lambda i: t[i] * (ln(t[i]) - ln(s[i])))) + (1 - list_sum(t)) * (ln(1 - list_sum(t)) - ln(1 - list_sum(s))), 6) as kl from p""")
def sparse_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of two top-8 distributions with what is left of each."""
    part = lambda start: F.transform(F.slice("embedding", start, 8), lambda x: x.cast("double"))
    with_rest = lambda a: F.slice(losses.log_softmax(F.concat(a, F.array(F.lit(0.0)))), 1, 8)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", with_rest(part(1)).alias("t"), with_rest(part(9)).alias("s"))
    return rows.select("vec_id", F.round(losses.sparse_forward_kl(F.col("t"), F.col("s")), 6).alias("kl"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean difference from 2000 resamples."""
    return comparison.bootstrap_by_value(long_pairs(spark, sf_dir), ["metric"])


@query()
def bootstrap_numpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval from numpy's generator, the same seed for every metric."""
    return comparison.bootstrap_numpy(long_pairs(spark, sf_dir).select("id", "metric", "baseline", "candidate"), ["metric"])


@query(f"""
    with s as (select metric, round(avg(candidate - baseline), 6) as delta from {LONG_PAIRS} group by metric),
    t(kind, metric, min_delta) as (values ('required', 'exact', -0.05), ('guardrail', 'relaxed', -0.001), ('guardrail', 'missing', 0.0))
    select kind, t.metric, s.delta, min_delta::double as min_delta, coalesce(s.delta >= min_delta, false) as passed from t left join s on s.metric = t.metric""")
def gate_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds against a paired summary."""
    summary = comparison.paired_summary(long_pairs(spark, sf_dir), ["metric"]).withColumn("p_positive", F.lit(1.0))
    rules = [("required", "exact", -0.05, 0.0), ("guardrail", "relaxed", -0.001, 0.0), ("guardrail", "missing", 0.0, 0.0)]
    return comparison.gate_checks(summary, spark.createDataFrame(rules, "kind string, metric string, min_delta double, min_probability double"))


@query()
def open_answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six surrogate scores of free answers."""
    return predictions(spark, sf_dir).select("id", "model", text.open_answer_scores(F.col("answer"), F.col("prediction")).alias("s")).select("id", "model", "s.*")


@query()
def multi_answer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item by item accuracy of list answers, year flags included."""
    items = lambda c: text.literal_items(F.concat(F.lit("['"), F.col(c), F.lit("', '"), F.col("status"), F.lit("']")))
    rows = predictions(spark, sf_dir).select("id", "model", items("answer").alias("want"), items("prediction").alias("got"))
    return rows.select("id", "model", text.multi_answer_accuracy(F.col("want"), F.col("got"), F.array(F.lit("NO")), F.lit("Reasoning")).alias("score"))
