"""Adapters, gates, prompts, subsets and validation over the test tables and generated records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismark.functions.hashing import content_hash, hash_number
from prismark.functions.rewards import TRUTH
from prismark.lineage import cut_lineage
from prismark.operators import facts, gates, protocol, questions, reports, scoring, selection, subsets, validation
from prismark.plans.registry import query
from prismark.plans.report_queries import _LONG, answered
from prismark.plans.views import RECORDS, records, sql_number, table
from prismark.sources import adapters


def _generated(spark: SparkSession, n: int = 96, split: str = "train") -> DataFrame:
    return cut_lineage(questions.entity_records(facts.synthetic_entities(spark, n), split=split))


@query("""
    select 'chartqa_train_' || lpad(o_orderkey::varchar, 6, '0') as id, 'chartqa_' || substr(sha256('image' || (o_orderkey % 50)), 1, 16) as chart_id, trim(o_orderpriority) as question,
           (o_custkey)::varchar as answer, o_custkey::double as target, round(greatest(0.05, o_custkey * 0.05)::double, 6) as tolerance, 2::bigint as n_aliases
    from orders where o_orderkey % 5 <> 0""")
def plain_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows with labels as records; rows without a label are left out."""
    orders = table(spark, sf_dir, "orders")
    label = F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("o_custkey").cast("string"), F.col("o_orderstatus")))
    source = orders.select(F.col("o_orderkey").alias("source_index"), F.sha2(F.concat(F.lit("image"), F.col("o_orderkey") % 50), 256).alias("image_sha256"), F.lit("x.png").alias("image"), F.concat(F.lit(" "), F.col("o_orderpriority")).alias("query"), label.alias("label"), F.lit(None).cast("int").alias("human_or_machine"))
    made = adapters.plain_answers(source, "train").withColumn("gt", F.from_json("ground_truth", TRUTH))
    target = F.get("gt.numeric_targets", F.lit(0))
    return made.select("id", "chart_id", "question", "answer", target["value"].alias("target"), F.round(target["tolerance"], 6).alias("tolerance"), F.size("gt.answer_aliases").cast("bigint").alias("n_aliases"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as conversations of one to three turns; some last answers are blank, some flags too few."""
    doc, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    turns = i % 3 + 1
    texts = lambda name: F.transform(F.sequence(F.lit(1).cast("bigint"), turns), lambda k: F.concat(F.lit(name), i.cast("string"), F.lit("."), k.cast("string")))
    answers = F.transform(F.sequence(F.lit(1).cast("bigint"), turns), lambda k: F.when((k == turns) & (i % 7 == 0), F.lit(" ")).otherwise(F.concat(F.lit("a"), i.cast("string"), F.lit("."), k.cast("string"))))
    years = F.transform(F.sequence(F.lit(1).cast("bigint"), F.when(i % 11 == 0, turns + 1).otherwise(turns)), lambda k: F.lit("No"))
    return doc.select(i.alias("source_index"), F.lit("x.png").alias("image"), F.sha2(i.cast("string"), 256).alias("image_sha256"), texts("q").alias("Question"), answers.alias("Answer"), years.alias("Year"), F.col("lang").alias("Question Type"), F.when(i % 4 == 0, F.lit(" about ")).alias("Paragraph"))


_TURN = "array_to_string(list_transform(range(1, (d % 3 + 1)::bigint), lambda k: 'User: q' || d || '.' || k || chr(10) || 'Assistant: a' || d || '.' || k), chr(10))"


@query(f"""
    with p as (select doc_id as d, case when doc_id % 3 > 0 then 'Conversation history:' || chr(10) || {_TURN.replace('d %', 'doc_id %').replace('|| d ||', '|| doc_id ||')} || chr(10) || 'Current question: ' else '' end || 'q' || doc_id || '.' || (doc_id % 3 + 1) as q from documents where doc_id % 7 <> 0)
    select 'chartqapro_test_' || lpad(d::varchar, 5, '0') as id, case when d % 4 = 0 then 'Context: about' || chr(10) || 'Question: ' else '' end || q as question, 'a' || d || '.' || (d % 3 + 1) as answer from p""")
def list_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records: history, context, last answers; blank ones are removed and not refilled."""
    return adapters.list_answers(_lists(spark, sf_dir))[0].select("id", "question", "answer")


@query("""
    select count(*) as before_records, count(*) filter (doc_id % 7 <> 0) as after_records, count(*) filter (doc_id % 7 = 0) as removed_empty_final_answer,
           count(*) filter (doc_id % 11 = 0) as year_flag_length_mismatch, count(*) filter (doc_id % 11 = 0 and doc_id % 7 <> 0) as retained_year_flag_length_mismatch from documents""")
def list_answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was removed and what was kept in spite of its flags."""
    return adapters.list_answers(_lists(spark, sf_dir))[1]


@query("""
    select 'mmefinance_test_' || lpad(p_partkey::varchar, 5, '0') as id, p_name as question, p_brand as answer, 'img/' || p_partkey || '.png' as image, 1024::bigint as longest from part""")
def finance_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finance table with its images as records; its indices must be dense."""
    part = table(spark, sf_dir, "part")
    path = F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.lit(".png"))
    source = part.select(F.col("p_partkey").cast("string").alias("index"), path.alias("image_path"), F.lit("line").alias("image_type"), F.lit("plain").alias("image_style"), F.lit("task").alias("task_category"), F.col("p_name").alias("question"), F.col("p_brand").alias("answer"), F.lit(None).cast("string").alias("background"))
    lookup = part.select(path.alias("suffix"), path.alias("image"), F.sha2(path, 256).alias("sha256"))
    made = adapters.finance_answers(source, lookup, part.count()).withColumn("gt", F.from_json("ground_truth", TRUTH))
    return made.select("id", "question", "answer", "image", F.get("gt.length_range", F.lit(1)).cast("bigint").alias("longest"))


@query(f"""
    with r as (select id, split, content_hash as key from {RECORDS}), t as (select distinct key from r where split = 'test'),
    v as (select distinct key from r where split = 'val' and key not in (select key from t))
    select split, id, case when split = 'val' then 'test' else concat_ws(',', case when key in (select key from v) then 'val' end, case when key in (select key from t) then 'test' end) end as overlaps
    from r where (split = 'val' and key in (select key from t)) or (split = 'train' and (key in (select key from t) or key in (select key from v)))""")
def removed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that give way to a protected split, with what they overlap."""
    rows = records(spark, sf_dir).select("id", "split", content_hash(F.col("text")).alias("key"))
    splits = {s: rows.filter(F.col("split") == s) for s in ("train", "val", "test")}
    return adapters.decontaminated(splits, F.col("key"))[1].select("split", "id", F.array_join("overlaps_with", ",").alias("overlaps"))


_SECTIONS = {t: "|".join(s) for t, s in protocol.TASK_SECTIONS.items()}


@query("select task_type, sections || case when task_type = 'relationship_analysis' and view_type = 'financial' then '|风险' else '' end as sections, most from (values " + ", ".join(f"('{t}', '{s}', {protocol.MOST_CHARACTERS.get(t, protocol.OTHER_CHARACTERS)})" for t, s in _SECTIONS.items()) + ") v(task_type, sections, most), (values ('financial'), ('growth')) w(view_type)")
def required_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and length of a strict answer by task and view."""
    rows = spark.createDataFrame([(t, v) for t in _SECTIONS for v in ("financial", "growth")], "task_type string, view_type string")
    return rows.select("task_type", F.array_join(protocol.required_sections(F.col("task_type"), F.col("view_type")), "|").alias("sections"), protocol.most_characters(F.col("task_type")).cast("bigint").alias("most"))


@query("""
    select c_custkey as id, case when c_custkey % 3 = 0 then 'finance' when c_custkey % 3 = 1 then 'public' else 'domain' end as system,
           case when c_custkey % 3 = 0 and c_nationkey % 2 = 0 then 'Background:' || chr(10) || c_mktsegment || chr(10) || chr(10) || 'Question:' || chr(10) || c_name else c_name end as user from customer""")
def prompts_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System and user prompts as datasets ask for them."""
    i = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").withColumn("dataset", F.when(i % 3 == 0, "MMEFinance").when(i % 3 == 1, "chartqa").otherwise("generated-v1"))
    background = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit(" "), F.col("c_mktsegment"))).otherwise(" ")
    return rows.select(i.alias("id"), protocol.system_prompt(F.col("dataset"), "domain", "public", "finance").alias("system"), protocol.user_prompt(F.col("dataset"), F.col("c_name"), background).alias("user"))


@query(f"""
    with s as (select metric, round(avg(candidate - baseline), 6) as delta from {_LONG} group by metric),
    t(kind, metric, bound) as (values ('required', 'exact_match', -0.9), ('required', 'relaxed_accuracy', 0.1), ('point_estimate_guardrail', 'relaxed_accuracy', -0.95))
    select kind, t.metric, delta as observed, bound::double as bound, delta >= bound as passed from t join s on s.metric = t.metric
    union all select 'positive_core_count', 'exact_match,relaxed_accuracy', (count(*) filter (delta > 0))::double, 1.0, count(*) filter (delta > 0) >= 1 from s""")
def paired_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of a paired gate with its count of metrics that got better."""
    sides = [scoring.score_rows(answered(spark, sf_dir, m)) for m in ("base", "cand")]
    overall = reports.comparison_report(*sides, scoring.PUBLIC, fields=[], samples=200).filter("field = 'overall'")
    checks = gates.paired_checks(overall, {"exact_match": (-0.9, 0.0), "relaxed_accuracy": (0.1, 0.0)}, {"relaxed_accuracy": -0.95}, ["exact_match", "relaxed_accuracy"], 1)
    return checks.select("kind", "metric", "observed", "bound", "passed")


@query(f"""
    with m as (select task_type, metric, round(avg(candidate), 6) as v from {_LONG} group by 1, 2), o as (select metric, round(avg(candidate), 6) as v from {_LONG} group by 1),
    e as (select round(avg({sql_number('lat', 'key')} % 1000 / 100.0), 6) as latency, count(*) as n from {_LONG} where metric = 'exact_match')
    select 'minimum_overall' as kind, 'overall' as scope, metric, v as observed, 0.05::double as bound, v >= 0.05 as passed from o where metric = 'exact_match'
    union all select 'minimum_task_metric', 'task:1-URGENT', metric, v, 0.1, v >= 0.1 from m where metric = 'relaxed_accuracy' and task_type = '1-URGENT'
    union all select 'minimum_task_metric', 'task:1-URGENT', 'overall', null, 0.1, false
    union all select 'maximum_efficiency', 'efficiency', 'mean_latency_seconds', latency, 4.0, latency <= 4 from e union all select 'protocol_failures', 'rows', 'protocol', n::double, 0.0, false from e""")
def absolute_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least scores overall and by task, a greatest latency, and answers that leave the protocol."""
    rows = scoring.score_rows(answered(spark, sf_dir, "cand"))
    limits = {"minimum_overall": {"exact_match": 0.05}, "minimum_task_metrics": {"1-URGENT": {"relaxed_accuracy": 0.1, "overall": 0.1}}, "maximum_efficiency": {"mean_latency_seconds": 4.0}, "maximum_protocol_failures": 0}
    return gates.absolute_checks(rows, limits, F.array(F.lit("结论"), F.lit("数据依据")))


@query("select doc_id as id, row_number() over (order by doc_id) - 1 as at from documents")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered in order without bringing them into one task."""
    return selection.positions(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).distinct(), "id").select("id", "at")


@query(f"select count(distinct entity) as groups, count(distinct entity) as assigned, count(distinct entity) as offered, true as quotas_met from {RECORDS}")
def flow_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task for each entity, by classes of entities that offer the same: all assigned, all to what they offer, quotas met."""
    from prismark.operators.allocation import capped_quotas

    groups = records(spark, sf_dir).groupBy(F.col("entity").alias("group")).agg(F.array_sort(F.collect_set("task")).alias("tasks"))
    supply = {r[0]: r[1] for r in groups.select(F.explode("tasks").alias("t")).groupBy("t").count().collect()}
    quotas = capped_quotas({t: float(n) for t, n in supply.items()}, groups.count(), supply)
    given = subsets.assign_tasks(groups, quotas, "flow")
    met = reduce(lambda a, b: a & b, (F.count_if(F.col("task") == t) == n for t, n in sorted(quotas.items())))
    return given.agg(F.countDistinct("group").alias("groups"), F.count("*").alias("assigned"), F.count_if(F.array_contains("tasks", F.col("task"))).alias("offered"), met.alias("quotas_met"))


@query("select * from (values ('grpo_train', 144, 144, 144, 96), ('sft_screen', 192, 192, 192, 96), ('sft_train', 384, 384, 192, 96), ('validation', 64, 64, null, null)) v(name, records, ids, charts, entities)")
def training_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested supervised sets, rewarded prompts and a panel from generated records, their invariants checked."""
    train = _generated(spark)
    weights = {"value_retrieval": 0.25, "numerical_reasoning": 0.2, "relationship_analysis": 0.1, "risk_diagnosis": 0.1, "decision_support": 0.35}
    parts = subsets.training_subsets(train, train, _generated(spark, 40, "val"), screen=1, per_chart=2, prompts=144, weights=weights, panel=64)
    covered = lambda name, c: F.countDistinct(c) if name != "validation" else F.lit(None).cast("bigint")
    rows = [df.agg(F.count("*").alias("records"), F.countDistinct("id").alias("ids"), covered(n, "chart_id").alias("charts"), covered(n, "entity_id").alias("entities")).withColumn("name", F.lit(n)) for n, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


@query("select * from (values ('development', 100, 0), ('round_1', 40, 10), ('round_2', 20, 5), ('teacher_qualification', 60, 0)) v(name, records, twice)")
def unseen_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of unseen prompts and two panels, with what they must not share checked."""
    opd = "struct<dataset_version:string,round:int,rollout_count:int,original_answer_role:string>"
    meta = F.struct(F.col("metadata.scenario").alias("scenario"), F.lit(None).cast(opd).alias("opd"))
    train, held = _generated(spark).withColumn("metadata", meta), _generated(spark, 20, "val").withColumn("metadata", meta).withColumns({"id": F.concat(F.lit("v"), "id"), "image": F.concat(F.lit("v"), "image")})
    seen = train.filter(hash_number("seen", F.col("id")) % 4 == 0)
    forbidden = held.limit(0)
    weights = {"value_retrieval": 0.3, "numerical_reasoning": 0.3, "decision_support": 0.4}
    parts, _ = subsets.unseen_build(train, seen, held, forbidden, rounds=(40, 20), weights=weights, per_chart=2, dual=0.25, panel=60, version="v1")
    rows = [df.agg(F.count("*").alias("records"), F.count_if(F.coalesce(F.col("metadata.opd.rollout_count") == 2, F.lit(False))).alias("twice")).withColumn("name", F.lit(n)) for n, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


@query("select * from (values ('critical', 'record_uniqueness', 3), ('critical', 'reference_ground_truth_consistency', 5), ('high', 'answer_task_alignment', 1), ('high', 'chart_question_grain', 1), ('high', 'question_uniqueness', 1)) v(severity, \"check\", n)")
def dataset_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset's issues: generated records of which a chart has three repeated rows and five answers lost their numbers."""
    made = _generated(spark, 60).withColumn("gt", F.from_json("ground_truth", TRUTH))
    twice = made.filter("chart_id = 'entity_000003_financial'").orderBy("id").limit(3)
    lost = F.col("id").isin(*(f"entity_{i:06d}_financial_current_value" for i in range(10, 15)))
    rows = made.unionByName(twice).withColumn("answer", F.when(lost, F.concat(F.lit("no number "), F.col("entity_id"), F.lit("x"))).otherwise(F.col("answer")))
    rows = rows.withColumn("answer", F.when(lost, F.translate("answer", "0123456789", "abcdefghij")).otherwise(F.col("answer")))
    entities = facts.synthetic_entities(spark, 60)
    return validation.dataset_issues(rows, entities).select("severity", "check", "n")
