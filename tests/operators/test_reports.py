import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismark.operators import comparison, gates, protocol, reports, scoring

META = "struct<scenario:string,question_type:string,year_flags:array<string>,answer_sequence:array<string>,background:string,source_index:int,source_image_path:string,task_category:string,image_type:string,image_style:string>"
SCHEMA = f"id string, dataset string, split string, image string, question string, answer string, ground_truth string, metadata {META}, prediction string, completion_tokens int, latency_seconds double, task_type string"


def row(key, answer, prediction, dataset="charts", question="q", tokens=5, flags=(), kind=None, truth="{}", background=None):
    return (key, dataset, "val", f"{key}.png", question, answer, truth, ("s1", kind, list(flags), None, background, 3, "p", "t", "i", "y"), prediction, tokens, 2.0, "value")


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def test_scores_by_dataset(frame):
    truth = json.dumps({"required_sections": ["结论"], "numeric_targets": [{"name": "revenue", "value": 10.0, "tolerance": 0.2, "terms": ["收入"]}]})
    rows = {r.id: r for r in scoring.score_rows(frame([
        row("a", "100", "104"), row("b", "100", "106"), row("c", "['2020']", "['2021']", "ChartQAPro", flags=["YES"], kind="Reasoning"), row("d", "['2020']", "['2021']", "chartqapro", flags=["NO"], kind="Reasoning"),
        row("e", "It grew from 100 million to 120 million.", "120 and 100 million", "MMEFinance"), row("f", "x", "【结论】收入10.0", "generated-v1", truth=truth), row("g", "north", None), row("h", "a", "B", truth=json.dumps({"answer_aliases": ["a", "b"]})),
    ])).collect()}
    assert [rows[k].relaxed_accuracy for k in "abcdgh"] == [1, 0, 0, 1, 0, 1]
    assert rows["h"].exact_match == 1 and rows["a"].exact_match == 0 and rows["e"].exact_match is None
    assert rows["e"].surrogate_numeric_recall == 1 and rows["e"].surrogate_numeric_precision == 1 and rows["a"].surrogate_anls is None
    assert rows["f"].numeric == 1 and rows["f"].format == 1 and rows["f"].overall == 1 and rows["f"].relaxed_accuracy is None and rows["a"].overall is None


def test_completion_texts(spark):
    cases = {"  plain ": "plain", '{"role": "assistant", "content": " x "}': "x", '{"content": [{"type": "text", "text": "a"}, {"text": "b"}]}': "ab", '[{"content": "one"}, {"content": ""}, {"content": [{"text": "two"}]}]': "one\ntwo", "[not json": "[not json"}
    rows = spark.createDataFrame(list(cases.items()), "v string, want string").withColumn("got", scoring.completion_text(F.col("v"))).collect()
    assert all(r.got == r.want for r in rows)


def test_exports(frame):
    rows = frame([row("a", "x", "y", "chartqapro"), row("b", "x", None, "mmefinance"), row("c", "x", "y")])
    official, audit = scoring.official_rows(rows).collect(), scoring.audit_rows(rows).collect()
    assert [r.asDict() for r in official] == [{"Answer": ["x"], "Question Type": "unknown", "Year": [], "prediction": "y"}]
    assert len(audit) == 1 and len(audit[0]) == 11 and audit[0].background == "" and audit[0].surrogate_scores.output_nonempty == 0


def test_evaluation_report(frame):
    scored = scoring.score_rows(frame([row("a", "1", "1"), row("b", "1", "2"), row("c", "1", "1", "tables")]))
    found = {(r.field, r.value, r.metric): (r.rows, r["mean"]) for r in reports.evaluation_report(scored).collect()}
    assert found["overall", "overall", "exact_match"] == (3, 0.666667) and found["dataset", "charts", "exact_match"] == (2, 0.5) and found["scenario", "s1", "relaxed_accuracy"] == (3, 0.666667)
    assert ("industry", "unknown", "exact_match") in found and not any(m == "overall" for _, _, m in found)
    assert reports.nested(reports.evaluation_report(scored), ["field", "value", "metric"])["dataset"]["tables"]["exact_match"]["mean"] == 1.0


def test_comparison_needs_the_same_rows(frame):
    base = scoring.score_rows(frame([row("a", "1", "1"), row("b", "1", "2")]))
    same = reports.comparison_report(base, base, scoring.PUBLIC, samples=50).filter("field = 'overall'").collect()
    assert {(r.metric, r.n, r.delta, r.low, r.high, r.p_positive) for r in same} == {("exact_match", 2, 0, 0, 0, 0), ("relaxed_accuracy", 2, 0, 0, 0, 0)}
    for other in ([row("a", "1", "1")], [row("a", "1", "1"), row("b", "9", "2")], [row("a", "1", "1"), row("b", "1", "2"), row("b", "1", "2")]):
        with pytest.raises(ValueError):
            reports.comparison_report(base, scoring.score_rows(frame(other)))


def test_migration_report(frame):
    base = [row("a", "1", "1"), row("b", "10", "10"), row("c", "x", "y"), row("d", "5", "5", question="which year", tokens=9)]
    cand = [row("a", "1", "1"), row("b", "10", "10.3"), row("c", "x", "x"), row("d", "5", "", question="which year", tokens=128)]
    report = reports.migration_report(*(scoring.score_rows(frame(x)) for x in (base, cand)))
    overall = {r.metric: r for r in report["groups"].filter("field = 'overall'").collect()}
    assert (overall["exact_match"].both_right, overall["exact_match"].lost, overall["exact_match"].gained, overall["exact_match"].both_wrong) == (1, 2, 1, 0) and overall["exact_match"].delta == -0.25
    assert {r.reason for r in report["reasons"].collect()} == {"numeric_value_error_within_5pct", "empty_prediction"}
    assert {(r.signature, r.n) for r in report["signatures"].collect()} >= {("answer_kind_numeric", 2), ("candidate_empty", 1), ("new_token_cap_proxy", 1)}
    assert [(r.id, r["rank"]) for r in report["examples"].orderBy("id").collect()] == [("b", 1), ("d", 1)]
    reports.assert_expected(report["groups"], {"paired_rows": 4, "baseline_exact": 0.75, "candidate_exact": 0.5, "baseline_relaxed": None})
    with pytest.raises(ValueError):
        reports.assert_expected(report["groups"], {"candidate_exact": 0.51})


def test_resampling_by_value_agrees_with_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), "m", 0.0, float(d)) for i, d in enumerate(rng.choice([-1, 0, 0, 1, 1], 400))]
    pairs = spark.createDataFrame(rows, "id int, metric string, baseline double, candidate double")
    a, b = comparison.bootstrap_by_value(pairs, ["metric"]).first(), comparison.bootstrap_numpy(pairs, ["metric"]).first()
    assert (a.n, a.delta) == (b.n, b.delta) and abs(a.low - b.low) < 0.015 and abs(a.high - b.high) < 0.015 and abs(a.p_positive - b.p_positive) < 0.02
    assert comparison.bootstrap_by_value(pairs.limit(0), ["metric"]).count() == 0


def test_paired_gate(frame):
    base = scoring.score_rows(frame([row("a", "1", "2"), row("b", "1", "1")]))
    cand = scoring.score_rows(frame([row("a", "1", "1"), row("b", "1", "1")]))
    rules = {"required": {"exact_match": {"min_delta": 0.4}}, "point_estimate_guardrails": {"relaxed_accuracy": 0.0}, "core_metrics": ["exact_match"], "minimum_positive_core_metrics": 1}
    passed = gates.paired_gate(base, cand, rules, rows=2, passed="P", failed="N", samples=200)
    failed = gates.paired_gate(cand, base, rules, rows=2, passed="P", failed="N", samples=200)
    assert (passed["status"], passed["gate"]) == ("passed", "P") and (failed["status"], failed["gate"]) == ("failed", "N") and len(failed["gate_evaluation"]["issues"]) == 3
    assert gates.require_gate(passed, "P") is passed
    for wrong in (dict(rows=3), dict(rows=2, split="train")):
        with pytest.raises(ValueError):
            gates.paired_gate(base, cand, rules, passed="P", failed="N", **wrong)
    with pytest.raises(ValueError):
        gates.require_gate(failed, "P")
    with pytest.raises(ValueError):
        gates.paired_gate(base, cand, {"required": {"missing": {}}}, rows=2, passed="P", failed="N", samples=10)


def test_candidate_contract():
    documents = {"g": {"status": "passed", "gate": "G"}, "m": {"config": {"generation": {"prompt_profile": "v2"}}}}
    gates.candidate_contract({"inputs": {"prerequisite_gate": "g", "prerequisite_gate_name": "G", "candidate_manifest": "m", "required_prompt_profile": "v2"}}, documents.get)
    gates.candidate_contract({}, documents.get)
    for bad in ({"prerequisite_gate": "g"}, {"prerequisite_gate": "g", "prerequisite_gate_name": "H"}, {"candidate_manifest": "m"}, {"candidate_manifest": "m", "required_prompt_profile": "v1"}):
        with pytest.raises(ValueError):
            gates.candidate_contract({"inputs": bad}, documents.get)
    assert gates.preflight_document([("medium", "a", "b")])["status"] == "passed" and gates.preflight_document([("critical", "a", "b")])["status"] == "failed"


def test_protocol(spark, frame):
    rows = spark.createDataFrame([("【结论】a\n【数据依据】b",), ("# 结论\n【数据依据】b【风险】",), ("【数据依据】b【结论】a【结论】",)], "t string")
    sections = F.array(F.lit("结论"), F.lit("数据依据"))
    got = [r.i for r in rows.select(gates.protocol_issues_of(F.col("t"), sections).alias("i")).collect()]
    assert got[0] == [] and {x.split()[0] for x in got[1]} == {"start", "count", "order", "unexpected", "heading"} and {x.split()[0] for x in got[2]} == {"start", "count", "order"}
    texts = {"opening": "O", "labels": "L", "rules": ";", "focus": "F", "evidence": "E", "risk": "R", "advice": "A", "limit": "{n}"}
    one = lambda task, view, dataset="generated-v1": spark.range(1).select(protocol.strict_prompt(F.lit(dataset), F.lit(task), F.lit(view), texts, {task: "!"}).alias("p")).first().p
    assert one("value_retrieval", "growth") == "OL【结论】、【数据依据】;F!E260" and one("relationship_analysis", "financial").endswith("ER260") and one("comprehensive_report", "growth").endswith("ERA420")
    with pytest.raises(Exception):
        one("unknown", "growth")
    with pytest.raises(Exception):
        one("value_retrieval", "growth", "chartqa")
    example = protocol.sft_examples(frame([row("a", "x", "y")]), F.lit("s"), F.lit("u")).first()
    assert [m.role for m in example.prompt] == ["system", "user"] and [b.type for b in example.prompt[1].content] == ["image", "text"] and example.completion[0].content[0].text == "x"
    with pytest.raises(ValueError):
        protocol.grpo_examples(frame([row("a", "x", "y")]), "s")
    assert protocol.grpo_examples(frame([row("a", "x", "y", truth='{"grpo_eligible": true}'), row("b", "x", "y")]), "s").count() == 1
