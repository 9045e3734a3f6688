import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismark.functions import losses, rewards, text
from prismark.operators import comparison, facts, gates


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("prediction,answers,want", [("104", ["100"], 1.0), ("106", ["100"], 0.0), ("50%", ["0.5"], 1.0), ("north", ["North"], 1.0), ("nan", ["nan"], 0.0), ("0", ["0"], 1.0), ("5", ["5%"], 0.0), ("1,000", ["x", "1000"], 1.0)])
def test_relaxed_accuracy(spark, prediction, answers, want):
    assert one(spark, text.relaxed_accuracy(F.lit(prediction), F.array(*map(F.lit, answers))))[0] == want


@pytest.mark.parametrize("value,want", [(" 1_000 ", 1000.0), ("1d", None), ("1f", None), ("-3.5.", -3.5), ("12 %", 0.12), (".5", 5.0), ("1e3", 1000.0), ("", None), ("1__0", None), ("+7", 7.0)])
def test_parse_number(spark, value, want):
    assert one(spark, text.parse_number(F.lit(value)))[0] == (pytest.approx(want) if want is not None else None)


def test_text_similarity(spark):
    assert one(spark, text.anls(F.lit("United Airlines"), F.lit("united airlines")))[0] == 1
    assert one(spark, text.anls(F.lit("alpha"), F.lit("zzzzz")))[0] == 0
    assert one(spark, text.anls(F.lit(""), F.lit(" ")))[0] == 1
    assert one(spark, text.normalize_answer(F.lit("\u00a0 A\u2003b.\n. ")))[0] == "a b"


def test_open_answers(spark):
    row = one(spark, text.open_answer_scores(F.lit("It grew from 100 million to 120 million, a 20% increase."), F.lit("A rise of 20% from 100 to 120 million.")).alias("s"))["s"]
    assert row.numeric_precision == row.numeric_recall == 1 and row.token_f1 > 0.5 and row.exact_match == 0
    assert one(spark, text.open_answer_scores(F.lit("no numbers"), F.lit("5")).alias("s"))["s"].numeric_recall is None


@pytest.mark.parametrize("want,got,flags,kind,score", [("['2020']", "['2020']", ["YES"], "x", 1.0), ("['2020']", "['2021']", ["YES"], "x", 0.0), ("2020", "2021", ["YES", "YES", "YES", "NO"], "x", 1.0), ("['a', '10']", "['a']", ["NO"], "x", 0.5), ("100", "104", ["NO"], "Fact Checking", 0.0)])
def test_multi_answers(spark, want, got, flags, kind, score):
    rows = spark.createDataFrame([(want, got)], "a string, b string").select(text.literal_items("a").alias("a"), text.literal_items("b").alias("b"))
    assert rows.select(text.multi_answer_accuracy(F.col("a"), F.col("b"), F.array(*map(F.lit, flags)), F.lit(kind))).first()[0] == score


TRUTH = {"required_sections": ["结论", "建议"], "evidence_keywords": ["Revenue"], "risk_labels": ["loss_making", "odd"], "length_range": [5, 100], "numeric_targets": [{"name": "r", "value": 12.5, "unit": "", "tolerance": 0.2, "terms": ["revenue"]}], "numeric_support": [{"value": 12.5, "tolerance": 0.1}, {"value": 3.0, "tolerance": 0.0}], "trend_targets": [{"metric": "revenue", "label": "up", "terms": ["rise"], "opposites": ["fall"]}]}


def scored(spark, answer, truth=None):
    import json

    df = spark.createDataFrame([(answer, json.dumps(truth or TRUTH))], "answer string, t string").withColumn("truth", F.from_json("t", rewards.TRUTH))
    return rewards.score_completion(df, "answer", "truth").first()


def test_rewards_of_a_full_answer(spark):
    row = scored(spark, "【结论】revenue 12.5 shows a rise；odd 亏损 3\n【建议】go")
    assert [row[c] for c in ("numeric", "trend", "format", "evidence", "risk", "length", "overall")] == [1.0] * 7


def test_rewards_of_poor_answers(spark):
    row = scored(spark, "revenue 12.5 rise and fall, also 999999")
    assert row.format == 0 and row.numeric_recall == 1 and row.numeric_precision == 0.5 and row.trend == 0.5 and row.risk == 0
    far = scored(spark, "12.5 stands far away from the word we look for, revenue")
    assert far.numeric_recall == 0 and far.numeric_precision == 1
    nothing = scored(spark, "x", {"required_sections": []})
    assert all(nothing[c] is None for c in ("numeric", "trend", "format", "evidence", "risk", "length")) and math.isnan(nothing.overall)
    twice = scored(spark, "【建议】a【结论】b【结论】c")
    assert twice.format == pytest.approx(0.85 - 0.08)


def test_sparse_kl(spark):
    a = F.array(F.lit(math.log(0.5)), F.lit(math.log(0.3)))
    b = F.array(F.lit(math.log(0.2)), F.lit(math.log(0.3)))
    same, other, bad = one(spark, losses.sparse_forward_kl(a, a), losses.sparse_forward_kl(a, b), losses.sparse_forward_kl(F.array(F.lit(0.1)), a))
    assert same == pytest.approx(0, abs=1e-12) and other == pytest.approx(0.5 * math.log(2.5) + 0.2 * math.log(0.4)) and bad is None


REASONS = [
    ("5", "5", "", "empty_prediction"), ("5", "5", "【结论】x", "structured_template_intrusion"), ("5", "5", "about 5 units", "numeric_reference_embedded_with_extra_output"), ("paris", "paris", "it is paris", "text_reference_embedded_with_extra_output"),
    ("2020", "2020", "2021", "year_value_or_answer_type_error"), ("55", "55", "55%", "numeric_percent_scale_ambiguity"), ("100", "100", "104", "numeric_value_error_within_5pct"), ("100", "100", "108", "numeric_value_error_5_to_10pct"),
    ("100", "100", "150 usd", "numeric_unit_or_text_output_over_10pct"), ("100", "100", "1 and 2", "numeric_value_embedded_or_multi_number_error"), ("100", "100", "none", "numeric_missing_or_non_numeric"),
    ("['a1', '5']", "['a1', '5']", "other", "multi_answer_structure_or_content_error"), ("paris", "paris", "rome", "text_label_or_content_error"), ("paris", "rome", "rome", "unclassified_score_change"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(REASONS)], "i int, answer string, b string, c string, want string").withColumn("items", comparison.answer_items(F.col("answer")))
    none = F.lit(None).cast("int")
    parts = comparison.reason_parts(F.col("items"), comparison.answer_kind(F.col("items")), F.array("answer"), F.when(F.col("answer") == "2020", "In which year?").otherwise("What?"), F.array().cast("array<string>"), F.col("b"), F.col("c"), none, none, 128)
    got = df.withColumns(parts).select("i", "want", comparison.reason().alias("got")).orderBy("i").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_transitions_and_bootstrap(spark):
    pairs = spark.createDataFrame([("1", "m", 1.0, 0.0), ("2", "m", 1.0, 0.0), ("3", "m", 0.0, 1.0), ("4", "m", 1.0, 1.0)], "id string, metric string, baseline double, candidate double")
    row = comparison.transitions(pairs, ["metric"]).first()
    assert (row.both_right, row.lost, row.gained, row.both_wrong, row.regression_mass) == (1, 2, 1, 0, 2.0)
    assert comparison.paired_summary(pairs, ["metric"]).first().delta == -0.25
    a, b = (comparison.bootstrap_numpy(pairs, ["metric"], samples=300).first() for _ in range(2))
    assert a == b and a.low <= a.delta <= a.high
    assert comparison.transitions(pairs.withColumn("baseline", F.lit(0.5)), ["metric"]).first().lost is None


def test_gates(spark):
    summary = spark.createDataFrame([("exact", 0.5, 1.0), ("relaxed", -0.1, 0.2)], "metric string, delta double, p_positive double")
    rules = spark.createDataFrame([("required", "exact", 0.4, 0.9), ("guardrail", "relaxed", -0.2, 0.0), ("required", "absent", 0.0, 0.0)], "kind string, metric string, min_delta double, min_probability double")
    checks = comparison.gate_checks(summary, rules)
    assert {r.metric: r.passed for r in checks.collect()} == {"exact": True, "relaxed": True, "absent": False}
    assert comparison.verdict(checks).first().passed is False
    issues = one(spark, gates.protocol_issues(F.lit("【结论】a【数据依据】b"), ["结论", "数据依据"]), gates.protocol_issues(F.lit("## 结论\n【建议】"), ["结论"]))
    assert issues[0] == [] and set(issues[1]) == {"start", "count_0", "order", "unexpected", "heading"}


def test_facts(spark):
    f = lambda *c: one(spark, *c)[0]
    assert f(facts.change_pct(F.lit(0.0), F.lit(5.0))) == 0 and f(facts.change_pct(F.lit(4.0), F.lit(5.0))) == 25
    assert f(facts.cagr_pct(F.lit(100.0), F.lit(121.0), F.lit(2))) == pytest.approx(10) and f(facts.cagr_pct(F.lit(-1.0), F.lit(2.0), F.lit(2))) == 0
    assert [f(facts.trend_label(F.lit(x))) for x in (3.0, 3.1, -3.1)] == ["stable", "increase", "decrease"]
    values = spark.createDataFrame([(2.675, 2), (0.5, 0), (1.15, 1)], "v double, d int").select(facts.round_half_even("v", "d").alias("r")).collect()
    assert [r.r for r in values] == [2.67, 0.0, 1.1]
    a = facts.synthetic_entities(spark, 192).orderBy("entity_id").collect()
    assert a == facts.synthetic_entities(spark, 192).repartition(7).orderBy("entity_id").collect()
    assert all(abs(sum(r.product_mix_pct.values()) - 100) < 0.2 and abs(r.revenue[0] - r.cost[0] - r.profit[0]) < 0.2 for r in a)


def test_bootstrap_numpy_draws_little_at_a_time_and_the_same(spark):
    rng = np.random.default_rng(5)
    for deltas in (rng.integers(-1, 2, 3001).astype(float), rng.normal(size=3001)):
        index = np.random.default_rng(9).integers(0, 3001, size=(50, 3001), dtype=np.int32)
        for cells in (1000, 7001, 1 << 20):
            assert (comparison.resampled_means(deltas, 50, 9, cells) == deltas[index].mean(axis=1)).all()
    tracemalloc.start()
    comparison.resampled_means(rng.integers(-1, 2, 1_000_000).astype(float), 64, 9)
    assert tracemalloc.get_traced_memory()[1] < 40e6  # 64 rows of indices and differences at once: 768 MB
    tracemalloc.stop()
    rows = [(i, g, float(i % 2), float(i * 7 % 3)) for i in range(300) for g in ("a", "b", None)]
    pairs = spark.createDataFrame(rows, "id long, metric string, baseline double, candidate double").repartition(3)
    got = {r.metric: r for r in comparison.bootstrap_numpy(pairs, ["metric"], samples=40, cells=128).collect()}
    deltas = np.array([i * 7 % 3 - i % 2 for i in range(300)], float)
    means = deltas[np.random.default_rng(comparison.SEED).integers(0, 300, size=(40, 300), dtype=np.int32)].mean(axis=1)
    assert set(got) == {"a", "b", None} and all((r.n, r.low, r.high) == (300, round(np.quantile(means, 0.025), 6), round(np.quantile(means, 0.975), 6)) for r in got.values())
