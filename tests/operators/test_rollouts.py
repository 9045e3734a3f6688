import json

from pyspark.sql import functions as F

from prismark.operators import facts, questions, rollouts
from prismark.sources.records import ROLLOUT, TEACHER_SCORE


def test_rollout_checks(spark):
    good = ("1", "k", "r", "h", "d", "train", "i", "p", None, None, 1, 0, [1, 2], [3])
    rows = spark.createDataFrame([good, (*good[:10], 0, -1, [], [-1])], ROLLOUT)
    hashed = rows.withColumns({"prompt_token_ids_sha256": rollouts.array_hash(F.col("prompt_token_ids")), "completion_token_ids_sha256": F.when(F.size("prompt_token_ids") > 0, rollouts.array_hash(F.col("completion_token_ids")))})
    assert [set(r[0]) for r in hashed.select(rollouts.rollout_errors()).collect()] == [set(), {"prompt_ids", "completion_ids", "completion_hash", "round", "index"}]
    summary = rollouts.rollout_summary(hashed).first()
    assert (summary.rows, summary.prompts, summary.completion_tokens, summary.empty) == (2, 1, 2, 0)
    assert rollouts.with_token_presence(hashed, 2).first().token_count == 1


def test_ragged_scores_round_trip(spark):
    rows = spark.createDataFrame([("a", "", "", [5, 6], [[1, 2], [3, 4]], [[-0.5, -2.0], [-1.0, -3.0]]), ("b", "", "", [7], [[9, 8]], [[-0.1, -4.0]])], TEACHER_SCORE)
    back = rollouts.nested(rollouts.flattened(rows)).select(*rows.columns)
    assert sorted(back.collect()) == sorted(rows.collect())
    assert [r[0] for r in rows.select(rollouts.score_errors()).collect()] == [[], []]
    bad = spark.createDataFrame([("a", "", "", [5], [[1, 2], [3]], [[0.5, 0.5], [-1.0]])], TEACHER_SCORE)
    assert {"tokens", "width", "logprobs", "mass"} <= set(bad.select(rollouts.score_errors()).first()[0])


def test_dual_rollouts(spark):
    records = spark.createDataFrame([(i, "hard" if i < 1 else "easy", "t") for i in range(8)], "id int, difficulty string, task string")
    got = rollouts.dual_rollouts(records, 0.25, "n", ["task"]).collect()
    assert sorted(r.rollout_count for r in got) == [1] * 6 + [2] * 2 and next(r for r in got if r.id == 0).rollout_count == 2


def test_questions(spark):
    entities = facts.synthetic_entities(spark, 24)
    rows = questions.entity_records(entities).collect()
    assert len(rows) == 24 * 2 * 4 and len({r.id for r in rows}) == len(rows)
    assert all(r.answer and r.question and r.chart_id.startswith(r.entity_id) for r in rows)
    truths = [json.loads(r.ground_truth) for r in rows]
    assert all(t["tolerance"] >= 0.2 or t["unit"] == "year" for g in truths for t in g["numeric_targets"]) and all(g["required_sections"][:2] == ["结论", "数据依据"] and g["grpo_eligible"] for g in truths)
    assert all({"value": 2021.0, "tolerance": 0.0} in g["numeric_support"] for g in truths)
    one, truth = next((r, g) for r, g in zip(rows, truths) if r.task_type == "value_retrieval" and r.view_type == "financial")
    assert f"{truth['numeric_targets'][0]['value']:.1f}" in one.answer and truth["numeric_targets"][0]["terms"] == ["收入", "Revenue"]
    assert questions.default_terms("margin_change") == ["利润率", "Margin", "变化"] and questions.default_terms("revenue_yoy") == ["收入", "Revenue", "同比"] and questions.default_terms("x") == []
