"""System and user prompts by dataset and task, as Column expressions, and the messages made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prismark.functions.rewards import TRUTH
from prismark.functions.text import strip
from prismark.operators.scoring import OPEN, is_public

#: Sections of a task's answer, and what else depends on the task.
TASK_SECTIONS = {
    "value_retrieval": ["结论", "数据依据"],
    "numerical_reasoning": ["结论", "数据依据"],
    "relationship_analysis": ["结论", "数据依据"],
    "trend_analysis": ["结论", "数据依据", "风险"],
    "risk_diagnosis": ["结论", "数据依据", "风险"],
    "decision_support": ["结论", "数据依据", "风险", "建议"],
    "comprehensive_report": ["结论", "数据依据", "风险", "建议"],
}
MOST_CHARACTERS = {"comprehensive_report": 420, "decision_support": 320}
OTHER_CHARACTERS = 260


def required_sections(task: Column, view: Column) -> Column:
    """Section names of a task's answer; null for an unknown task. A relationship in a financial view has a risk section too."""
    known = F.create_map(*(x for t, names in TASK_SECTIONS.items() for x in (F.lit(t), F.array(*map(F.lit, names)))))
    names = F.try_element_at(known, task)
    return F.when((task == "relationship_analysis") & F.coalesce(view == "financial", F.lit(False)), F.concat(names, F.array(F.lit("风险")))).otherwise(names)


def most_characters(task: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in MOST_CHARACTERS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, task), F.lit(OTHER_CHARACTERS))


def strict_prompt(dataset: Column, task: Column, view: Column, texts: dict[str, str], focus: dict[str, str]) -> Column:
    """A system prompt that states the answer's protocol; an error for public datasets and unknown tasks.

    texts: `opening`, `labels` (before the section tags), `rules`, `focus` (before the task's own), `evidence`, `risk`, `advice`
    (only where the answer has such a section), and `limit` with {n}, the most characters. focus: task to its sentence.
    """
    names = required_sections(task, view)
    tags = F.array_join(F.transform(names, lambda s: F.concat(F.lit("【"), s, F.lit("】"))), "、")
    own = F.try_element_at(F.create_map(*(F.lit(x) for pair in focus.items() for x in pair)), task)
    say = lambda k: F.lit(texts.get(k, ""))
    only = lambda s, k: F.when(F.array_contains(names, s), say(k)).otherwise("")
    limit = F.replace(say("limit"), F.lit("{n}"), most_characters(task).cast("string"))
    prompt = F.concat(say("opening"), say("labels"), tags, say("rules"), say("focus"), F.coalesce(own, F.lit("")), say("evidence"), only("风险", "risk"), only("建议", "advice"), limit)
    return F.when(is_public(dataset) | names.isNull(), F.raise_error(F.concat(F.lit("no strict protocol for "), dataset, F.lit(" "), F.coalesce(task, F.lit("null"))))).otherwise(prompt)


def system_prompt(dataset: Column, domain: str, public: str, finance: str) -> Column:
    return F.when(F.lower(dataset) == OPEN, finance).when(is_public(dataset), public).otherwise(domain)


def user_prompt(dataset: Column, question: Column, background: Column) -> Column:
    """The question; finance questions come after their background, where there is one."""
    known = strip(F.coalesce(background, F.lit("")))
    return F.when((F.lower(dataset) == OPEN) & (known != ""), F.concat(F.lit("Background:\n"), known, F.lit("\n\nQuestion:\n"), question)).otherwise(question)


def _block(kind: str, text: Column | None = None, image: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("type"), (none if text is None else text).alias("text"), (none if image is None else image).alias("image"))


def _message(role: str, *blocks: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*blocks).alias("content"))


def inference_messages(system: Column, user: Column, image: Column) -> Column:
    """What a model is asked: a system text, then the image and the user's text."""
    return F.array(_message("system", _block("text", system)), _message("user", _block("image", image=image), _block("text", user)))


def sft_examples(records: DataFrame, system: Column, user: Column) -> DataFrame:
    """id, images, prompt, completion of records, for supervised training."""
    return records.select("id", F.array("image").alias("images"), inference_messages(system, user, F.lit(None).cast("string")).alias("prompt"), F.array(_message("assistant", _block("text", F.col("answer")))).alias("completion"))


def grpo_examples(records: DataFrame, system: str) -> DataFrame:
    """id, prompt, image, ground_truth, task_type of the records that may be rewarded; none at all is an error."""
    rows = records.filter(F.coalesce(F.from_json("ground_truth", TRUTH)["grpo_eligible"], F.lit(False)))
    if rows.isEmpty():
        raise ValueError("no record may be rewarded")
    return rows.select("id", inference_messages(F.lit(system), F.col("question"), F.lit(None).cast("string")).alias("prompt"), "image", "ground_truth", "task_type")


def annotated(records: DataFrame, dual: DataFrame, round_id: int, version: str, role: str = "audit_only_not_training_target") -> DataFrame:
    """`records` with metadata.opd: version, round, and two rollouts for the ids of `dual`, one for others."""
    twice = records.join(dual.select("id", F.lit(2).alias("_twice")), "id", "left")
    opd = F.struct(F.lit(version).alias("dataset_version"), F.lit(round_id).alias("round"), F.coalesce("_twice", F.lit(1)).alias("rollout_count"), F.lit(role).alias("original_answer_role"))
    return twice.withColumn("metadata", F.col("metadata").withField("opd", opd)).drop("_twice").select(*records.columns)
