"""Scores of prediction rows by their dataset, and the records that leave for other judges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from prismark.functions import rewards, text
from prismark.functions.rewards import TRUTH

#: Names of scores: of generated records, of plain public answers, and of free answers.
COMPONENTS = [*rewards.REGISTRY, "numeric_recall", "numeric_precision", "overall"]
PUBLIC = ["relaxed_accuracy", "exact_match"]
SURROGATE = {"surrogate_exact_match": "exact_match", "surrogate_anls": "anls", "surrogate_token_f1": "token_f1", "surrogate_numeric_precision": "numeric_precision", "surrogate_numeric_recall": "numeric_recall", "output_nonempty": "nonempty"}
METRICS = [*COMPONENTS, *PUBLIC, *SURROGATE]
#: Dataset names that decide how a row is scored: generated records by their beginning, list answers and free answers by name.
GENERATED, LISTS, OPEN = "generated", "chartqapro", "mmefinance"


def message_text(content: Column) -> Column:
    """Text of a message's content: plain, or JSON blocks whose texts are joined."""
    blocks = F.from_json(content, "array<struct<text:string>>")
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "")
    return text.strip(F.when(content.startswith("[") & blocks.isNotNull(), joined).otherwise(content))


def completion_text(value: Column) -> Column:
    """Text of a completion: plain text, a JSON message with content, or a JSON list of messages (their texts, a line each)."""
    one, many = F.from_json(value, "struct<content:string>")["content"], F.from_json(value, "array<struct<content:string>>")
    texts = F.filter(F.transform(many, lambda m: message_text(F.coalesce(m["content"], F.lit("")))), lambda t: t != "")
    plain = text.strip(value)
    return F.when(plain.startswith("{") & one.isNotNull(), message_text(one)).when(plain.startswith("[") & (F.size(texts) > 0), text.strip(F.array_join(texts, "\n"))).otherwise(plain)


def aliases(truth: Column, answer: Column) -> Column:
    """The accepted answers: the truth's own, or the answer alone."""
    return F.coalesce(truth["answer_aliases"], F.array(answer))


def question_type(metadata: Column) -> Column:
    return F.coalesce(F.nullif(metadata["question_type"], F.lit("")), F.lit("unknown"))


def is_public(dataset: Column) -> Column:
    """Whether a dataset is one of the public ones, whose prompts ask for a bare answer."""
    return F.lower(dataset).isin("chartqa", LISTS, OPEN)


def score_rows(rows: DataFrame, weights: dict[str, float] = rewards.WEIGHTS) -> DataFrame:
    """`rows` (dataset, answer, ground_truth, metadata, prediction) with a column for each of METRICS, null where it does not apply.

    Each kind of dataset is a branch of its own, so that no row passes through another kind's functions.
    """
    name = F.coalesce(F.lower("dataset"), F.lit(""))
    kinds = {"generated": name.startswith(GENERATED), "open": name == OPEN, "lists": name == LISTS}
    rest = ~(kinds["generated"] | kinds["open"] | kinds["lists"])
    base = rows.drop(*METRICS).withColumn("_said", F.coalesce(F.col("prediction"), F.lit("")))
    truth = F.from_json("ground_truth", TRUTH)
    said, known = F.col("_said"), aliases(F.col("_truth"), F.col("answer"))

    made = rewards.score_completion(base.filter(kinds["generated"]).withColumn("_truth", truth), "_said", "_truth", weights)
    free = base.filter(kinds["open"]).withColumn("_open", text.open_answer_scores(F.col("answer"), said))
    free = free.withColumns({c: F.col(f"_open.{f}") for c, f in SURROGATE.items()})
    # The items are columns of their own: no lambda may hold a Python function.
    lists = base.filter(kinds["lists"]).withColumns({"_truth": truth, "_want": text.list_items(F.col("answer")), "_got": text.list_items(said)})
    lists = lists.withColumns({"relaxed_accuracy": text.multi_answer_accuracy(F.col("_want"), F.col("_got"), F.col("metadata.year_flags"), F.col("metadata.question_type")), "exact_match": text.exact_match(said, known)})
    plain = base.filter(rest).withColumn("_truth", truth).withColumns({"relaxed_accuracy": text.relaxed_accuracy(said, known), "exact_match": text.exact_match(said, known)})

    def whole(df: DataFrame) -> DataFrame:
        return df.select(*base.drop("_said").columns, *(F.col(m) if m in df.columns else F.lit(None).cast("double").alias(m) for m in METRICS))

    return reduce(DataFrame.unionByName, map(whole, (made, free, lists, plain)))


def official_rows(rows: DataFrame) -> DataFrame:
    """Answer, Question Type, Year, prediction of the list-answer rows, for their own judge."""
    return rows.filter(F.lower("dataset") == LISTS).select(
        F.coalesce("metadata.answer_sequence", F.array("answer")).alias("Answer"), F.coalesce("metadata.question_type", F.lit("unknown")).alias("Question Type"),
        F.coalesce("metadata.year_flags", F.array(F.lit("NO"))).alias("Year"), F.coalesce("prediction", F.lit("")).alias("prediction"))


def audit_rows(rows: DataFrame) -> DataFrame:
    """Eleven columns of the free-answer rows for a judge that sees the image; the last holds the surrogate scores."""
    meta = ["source_image_path", "image_type", "image_style", "task_category"]
    scores = text.open_answer_scores(F.coalesce("answer", F.lit("")), F.coalesce("prediction", F.lit("")))
    return rows.filter(F.lower("dataset") == OPEN).withColumn("_s", scores).select(
        F.col("metadata.source_index").alias("index"), "image", *(F.col(f"metadata.{c}").alias(c) for c in meta), "question", F.col("answer").alias("reference_answer"),
        F.coalesce("metadata.background", F.lit("")).alias("background"), F.coalesce("prediction", F.lit("")).alias("prediction"),
        F.struct(*(F.col(f"_s.{f}").alias(c) for c, f in SURROGATE.items())).alias("surrogate_scores"))
