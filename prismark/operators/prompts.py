"""Projections from turns and records to prompts and chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, role, text) in order. A conversation's turns are few; they fit a row."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def flatten_conversation(turns: DataFrame) -> DataFrame:
    """conv_id, prompt: the last turn is the question, earlier ones come before it as history."""
    line = lambda t: F.concat(F.initcap(t["role"]), F.lit(": "), F.coalesce(t["text"], F.lit("")))
    rows = ordered_turns(turns)
    history = F.slice("turns", F.lit(1), F.size("turns") - 1)
    last = F.coalesce(F.element_at("turns", -1)["text"], F.lit(""))
    prompt = F.when(F.size("turns") > 1, F.concat(F.lit("Conversation history:\n"), F.array_join(F.transform(history, line), "\n"), F.lit("\n\n"), last)).otherwise(last)
    return rows.select("conv_id", F.size("turns").alias("n_turns"), prompt.alias("prompt"))


def chat_messages(turns: DataFrame) -> DataFrame:
    """conv_id, messages: array of (role, content)."""
    return ordered_turns(turns).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))


def instruction(system: Column, background: Column, question: Column) -> Column:
    """One text of a system part, an optional background and the question."""
    return F.concat_ws("\n", system, F.when(F.trim(background) != "", F.concat(F.lit("Background: "), background)), question)


def sft_example(question: str, answer: str, system: Column) -> Column:
    """Three messages of a supervised example."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("system", system), message("user", F.col(question)), message("assistant", F.col(answer)))


def rollout_jobs(records: DataFrame, key: str, count: Column, namespace: str) -> DataFrame:
    """A row for each rollout of a record, with its own key and seed below 2^31."""
    from prismark.functions.hashing import hash_number

    jobs = records.withColumn("rollout_index", F.explode(F.sequence(F.lit(0), count - 1)))
    return jobs.withColumn("rollout_key", F.concat_ws("_", F.col(key), "rollout_index")).withColumn("seed", hash_number(namespace, F.col(key), F.col("rollout_index")) % (1 << 31))
