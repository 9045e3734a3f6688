"""Rollout and teacher-score artifacts: identity, validation, ragged and flat forms, summaries, panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prismark.functions.hashing import ordered_hash, sha256_hex
from prismark.operators.audit import record_errors
from prismark.operators.selection import stratified_sample

IDENTITY = ["id", "dataset", "split", "question", "answer", "ground_truth"]


def array_hash(values: Column) -> Column:
    """Identity of an array of numbers: the hash of its compact JSON."""
    return sha256_hex(F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ","), F.lit("]")))


def record_identity(fields: list[str] = IDENTITY) -> Column:
    """Identity of a record over some fields, nulls included, by its JSON."""
    return sha256_hex(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}))


def rollout_errors() -> Column:
    """Failed checks of a rollout row, as an array of names."""
    bad = lambda c: F.coalesce(F.size(c) == 0, F.lit(True)) | F.exists(c, lambda x: x.isNull() | (x < 0))
    return record_errors({
        "prompt_ids": bad("prompt_token_ids"), "completion_ids": F.exists("completion_token_ids", lambda x: x.isNull() | (x < 0)) | F.col("completion_token_ids").isNull(),
        "prompt_hash": ~F.col("prompt_token_ids_sha256").eqNullSafe(array_hash(F.col("prompt_token_ids"))),
        "completion_hash": ~F.col("completion_token_ids_sha256").eqNullSafe(array_hash(F.col("completion_token_ids"))),
        "round": F.coalesce(F.col("round") < 1, F.lit(True)), "index": F.coalesce(F.col("rollout_index") < 0, F.lit(True)),
    })


def score_errors() -> Column:
    """Failed checks of a teacher's score row: a rectangle of ids and log-probabilities, one row a token."""
    ids, logs = F.col("topk_token_ids"), F.col("topk_logprobs")
    widths = F.array_distinct(F.transform(ids, F.size))
    return record_errors({
        "tokens": ~F.coalesce(F.size(ids) == F.size("completion_token_ids"), F.lit(False)),
        "width": F.coalesce(F.size(widths) > 1, F.lit(True)),
        "shape": F.coalesce(F.transform(ids, F.size) != F.transform(logs, F.size), F.lit(True)),
        "ids": F.exists(ids, lambda row: F.exists(row, lambda x: x < 0)),
        "logprobs": F.exists(logs, lambda row: F.exists(row, lambda x: F.isnan(x) | (x > 1e-4))),
        "mass": F.exists(topk_mass(logs), lambda m: m > 1.0001),
    })


def topk_mass(logs: Column) -> Column:
    """Probability that each token's top entries hold."""
    return F.transform(logs, lambda row: F.aggregate(row, F.lit(0.0), lambda s, x: s + F.exp(x)))


def flattened(scores: DataFrame) -> DataFrame:
    """Nested rows as flat arrays with the width of a token's entries."""
    return scores.withColumns({"width": F.coalesce(F.size(F.get("topk_token_ids", F.lit(0))), F.lit(0)), "flat_ids": F.flatten("topk_token_ids"), "flat_logprobs": F.flatten("topk_logprobs")}).drop("topk_token_ids", "topk_logprobs")


def nested(flat: DataFrame) -> DataFrame:
    """The reverse of flattened."""
    rows = lambda c: F.when(F.col("width") > 0, F.transform(F.sequence(F.lit(0), (F.size(c) / F.col("width")).cast("int") - 1), lambda i: F.slice(c, i * F.col("width") + 1, F.col("width")))).otherwise(F.array(F.slice(c, 1, 0)))
    return flat.withColumns({"topk_token_ids": rows("flat_ids"), "topk_logprobs": rows("flat_logprobs")}).drop("width", "flat_ids", "flat_logprobs")


def mass_summary(scores: DataFrame, shard: str) -> DataFrame:
    """Tokens, mean and least mass of each shard."""
    token = scores.select(shard, F.explode(topk_mass(F.col("topk_logprobs"))).alias("m"))
    return token.groupBy(shard).agg(F.count("*").alias("tokens"), F.round(F.avg("m"), 6).alias("mean_mass"), F.round(F.min("m"), 6).alias("least_mass"))


def rollout_summary(rollouts: DataFrame) -> DataFrame:
    """One row: rows, prompts, rounds, tokens, empty completions, and a hash over keys in order."""
    return rollouts.agg(
        F.count("*").alias("rows"), F.countDistinct("record_id").alias("prompts"), F.array_sort(F.collect_set("round")).alias("rounds"), F.sum(F.size("completion_token_ids")).alias("completion_tokens"),
        F.count_if(F.size("completion_token_ids") == 0).alias("empty"), ordered_hash(F.col("rollout_key"), F.col("rollout_key")).alias("keys_sha256"))


def dual_rollouts(records: DataFrame, fraction: float, namespace: str, strata: list[str]) -> DataFrame:
    """`records` with rollout_count: 2 for a share of them, hard ones first, by strata; else 1."""
    total = records.count()
    wanted = round(total * fraction)
    hard = records.filter("difficulty = 'hard'")
    n_hard = min(hard.count(), wanted)
    chosen = stratified_sample(hard, strata, n_hard, f"{namespace}:hard", "id").select("id") if n_hard else records.select("id").limit(0)
    if wanted > n_hard:
        rest = records.filter("difficulty <> 'hard' or difficulty is null")
        chosen = chosen.unionByName(stratified_sample(rest, strata, wanted - n_hard, f"{namespace}:rest", "id").select("id"))
    return records.join(chosen.withColumn("_twice", F.lit(2)), "id", "left").withColumn("rollout_count", F.coalesce("_twice", F.lit(1))).drop("_twice")


def with_token_presence(rollouts: DataFrame, token: int) -> DataFrame:
    """`rollouts` with how often a token is in the prompt."""
    return rollouts.withColumn("token_count", F.size(F.filter("prompt_token_ids", lambda x: x == token)))
