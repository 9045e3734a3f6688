"""Commands over JSON-lines files: python -m prismark.cli <command> --config file. Settings come from the command line, the environment, the file."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismark.functions.hashing import SEED
from prismark.operators import charts, facts, gates, questions, reports, scoring, subsets, validation
from prismark.sources import artifacts, packages, records

Command = Callable[[SparkSession, dict], int]
COMMANDS: dict[str, Command] = {}


def command(name: str) -> Callable[[Command], Command]:
    def register(function: Command) -> Command:
        COMMANDS[name] = function
        return function

    return register


def _fresh(path: str, force: bool) -> str:
    if Path(path).exists() and not force:
        raise FileExistsError(f"{path} exists already; look at it before it is replaced")
    return path


def _read(spark: SparkSession, path: str, schema: str = records.RECORD) -> DataFrame:
    return records.read_jsonl(spark, path, schema)


def _scored(spark: SparkSession, config: dict, name: str) -> DataFrame:
    rows = records.assert_contract(_read(spark, packages.require(config, f"inputs.{name}"), records.PREDICTION), key="id", rows=config.get("inputs", {}).get("expected_rows"), split=config.get("inputs", {}).get("expected_split"))
    return scoring.score_rows(rows, config.get("reward_weights") or scoring.rewards.WEIGHTS)


def _document(config: dict, document: dict) -> int:
    records.write_report(document, _fresh(packages.require(config, "output"), config.get("force", False)))
    return 0 if document.get("status", "passed") == "passed" else 1


@command("build")
def build(spark: SparkSession, config: dict) -> int:
    """Entities, charts and records."""
    out, seed = packages.require(config, "output"), config.get("seed", SEED)
    entities = facts.synthetic_entities(spark, packages.require(config, "entities"), seed)
    views = entities.withColumn("view_type", F.explode("views")).withColumn("chart_id", F.concat_ws("_", "entity_id", "view_type"))
    entities.write.mode("errorifexists").parquet(f"{out}/entities")
    charts.rendered(views, seed).write.mode("errorifexists").parquet(f"{out}/charts")
    records.write_jsonl(questions.entity_records(entities), f"{out}/records")
    return 0


@command("validate")
def validate(spark: SparkSession, config: dict) -> int:
    """The validation report of a folder of splits."""
    rows = records.with_truth(artifacts.read_splits(spark, packages.require(config, "annotations"), records.RECORD))
    issues = validation.dataset_issues(rows, spark.read.parquet(packages.require(config, "entities")))
    return _document(config, validation.validation_report(rows, issues))


@command("evaluate")
def evaluate(spark: SparkSession, config: dict) -> int:
    """Scores of one prediction file."""
    scored = _scored(spark, config, "predictions")
    return _document(config, {"metrics": reports.nested(reports.evaluation_report(scored), ["field", "value", "metric"]), "efficiency": reports.efficiency_report(scored).first().asDict()})


@command("compare")
def compare(spark: SparkSession, config: dict) -> int:
    """Two prediction files, pair by pair."""
    table = reports.comparison_report(_scored(spark, config, "baseline"), _scored(spark, config, "candidate"), samples=config.get("bootstrap_samples", 2000), seed=config.get("seed", SEED), exact=config.get("exact", False))
    return _document(config, reports.nested(table, ["field", "value", "metric"]))


@command("error-migration")
def error_migration(spark: SparkSession, config: dict) -> int:
    """What got worse between two prediction files, and why."""
    parts = reports.migration_report(_scored(spark, config, "baseline"), _scored(spark, config, "candidate"), config.get("max_new_tokens", 128), config.get("examples_per_reason", 5))
    reports.assert_expected(parts["groups"], config.get("expected", {}))
    keys = {"groups": ["field", "value", "metric"], "behavior": ["side"], "reasons": ["reason"], "scopes": ["scope"], "reasons_by_scope": ["reason", "scope"], "signatures": ["signature"], "examples": ["reason", "rank"]}
    return _document(config, {name: reports.nested(table, keys[name]) for name, table in parts.items()})


@command("qualify")
def qualify(spark: SparkSession, config: dict) -> int:
    """A paired gate of two prediction files; it fails the command where it fails."""
    gates.candidate_contract(config, artifacts.read_document)
    rows = packages.require(config, "inputs.expected_rows")
    report = gates.paired_gate(_scored(spark, config, "baseline"), _scored(spark, config, "candidate"), packages.require(config, "gates"), rows=rows, passed=packages.require(config, "pass_gate"), failed=packages.require(config, "fail_gate"), split=packages.require(config, "inputs.expected_split"), samples=config.get("bootstrap_samples", 5000))
    return _document(config, report)


@command("gate")
def gate(spark: SparkSession, config: dict) -> int:
    """Absolute bounds on one prediction file."""
    scored = _scored(spark, config, "predictions")
    gates.exact_counts(scored, "task_type", packages.require(config, "inputs.expected_task_counts"))
    from prismark.operators.protocol import required_sections

    checks = gates.absolute_checks(scored, packages.require(config, "gates"), required_sections(F.col("task_type"), F.col("view_type")))
    return _document(config, gates.gate_document(checks, packages.require(config, "pass_gate"), packages.require(config, "fail_gate")))


@command("build-subsets")
def build_subsets(spark: SparkSession, config: dict) -> int:
    """Nested supervised sets, rewarded prompts and a validation panel."""
    s = packages.require(config, "selection")
    parts = subsets.training_subsets(_read(spark, config["train"]), _read(spark, config["rewarded"]), _read(spark, config["validation"]), screen=s["screen"], per_chart=s["per_chart"], prompts=s["prompts"], weights=s["task_weights"], panel=s["panel"])
    for name, df in parts.items():
        records.write_jsonl(df.orderBy("id"), f"{packages.require(config, 'output')}/{name}")
    return 0


@command("build-rounds")
def build_rounds(spark: SparkSession, config: dict) -> int:
    """Two rounds of unseen prompts and two panels."""
    s, out = packages.require(config, "selection"), packages.require(config, "output")
    parts, audit = subsets.unseen_build(_read(spark, config["train"]), _read(spark, config["seen"]), _read(spark, config["qualification"]), _read(spark, config["forbidden"]), rounds=tuple(s["round_rows"]), weights=s["task_weights"], per_chart=s["max_records_per_chart"], dual=s["dual_rollout_fraction"], panel=s["qualification_rows"], version=s["version"], strict=s.get("task_quota_policy", "strict") == "strict")
    for name, df in parts.items():
        records.write_jsonl(df.orderBy("id"), f"{out}/{name}")
    records.write_report(audit, f"{out}/audit.json")
    return 0


@command("audit-model")
def audit_model(_: SparkSession, config: dict) -> int:
    return _document(config, artifacts.audit_snapshot(packages.require(config, "model"), config.get("expected_shards"), int(config.get("minimum_weight_gib", 0) * 2**30), config.get("model_type"), config.get("validate_headers", False), config.get("hash_shards", False)))


@command("check-compatibility")
def check_compatibility(_: SparkSession, config: dict) -> int:
    fields = packages.require(config, "fields")
    return _document(config, artifacts.compare_interfaces(packages.require(config, "student"), packages.require(config, "teacher"), fields["token_ids"], fields["tokenizer"], fields["processor"]))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="prismark")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("--config", required=True)
    parser.add_argument("--output")
    parser.add_argument("--force", action="store_true")
    given = parser.parse_args(arguments)
    config = packages.load_config(given.config)
    config |= {"force": given.force, "output": packages.resolved("output", config, given.output, "PRISMARK_OUTPUT")}
    return COMMANDS[given.command](SparkSession.builder.getOrCreate(), config)


if __name__ == "__main__":
    sys.exit(main())
