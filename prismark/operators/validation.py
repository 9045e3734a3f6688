"""Validation of a whole dataset: rows, splits, charts, answers, entities, files and images, rolled up by severity."""

from __future__ import annotations

import struct
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from prismark.functions.rewards import _tolerance
from prismark.functions.text import NUMBER_PLAIN
from prismark.operators import audit

#: Severities under which a dataset fails.
FAILING = ["critical", "high"]
SPLIT_PAIRS = [("train", "val"), ("train", "test"), ("val", "test")]
PNG = b"\x89PNG\r\n\x1a\n"


def target_in_answer(target: Column, answer: Column) -> Column:
    """Whether an answer states a target's value within its tolerance."""
    stated = F.transform(F.regexp_extract_all(F.replace(answer, F.lit(","), F.lit("")), F.lit(NUMBER_PLAIN), F.lit(0)), lambda x: x.cast("double"))
    return F.exists(stated, lambda v: F.abs(v - target["value"]) <= _tolerance(target))


def missing_targets(records: DataFrame) -> DataFrame:
    """id, name, value of numeric targets that their own reference answer does not state."""
    rows = records.select("id", "answer", F.explode("gt.numeric_targets").alias("t"))
    return rows.filter(~F.coalesce(target_in_answer(F.col("t"), F.col("answer")), F.lit(False))).select("id", "t.name", "t.value")


def checksum_errors(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, expected, found of files (path, sha256) that differ from the manifest (path, sha256) or are missing."""
    return manifest.select("path", F.col("sha256").alias("expected")).join(files.select("path", F.col("sha256").alias("found")), "path", "left").filter(~F.col("expected").eqNullSafe(F.col("found")))


def _png_facts(content: bytes | None) -> tuple[int | None, int | None, str | None, str | None]:
    """(width, height, mode, error) of a PNG file; every chunk's checksum and all pixels are read."""
    if content is None or content[:8] != PNG:
        return None, None, None, "not a PNG image"
    try:
        at, packed, head = 8, [], None
        while at < len(content):
            (size,), kind = struct.unpack(">I", content[at : at + 4]), content[at + 4 : at + 8]
            body = content[at + 8 : at + 8 + size]
            if zlib.crc32(kind + body) != struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0]:
                return None, None, None, f"chunk {kind!r} is damaged"
            if kind == b"IHDR":
                head = struct.unpack(">IIBB", body[:10])
            elif kind == b"IDAT":
                packed.append(body)
            at += 12 + size
        width, height, depth, colour = head
        samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        if len(zlib.decompress(b"".join(packed))) != height * (1 + -(-width * samples * depth // 8)):
            return width, height, None, "pixels are missing"
        return width, height, {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[colour], None
    except (struct.error, zlib.error, TypeError, KeyError) as error:
        return None, None, None, str(error)


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("mode", StringType()), StructField("error", StringType())]))
def image_facts(contents: pd.Series) -> pd.DataFrame:
    """Size, mode and decoding error of PNG files' bytes."""
    return pd.DataFrame([_png_facts(bytes(c) if c is not None else None) for c in contents], columns=["width", "height", "mode", "error"]).astype({"width": "Int32", "height": "Int32"})


def image_audit(records: DataFrame, files: DataFrame, sample: int | None = 100) -> tuple[DataFrame, DataFrame]:
    """(missing image paths, facts of the images that are there); files: path, content. `sample`: decode so many, evenly over the paths in hash order."""
    used = records.select(F.col("image").alias("path")).distinct()
    there = used.join(files, "path")
    if sample is not None:
        there = there.orderBy(F.sha2("path", 256)).limit(sample)
    return used.join(files.select("path"), "path", "left_anti"), there.select("path", image_facts("content").alias("f")).select("path", "f.*")


def issue(df: DataFrame, severity: str, check: str, n: Column, remediation: str) -> DataFrame:
    """One row (severity, check, n, remediation) if `n`, an aggregate of `df`, is positive, else none."""
    return df.agg(n.cast("bigint").alias("n")).filter("n > 0").select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), "n", F.lit(remediation).alias("remediation"))


def dataset_issues(records: DataFrame, entities: DataFrame, per_chart: int = 4, least_unique: float = 0.8, checks: dict[str, Column] | None = None) -> DataFrame:
    """severity, check, n, remediation of `records` (with gt, the parsed truth) and `entities` (entity_id, revenue, cost, profit arrays)."""
    every = F.count("*")
    charts = records.groupBy("chart_id").agg(F.count("*").alias("rows"), F.countDistinct("answer").alias("answers"), F.countDistinct("question").alias("questions"))
    leaks = audit.leakage_matrix(records, "split", ["entity_id", "chart_id", "image"], SPLIT_PAIRS)
    bad = records.withColumn("errors", audit.record_errors(checks)).filter(F.size("errors") > 0) if checks else records.limit(0)
    points = entities.select(F.explode(F.arrays_zip("revenue", "cost", "profit")).alias("p"))
    twice = lambda df, key: df.agg((F.count("*") - F.countDistinct(key)).alias("n"))
    parts = [
        issue(bad, "critical", "schema", every, "mend the source before anything is trained on it"),
        issue(twice(records, "id"), "critical", "record_uniqueness", F.sum("n"), "make ids from dataset, entity, chart and task"),
        issue(leaks, "critical", "split_leakage", F.count_if(F.col("n_shared") > 0), "split by entity before charts and questions are made"),
        issue(charts, "high", "chart_question_grain", F.count_if(F.col("rows") != per_chart), "make all tasks of a chart together"),
        issue(charts, "high", "answer_task_alignment", F.count_if(F.col("answers") < F.col("rows")), "answer each task with what it asks for"),
        issue(charts, "high", "question_uniqueness", F.count_if(F.col("questions") < F.col("rows")), "give each task of a chart a question of its own"),
        issue(records.agg((F.countDistinct("answer") / F.greatest(F.lit(1), F.count("*"))).alias("share")), "high", "answer_diversity", F.count_if(F.col("share") < least_unique), "vary what answers state"),
        issue(missing_targets(records), "critical", "reference_ground_truth_consistency", every, "make answer and ground truth from the same facts"),
        issue(twice(entities, "entity_id"), "critical", "company_uniqueness", F.sum("n"), "mend the entity ids and split again"),
        issue(points, "critical", "business_identity", F.count_if(F.abs(F.col("p.revenue") - F.col("p.cost") - F.col("p.profit")) > 0.11), "derive profit after rounding revenue and cost"),
    ]
    return reduce(DataFrame.unionByName, parts)


def file_issues(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return issue(checksum_errors(files, manifest), "critical", "manifest_checksums", F.count("*"), "rebuild files and manifest together")


def image_issues(records: DataFrame, files: DataFrame, size: tuple[int, int] | None = None, sample: int | None = 100) -> DataFrame:
    """Issues of missing, undecodable and wrongly sized images."""
    missing, facts = image_audit(records, files, sample)
    broken = F.col("error").isNotNull() | ~F.coalesce(F.col("mode").isin("RGB", "RGBA"), F.lit(False))
    parts = [issue(missing, "critical", "image_referential_integrity", F.count("*"), "rebuild images and annotations together"), issue(facts, "critical", "image_decode", F.count_if(broken), "render the damaged images again")]
    if size:
        parts.append(issue(facts, "high", "image_shape", F.count_if((F.col("width") != size[0]) | (F.col("height") != size[1])), "render at a fixed size"))
    return reduce(DataFrame.unionByName, parts)


def rolled_up(issues: DataFrame) -> DataFrame:
    """One row: number of issues by severity, and the status: failed with any critical or high one."""
    return issues.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low"))).withColumn("status", F.when(F.col("critical") + F.col("high") > 0, "failed").otherwise("passed"))


def validation_report(records: DataFrame, issues: DataFrame) -> dict:
    """The document of a validation: sizes by split, distributions, severities, issues; all of them are small."""
    by_split = records.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("entity_id").alias("entities"), F.countDistinct("chart_id").alias("charts")).collect()
    counts = audit.distributions(records, ["task_type", "view_type", "difficulty"]).collect()
    unique = records.agg(F.round(F.countDistinct("answer") / F.greatest(F.lit(1), F.count("*")), 6)).first()[0]
    found = [r.asDict() for r in issues.orderBy("severity", "check").collect()]
    severities = {s: sum(i["severity"] == s for i in found) for s in sorted({i["severity"] for i in found})}
    return {
        "status": "failed" if any(s in FAILING for s in severities) else "passed", **{k: {r.split: r[k] for r in by_split} for k in ("rows", "entities", "charts")}, "unique_answer_ratio": unique,
        **{f"{f}_distribution": {r.value: r.n for r in sorted(counts, key=lambda r: str(r.value)) if r.field == f} for f in ("task_type", "view_type", "difficulty")}, "severity_counts": severities, "issues": found,
    }
