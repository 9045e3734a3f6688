"""Readers and writers of records: JSON lines, tab-separated text, several tagged sources, audits of what was read."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from prismark.functions.hashing import ordered_hash, stable_hash
from prismark.functions.rewards import TRUTH
from prismark.operators.selection import hash_topk
from prismark.shipping import ship_package

CHART_STYLE = "struct<style:string,show_data_labels:boolean,width_px:int,height_px:int,dpi:int>"
OPD = "struct<dataset_version:string,round:int,rollout_count:int,original_answer_role:string>"
METADATA = (
    "struct<industry_zh:string,scenario:string,question_type:string,license:string,image_sha256:string,background:string,task_category:string,image_type:string,image_style:string,"
    f"source_image_path:string,dataset_revision:string,source_index:int,human_or_machine:int,year_flags:array<string>,answer_sequence:array<string>,chart_style:{CHART_STYLE},opd:{OPD}>"
)
_FIELDS = ["id", "dataset", "split", "entity_id", "chart_id", "image", "industry", "view_type", "task_type", "difficulty", "question", "answer", "ground_truth"]
RECORD = ", ".join(f"{f} string" for f in _FIELDS) + f", metadata {METADATA}"
PREDICTION = RECORD + ", prediction string, latency_seconds double, prompt_tokens int, completion_tokens int"
ROLLOUT = (
    "schema_version string, rollout_key string, record_id string, record_sha256 string, dataset string, split string, image string, prediction string, prompt_token_ids_sha256 string, "
    "completion_token_ids_sha256 string, round int, rollout_index int, prompt_token_ids array<int>, completion_token_ids array<int>"
)
TEACHER_SCORE = "rollout_key string, prompt_token_ids_sha256 string, completion_token_ids_sha256 string, completion_token_ids array<int>, topk_token_ids array<array<int>>, topk_logprobs array<array<float>>"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType = RECORD) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, a damaged line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def damaged_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not JSON objects, with their file."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).filter(F.trim("value") != "")
    return lines.filter(F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in one folder; the committer publishes all or nothing."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_report(report: dict, path: str) -> None:
    """A small document of results, on the driver."""
    Path(path).write_text(json.dumps(report, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated text with exactly these columns; a byte order mark and long fields are fine."""
    df = spark.read.option("sep", "\t").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", 16 << 20).csv(path)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    if sorted(df.columns) != sorted(columns):
        raise ValueError(f"columns are {df.columns}, not {columns}")
    return df.select(*columns)


def with_truth(df: DataFrame) -> DataFrame:
    """`df` with the ground truth text parsed into `gt` (null where it cannot be)."""
    return df.withColumn("gt", F.from_json("ground_truth", TRUTH, {"mode": "PERMISSIVE"}))


def namespace_of(source: dict, number: int) -> str:
    """The namespace of a source's sampling: its own, or its place and name."""
    own = source.get("namespace")
    if own is not None and not str(own).strip():
        raise ValueError("a sampling namespace needs a name")
    return f"source:{str(own).strip()}" if own is not None else f"source:{number}:{source['name']}"


def union_sources(sources: list[dict], split: str | None = None, shuffle: str | None = None) -> DataFrame:
    """Tagged union of sources: {name, df, key, max_rows or quotas (task column, table), rows, repeat, namespace}.

    split: the only split that rows may be in. rows: how many a source must have. shuffle: a namespace of a
    hash by which the result has a column `ord`. No source, or no row at all, is an error.
    """
    parts = []
    for i, s in enumerate(sources):
        if s.get("max_rows") is not None and s.get("quotas") is not None:
            raise ValueError(f"{s['name']}: give max_rows or quotas, not both")
        df = s["df"]
        if split is not None:
            stray = df.filter(~F.coalesce(F.col("split") == split, F.lit(False))).agg(F.count("*").alias("n"), F.min(s["key"]).alias("first")).first()
            if stray.n:
                raise ValueError(f"{s['name']}: {stray.n} rows are not in split {split}, such as {stray.first}")
        if s.get("max_rows") is not None:
            df = hash_topk(df, namespace_of(s, i), s["key"], s["max_rows"]).drop("h")
        elif s.get("quotas") is not None:
            from prismark.operators.selection import task_quota_sample

            df = task_quota_sample(df, s["task"], s["quotas"], namespace_of(s, i), s["key"]).drop("h", "rank")
        if s.get("rows") is not None and (n := df.count()) != s["rows"]:
            raise ValueError(f"{s['name']}: {n} rows, not {s['rows']}")
        parts.append(df.withColumns({"source_name": F.lit(s["name"]), "repeat": F.explode(F.sequence(F.lit(0), F.lit(s.get("repeat", 1) - 1)))}))
    if not parts:
        raise ValueError("there is no source")
    out = reduce(DataFrame.unionByName, parts)
    if split is not None and out.isEmpty():
        raise ValueError("the sources have no row")
    return out.withColumn("ord", stable_hash(shuffle, F.col("source_name"), F.col(sources[0]["key"]), F.col("repeat"))) if shuffle else out


def contract_hashes(df: DataFrame, key: str = "id") -> DataFrame:
    """One row: rows, and hashes over ids and over whole records in order of id. For panels and sources of a run."""
    whole = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.agg(F.count("*").alias("rows"), ordered_hash(F.col(key), F.col(key)).alias("ids_sha256"), ordered_hash(F.col(key), whole).alias("records_sha256"))


def assert_contract(df: DataFrame, *, key: str, rows: int | None = None, split: str | None = None) -> DataFrame:
    """`df`, if its number of rows, its one split and its unique keys are as stated: one aggregate."""
    wrong_split = F.count_if(F.coalesce(F.col("split") != split, F.lit(True))) if split else F.lit(0)
    found = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"), wrong_split.alias("strays")).first()
    if rows is not None and found.n != rows:
        raise ValueError(f"{found.n} rows, not {rows}")
    if found.keys != found.n:
        raise ValueError(f"{found.n - found.keys} rows repeat a key or have none")
    if found.strays:
        raise ValueError(f"{found.strays} rows are not in split {split}")
    return df


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, length of image files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def image_bytes(value: Column, kind: str) -> Column:
    """Bytes of an image given as bytes, a list of numbers, or Base64 text (`kind`: the column's type); null where it is none of these."""
    if kind == "binary":
        return value
    if kind.startswith("array"):
        return F.unhex(F.array_join(F.transform(value, lambda x: F.lpad(F.hex(x.cast("int")), 2, "0")), ""))
    return F.try_to_binary(value, F.lit("base64"))


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Write each distinct content of `images` (content) once, as `<first 20 hex digits of its SHA-256>.png`; sha256, path of each.

    A file that is there already is left; files appear under their name only when they are whole.
    """
    named = images.select("content").filter("content is not null").withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            digests, paths = batch.column("sha256").to_pylist(), []
            for digest, content in zip(digests, batch.column("content")):
                path = f"{root}/{digest[:20]}.png"
                if fs.get_file_info(path).type == pafs.FileType.NotFound:
                    unfinished = f"{path}.{uuid.uuid4().hex}.incomplete"
                    with fs.open_output_stream(unfinished) as out:
                        out.write(content.as_buffer())
                    fs.move(unfinished, path)
                paths.append(f"{folder}/{digest[:20]}.png")
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(paths, pa.string())], ["sha256", "path"])

    return ship(named).mapInArrow(write, "sha256 string, path string")


def ship(df: DataFrame) -> DataFrame:
    ship_package(df.sparkSession)
    return df


def image_identity(record_image: Column, sha256: Column) -> Column:
    """What tells an image: its content where that was read, else its path."""
    return F.coalesce(F.concat(F.lit("sha256:"), sha256), F.concat(F.lit("path:"), record_image))


def missing_images(records: DataFrame, files: DataFrame) -> DataFrame:
    """id, image of records whose image is not among `files` (path)."""
    return records.select("id", "image").join(files.select(F.col("path").alias("image")), "image", "left_anti")


def with_charts(records: DataFrame, charts: DataFrame) -> DataFrame:
    """`records` with metadata.chart_style of their chart (chart_id, chart_style)."""
    return records.join(charts.select("chart_id", "chart_style"), "chart_id", "left").withColumn("metadata", F.col("metadata").withField("chart_style", F.col("chart_style"))).select(*records.columns)


def orphans(files: DataFrame, referenced: DataFrame, key: str = "sha256") -> DataFrame:
    """Files that nothing refers to."""
    return files.join(referenced, key, "left_anti")
