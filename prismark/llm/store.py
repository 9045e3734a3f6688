"""Shared-folder files: scratch paths for the driver, byte-level access for executors.

Executors may be lost and tasks retried, so every file is written under a
unique temporary name and renamed onto its final, deterministic name.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from prismark.shipping import ship_package

#: Folders made for local sessions that have none configured, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder all executors share, as `spark.checkpoint.dir` names it.

    A name without a scheme is one of Hadoop's default file system. Only a
    local session may go without: it gets a temporary folder of its own.
    """
    ship_package(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="prismark-")
    return _LOCAL[context.applicationId]


#: Rows, and bytes, of an Arrow batch of whole texts, and rows that a scan decodes at a time; Spark's defaults suit narrow rows.
TEXT_ROWS, TEXT_BYTES, SCAN_ROWS = 2000, "16m", 512


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with batches small enough for whole texts unless the user chose a size."""
    arrow = "spark.sql.execution.arrow"
    settings = [(f"{arrow}.maxRecordsPerBatch", "10000", str(TEXT_ROWS)), (f"{arrow}.maxBytesPerBatch", "67108864b", TEXT_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", "4096", str(SCAN_ROWS))]
    for key, default, value in settings:
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)
    return ship_package(spark)


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder name under the shared folder."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query run within go when it ends, else only once the driver happens to collect its garbage.

    Not for a DataFrame that is collected twice, nor for results that are fetched step by step: their files would be made anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, path: str) -> DataFrame:
    """`df` as a table written to `path` and read again: lineage ends in shared files, and its shuffles' files go."""
    with brief_shuffles(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders that no later result reads."""
    for path in paths:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


class Steps:
    """Scratch tables of one computation; those not named as kept go when it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, tag: str, kept: bool = False) -> DataFrame:
        """`df` written under the shared folder and read again; `kept`: a result still reads it afterwards."""
        path = scratch(self.spark, tag)
        if not kept:
            self.paths.append(path)
        return written(df, path)

    def __enter__(self) -> "Steps":
        return self

    def __exit__(self, *_) -> None:
        discard(self.spark, *self.paths)


#: A key of at least one row in so many is heavy; there are at most so many such keys.
HEAVY = 1000


def keyed_join(left: DataFrame, right: DataFrame, on: list[str], count: str, rows: int, how: str = "inner") -> DataFrame:
    """`left` joined with `right`, which has one row for each key, and in `count` how many rows of `left` (of `rows`) have it.

    The HEAVY keys at most with a share of 1 / HEAVY of the rows are broadcast, so no
    task gets a hot key's rows; the others meet by shuffle. Rows with a null key match nothing.
    """
    is_heavy = F.col(count) * HEAVY >= F.lit(rows)
    heavy, light = F.broadcast(right.filter(is_heavy).drop(count)), right.filter(~is_heavy).drop(count)
    null = F.lit(False)
    for c in on:
        null = null | F.col(c).isNull()
    known = left.filter(~null)
    met = known.join(heavy, on)
    rest = known.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on, how)
    out = met.unionByName(rest)
    if how == "left":
        fill = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.drop(count, *on).schema]
        out = out.unionByName(left.filter(null).select("*", *fill))
    return out


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class AtomicFile:
    """Writer of one shared file; it appears under its name only once complete.

    A retried or speculative task writes the same bytes under another
    temporary name, so whichever attempt ends last leaves the same file.
    """

    def __init__(self, uri: str):
        self.fs, self.path = _filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.incomplete"
        self.stream = self.fs.open_output_stream(self.temporary)
        self.position = 0

    def write(self, data: bytes) -> int:
        """Append `data`; returns the offset it starts at."""
        at = self.position
        self.stream.write(data)
        self.position += len(data)
        return at

    def __enter__(self) -> "AtomicFile":
        return self

    def __exit__(self, kind, value, trace) -> None:
        self.stream.close()
        if kind is None:
            self.fs.move(self.temporary, self.path)
        else:
            self.fs.delete_file(self.temporary)


class RangeReader:
    """Random access to one shared file."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> "RangeReader":
        return self

    def __exit__(self, *_) -> None:
        self.close()
