"""Scoring of predictions as they arrive: an extension, with the batch expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from prismark.functions.text import exact_match, relaxed_accuracy


def with_scores(predictions: DataFrame) -> DataFrame:
    """Exact and relaxed scores; the same for batches and streams."""
    aliases = F.array("answer")
    return predictions.withColumns({"exact": exact_match(F.col("prediction"), aliases), "relaxed": relaxed_accuracy(F.col("prediction"), aliases)})


def score_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Score files that appear in `source` into `target`, and stop when all are read.

    Each micro-batch is a folder `batch=<id>` of `target`: run again after a failure, it
    replaces its own folder and reads nothing else. Ids repeated within a micro-batch are scored once.
    """

    def replace(batch: DataFrame, number: int) -> None:
        with_scores(batch.dropDuplicates(["id"])).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by window and kind, late ones up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
