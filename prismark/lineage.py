"""Cutting a plan short: a table is written to the checkpoint folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` as it lies in `spark.checkpoint.dir`; only a local session may go without that setting, and gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.startswith("local") and not context.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="prismark-")
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint()
