"""Results that several later steps read: written once, so that the facts are scanned once."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def stage_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in `spark.checkpoint.dir`.

    With a `local` master the driver and its tasks are one process, so a temporary folder is made
    when none is named. Anywhere else that would be a different disk on each machine: an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="kpivane-"))
    return context.getCheckpointDir()


def settled(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and gives later joins a known
    size to choose their strategy by.
    """
    spark = frame.sparkSession
    path = f"{stage_root(spark).rstrip('/')}/stage-{uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
