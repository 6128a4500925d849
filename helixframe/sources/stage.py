"""Tables written once and read again, where a plan would work a step out several times."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only in local mode without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = os.path.join(tempfile.gettempdir(), "helixframe-stages")
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read from there."""
    path, schema = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A small table's rows dealt to all cores, for work that takes far longer than moving a row.

    A file of one row group is one task, whatever Spark's splits are.  Small is what doesn't fill
    a split of ``spark.sql.files.maxPartitionBytes`` on each core, so what moves is bounded by
    the cluster; larger tables stay as they are and aren't shuffled.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split else df
