"""Cutting lineage in storage that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a new temporary folder in local mode, and an error on a cluster, whose executors could not read one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: a lost executor costs no recomputation of what led to it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # Spark's setting for the shuffle files of a query that has ended


def stored(df: DataFrame, file_rows: int = 0, lean: bool = False) -> DataFrame:
    """``df`` written as Parquet in the checkpoint folder and read again; for wide rows, which that keeps small.

    No file gets over ``file_rows`` rows, if any are given. With ``lean`` the shuffle files that led to it are removed when it is written.
    """
    path, conf = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet", df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true" if lean else before)
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
