"""Cutting lineage by tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a session on one machine may leave it unset and gets a local folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named is None and not (context.master or "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or "/tmp/checkpoints/veilwork"


def place(spark: SparkSession) -> str:
    """Where a new table can be cut to."""
    return f"{folder(spark).rstrip('/')}/veilwork-{uuid.uuid4().hex}"


def cut(frame: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows from a written table, which goes when the application ends. With ``path`` (see ``place``) those that were
    cut to it before come too."""
    spark = frame.sparkSession
    path = path or place(spark)
    frame.write.mode("append").parquet(path)
    context = spark.sparkContext
    written = context._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(written)
    return spark.read.schema(frame.schema).parquet(path)
