"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``, deleted when the session's JVM ends.

    Only where that is unset (a laptop) a temporary folder takes its place.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="permitloom-")
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/permitloom-{name}-{uuid.uuid4().hex}"
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str, reader: SparkSession | None = None) -> DataFrame:
    """``df`` as a table there: computed once, the same however often and wherever it is read (by ``reader``, or its own session)."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = (reader or df.sparkSession).read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later step reads."""
    for t in tables:
        context = t.sparkSession.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)
