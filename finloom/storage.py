"""Tables in shared storage that cut lineage: a lost executor costs a task, and a plan that uses a result several times
reads it instead of computing it again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode without one, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="finloom-"))
        at = context._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as a table in the shared folder and read back."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
