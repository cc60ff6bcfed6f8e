"""Intermediate tables in the folder that driver and executors share: lineage ends there, and a lost executor costs nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where that is unset and Spark runs in one process (tests)."""
    ctx = spark.sparkContext
    known = ctx.getConf().get("spark.checkpoint.dir", None) or ctx.getCheckpointDir()
    if known is None:
        if not ctx.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="quarrygraph-")
        ctx.setCheckpointDir(known)
    return known.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
