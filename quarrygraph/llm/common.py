"""Shared helpers: table access, durable intermediate tables, the word pattern."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"

BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where that is unset and Spark runs in one process (tests)."""
    ctx = spark.sparkContext
    known = ctx.getConf().get("spark.checkpoint.dir", None) or ctx.getCheckpointDir()
    if known is None:
        if not ctx.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="quarrygraph-")
        ctx.setCheckpointDir(known)
    return known.rstrip("/")


def release() -> None:
    """Give memory that a Python task no longer needs back to the system; the worker lives on for other stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run, rows: int = BATCH_ROWS):
    """A function over batches that gets at most so many rows at once, as slices without a copy, and releases memory when its task ends.

    What reaches Python together is bounded in bytes by Spark itself (spark.sql.execution.arrow.maxBytesPerBatch); no setting of the session changes.
    """

    def tidied(batches):
        try:
            yield from run(batch.slice(at, rows) for batch in batches for at in range(0, len(batch), rows))
        finally:
            release()

    return tidied


def durable(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text):
    """Array of the words of a text column; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
