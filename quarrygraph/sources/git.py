"""Files of a git repository as artifacts: the working tree, or given paths at a commit. Listing is on the driver, reading in tasks."""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quarrygraph import schemas

#: A file with a NUL byte among this many first ones is binary.
SNIFF = 8192
_COLUMNS = ["repo_id", "artifact_type", "source_ref", "content_hash", "content"]


def _git(folder: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", folder, *args], capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def head_commit(folder: str) -> str:
    return _git(folder, "rev-parse", "HEAD").decode().strip()


def artifact(repo_id: str, ref: str, raw: bytes) -> tuple | None:
    """A row of the artifacts table; None for a binary file. The hash is of the raw bytes."""
    if b"\0" in raw[:SNIFF]:
        return None
    return repo_id, "source_file", ref, hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "replace")


def _read(repo_id: str, one) -> callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [artifact(repo_id, ref, raw) for ref in batch.iloc[:, 0] if (raw := one(ref)) is not None]
            yield pd.DataFrame([r for r in rows if r], columns=_COLUMNS)

    return run


def _paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "source_ref string").repartition(max(1, min(len(paths) // 64 + 1, spark.sparkContext.defaultParallelism)))


def working_tree(spark: SparkSession, folder: str, repo_id: str) -> DataFrame:
    """Tracked files that exist, but for binaries. The folder must be one that tasks can read."""
    listed = sorted(p for p in _git(folder, "ls-files", "-z").decode("utf-8", "surrogateescape").split("\0") if p)

    def one(ref: str) -> bytes | None:
        path = os.path.join(folder, ref)
        if not os.path.isfile(path):
            return None
        with open(path, "rb") as f:
            return f.read()

    return _paths(spark, listed).mapInPandas(_read(repo_id, one), schemas.ARTIFACTS)


def at_commit(spark: SparkSession, folder: str, repo_id: str, sha: str, paths: list[str]) -> DataFrame:
    """The given paths as they were at a commit; a path that wasn't there has no row, which is evidence of its removal."""

    def one(ref: str) -> bytes | None:
        done = subprocess.run(["git", "-C", folder, "cat-file", "-p", f"{sha}:{ref}"], capture_output=True)
        return done.stdout if done.returncode == 0 else None

    return _paths(spark, sorted(set(paths))).mapInPandas(_read(repo_id, one), schemas.ARTIFACTS)


def from_files(spark: SparkSession, pattern: str, root: str, repo_id: str) -> DataFrame:
    """Files that only Spark's readers can open, as artifacts named by their path below root."""
    from pyspark.sql import functions as F

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
    plain = raw.where(~F.contains(F.substring("content", 1, SNIFF), F.unhex(F.lit("00"))))
    ref = F.regexp_replace("path", f"^[a-z]+:/*{root.lstrip('/')}/?", "")
    return plain.select(F.lit(repo_id).alias("repo_id"), F.lit("source_file").alias("artifact_type"), ref.alias("source_ref"), F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("content"))
