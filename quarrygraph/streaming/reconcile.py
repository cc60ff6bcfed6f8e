"""Reconciliation of merged changes: ordered, exactly once, from a ledger's watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def watermark(ledger: DataFrame) -> DataFrame:
    """(repo_id, watermark): the newest change time of succeeded runs."""
    at = F.coalesce("commit_timestamp", "merged_at")
    return ledger.where(F.col("status") == "succeeded").withColumn("_at", at).where("_at IS NOT NULL").groupBy("repo_id").agg(F.max("_at").alias("watermark"))


def merge_streams(prs: DataFrame, commits: DataFrame, since: Column | None = None) -> DataFrame:
    """One stream of units(repo_id, kind, key, ts, sha) strictly after since; commits that a pull request merged are dropped."""
    late = lambda df: df if since is None else df.where(F.col("ts") > since)
    merged = late(prs)
    direct = late(commits).join(merged.select("repo_id", "sha").where("sha IS NOT NULL").distinct(), ["repo_id", "sha"], "left_anti")
    return merged.unionByName(direct.select(*merged.columns))


def in_order(units: DataFrame) -> DataFrame:
    """Merge order: time, pull requests before commits, key."""
    return units.orderBy("repo_id", "ts", F.when(F.col("kind") == "pr", 0).otherwise(1), "key")


def not_done(units: DataFrame, ledger: DataFrame) -> DataFrame:
    """Units without a succeeded run of the same kind and key, nor any succeeded run of their commit."""
    done = ledger.where(F.col("status") == "succeeded")
    by_key = units.join(done.select("repo_id", F.col("scope").alias("kind"), "key").where("key IS NOT NULL").distinct(), ["repo_id", "kind", "key"], "left_anti")
    return by_key.join(done.select("repo_id", "sha").where("sha IS NOT NULL").distinct(), ["repo_id", "sha"], "left_anti").select(*units.columns)


def reconcile(units: DataFrame, read_ledger: Callable[[], DataFrame], compile_one: Callable[[dict], None], expect_key: str | None = None) -> list[str]:
    """Runs compile_one on each unit in order; every unit commits by itself, and a failure stops the sequence with what went before kept.

    The backlog since the watermark is a list of changes to run one after the other, so it comes to the driver as an iterator; state
    is read anew for every unit by compile_one, never chained.
    """
    seen = []
    for row in in_order(units).toLocalIterator():
        unit = row.asDict(True)
        one = units.sparkSession.createDataFrame([row], units.schema)
        if not not_done(one, read_ledger()).isEmpty():
            compile_one(unit)
        seen.append(unit["key"])
    if expect_key is not None and expect_key not in seen:
        done = read_ledger().where((F.col("status") == "succeeded") & (F.col("key") == expect_key))
        if done.isEmpty():
            raise LookupError(f"{expect_key} is not among the merged changes")
    return seen


def stream_units(stream: DataFrame, read_ledger: Callable[[], DataFrame], compile_one: Callable[[dict], None], checkpoint: str):
    """The same on a stream: every micro-batch is reconciled in order; checkpoint and ledger together give exactly-once."""
    return stream.writeStream.foreachBatch(lambda batch, _: reconcile(batch, read_ledger, compile_one) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
