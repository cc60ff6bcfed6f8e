"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Sizes are summed by source and hash bucket. A source's target is met by whole repeats of all its rows and a part
of them once more; that part is every row whose hash lies below a threshold. The threshold comes from nested
histograms: the first level finds the bucket in which the running sum passes the budget, every further level splits only
that bucket, until 60 hash bits are fixed. Rows are then filtered by comparing hashes; nothing is sorted. The
hash is the first 60 bits of md5 of doc_id and text, so reruns take the same rows.

Defined cases: null text has size 0; a null source is a source of its own, after all others; repeated rows have one
hash and are taken alike; a source whose rows are all empty has target 0; an empty table gives an empty result;
columns other than doc_id, text and source pass through `mixed`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, read, words

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_REPEATS = 2
#: Hash bits that each level of histograms fixes.
LEVELS = (12, 16, 16, 16)
BITS = sum(LEVELS)


def row_hash() -> Column:
    """The first 60 bits of md5(doc_id, text)."""
    said = F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...], share_percent: int, max_repeats: int) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by code point, null last; no target is above max_repeats * size.

    Resharing the excess by weight until none is above is filling to one level: in the order of cap / weight, a source is
    capped while the level that its successors would get lies above its own cap. totals has one row for each source.
    """
    ranked = totals.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * max_repeats)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_rank")).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * share_percent / 100 - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    tried = capped.withColumn("_level", level)
    level_met = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(every)
    return tried.withColumn("_final", level_met).select("source", "source_size", F.round(F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap").cast("double"))), 6).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets(_key, budget) + edge: the largest 60-bit prefix bound with sum(size of hashes < edge) <= budget, level by level."""
    state = budgets.select("_key", F.col("budget").cast("double").alias("_left"), F.lit(0).cast("long").alias("edge"))
    done = 0
    for bits in LEVELS:
        rest = BITS - done - bits
        low = F.shiftright("_hash", rest)
        inside = sized.join(state, "_key").where(F.shiftright("_hash", BITS - done) == F.shiftright("edge", BITS - done)) if done else sized.join(state, "_key")
        filled = inside.groupBy("_key", low.alias("_bucket")).agg(F.sum("size").alias("_sum"))
        running = filled.withColumn("_upto", F.sum("_sum").over(Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)))
        over = running.join(state, "_key").where(F.col("_upto") > F.col("_left")).groupBy("_key").agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_sum")).alias("_below"))).alias("_at"))
        kept = state.join(over, "_key", "left")
        top = F.shiftleft(F.shiftright("edge", BITS - done) + 1, BITS - done) if done else F.lit(2**BITS)
        state = durable(kept.select("_key", F.when(F.col("_at").isNull(), F.lit(float("inf"))).otherwise(F.col("_left") - F.col("_at._below")).alias("_left"), F.when(F.col("_at").isNull(), top.cast("long")).otherwise(F.shiftleft(F.col("_at._bucket"), rest)).alias("edge")))
        done += bits
    return state.select("_key", "edge")


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def _copies() -> Column:
    return F.col("_whole") + F.when(F.col("_hash") < F.col("edge"), 1).otherwise(0)


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """Every row's size and hash, and each source's size, target, whole repeats and hash bound."""
    sized = durable(docs.select("doc_id", F.col("source").cast("string").alias("source"), _key().alias("_key"), F.size(words(F.col("text").cast("string"))).cast("long").alias("size"), row_hash().alias("_hash")))
    totals = sized.groupBy("source", "_key").agg(F.sum("size").alias("source_size"))
    planned = source_targets(totals, weights, share_percent, max_repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    keyed = durable(planned.withColumn("_whole", whole).withColumn("_key", _key()))
    edges = thresholds(sized.where(F.col("size") > 0).select("_key", "size", "_hash"), keyed.select("_key", (F.col("target") - F.col("_whole") * F.col("source_size")).alias("budget")))
    return sized, durable(keyed.join(edges, "_key").select("_key", "source_size", "target", "_whole", "edge"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row; copies is how often the mix takes the row."""
    sized, bounds = plan(docs, weights, share_percent, max_repeats)
    return sized.join(bounds, "_key").select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"), (_copies() * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    _, bounds = plan(docs, weights, share_percent, max_repeats)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key().alias("_key"), row_hash().alias("_hash"))
    taken = rows.join(bounds.select("_key", "_whole", "edge"), "_key").select("row", _copies().alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(chr(10), coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM totals),
weighed AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM ranked),
tried AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 150 / 100 - coalesce(sum(cap) OVER b, 0)::DOUBLE)
    / ((sum(w) OVER ())::DOUBLE - coalesce(sum(w) OVER b, 0)::DOUBLE) AS lvl
  FROM weighed WINDOW b AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
planned AS (SELECT source, source_size,
    round(least(cap::DOUBLE, coalesce((max(CASE WHEN lvl * w <= cap THEN lvl END) OVER ()) * w, cap::DOUBLE)), 6) AS target FROM tried),
split AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INTEGER ELSE 0 END AS whole FROM planned),
running AS (SELECT s.*, p.source_size, p.target, p.whole,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN split p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN size > 0 AND upto <= target - whole * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM running
"""
