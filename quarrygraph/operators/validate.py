"""Scoring of what a test file says it covers against what the plan recommends."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The line that opens the claims in a module's docstring (fixed format).
HEADER = "kc-covers:"


def parse_claims(source: str) -> list[str] | None:
    """Claimed slugs below the header; None without a header or where the file doesn't parse, [] where nothing is claimed."""
    try:
        doc = ast.get_docstring(ast.parse(source))
    except (SyntaxError, ValueError):
        return None
    lines = doc.splitlines() if doc else []
    at = next((i for i, line in enumerate(lines) if line.strip() == HEADER), None)
    if at is None:
        return None
    found = []
    for line in lines[at + 1 :]:
        m = re.match(r"\s*-\s+(\S+)\s*$", line)
        if not m:
            break
        found.append(m[1])
    return found


def claims(files: DataFrame) -> DataFrame:
    """files(test_file, source) + claims: array<string>, null without a header."""
    return files.withColumn("claims", F.udf(lambda text: parse_claims(text), "array<string>", useArrow=True)("source"))


def citable(plan: DataFrame) -> DataFrame:
    """(repo_id, slug, target): what may be cited for each recommendation: its apis, else its component."""
    cited = F.when(F.col("target_kind") == "api", F.col("target")).otherwise(F.col("component"))
    return plan.select("repo_id", "slug", cited.alias("target")).where("target IS NOT NULL").distinct()


def score(claimed: DataFrame, plan: DataFrame, entities: DataFrame) -> DataFrame:
    """claimed(repo_id, slug, test_file, claims) with nonexistent, extraneous and missing slugs, precision, recall and score in percent.

    No header scores 0. With a header, no claims have precision 0, and nothing to cite has recall 1.
    """
    targets = citable(plan).groupBy("repo_id", "slug").agg(F.array_sort(F.collect_set("target")).alias("citable"))
    listed = claimed.select("repo_id", "slug", "test_file", F.explode("claims").alias("claim"))
    lost = listed.join(entities.select("repo_id", F.col("slug").alias("claim")), ["repo_id", "claim"], "left_anti").groupBy("repo_id", "slug", "test_file").agg(F.array_sort(F.collect_list("claim")).alias("nonexistent"))
    none = F.array().cast("array<string>")
    joined = claimed.join(targets, ["repo_id", "slug"], "left").join(lost, ["repo_id", "slug", "test_file"], "left").withColumn("citable", F.coalesce("citable", none)).withColumn("nonexistent", F.coalesce("nonexistent", none))
    named = F.array_distinct(F.coalesce("claims", none))
    met = F.size(F.array_intersect(named, F.col("citable")))
    precision = F.when(F.size(named) > 0, met / F.size(named)).otherwise(F.lit(0.0))
    recall = F.when(F.size("citable") > 0, met / F.size("citable")).otherwise(F.lit(1.0))
    real = F.when(F.size("claims") > 0, 1 - F.size("nonexistent") / F.size("claims")).otherwise(F.lit(1.0))
    return joined.select(
        "repo_id", "slug", "test_file", F.col("claims").isNotNull().alias("header_found"), "citable", "nonexistent", F.array_sort(F.array_except(F.array_except(named, F.col("citable")), F.col("nonexistent"))).alias("extraneous"), F.array_sort(F.array_except(F.col("citable"), named)).alias("missing"),
        F.when(F.col("claims").isNull(), F.lit(0.0)).otherwise(precision).alias("precision"), F.when(F.col("claims").isNull(), F.lit(0.0)).otherwise(recall).alias("recall"), F.when(F.col("claims").isNull(), F.lit(0.0)).otherwise(F.bround((precision + recall) / 2 * 100 * real, 1)).alias("score_pct"),
    )
