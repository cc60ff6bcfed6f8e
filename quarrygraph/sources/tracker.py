"""Issues of a tracker: a REST service, a file that holds them, or given rows."""

from __future__ import annotations

import base64
import json
import os
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph import schemas


def rich_text(node) -> str:
    """All text nodes of a nested document, joined by spaces; a text stays as it is."""
    if node is None or isinstance(node, str):
        return node or ""
    found: list[str] = []

    def walk(part) -> None:
        if isinstance(part, dict):
            if part.get("type") == "text" and part.get("text"):
                found.append(part["text"])
            walk(part.get("content"))
        elif isinstance(part, list):
            for one in part:
                walk(one)

    walk(node)
    return " ".join(found)


def pick(issues: DataFrame, keys: list[str]) -> DataFrame:
    """The issues with these keys, in their order; unknown keys are left out."""
    return issues.where(F.col("key").isin(sorted(set(keys)))).orderBy("key")


def from_file(spark: SparkSession, path: str) -> DataFrame:
    """Issues of a JSON object by key. A missing or broken file raises."""
    kind = "map<string,struct<summary:string,status:string,description:string,issue_type:string>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("m"))
    return text.select(F.explode("m").alias("key", "v")).select("key", *[f"v.{c}" for c in ("summary", "status", "description", "issue_type")])


def from_rest(spark: SparkSession, api: str, keys: list[str], user_variable: str = "TRACKER_USER", token_variable: str = "TRACKER_TOKEN", opener=urllib.request.urlopen) -> DataFrame:
    """Issues of a service; a key that it doesn't know is left out, any other error raises."""
    sign = base64.b64encode(f"{os.environ[user_variable]}:{os.environ[token_variable]}".encode()).decode()
    rows = []
    for key in sorted(set(keys)):
        request = urllib.request.Request(f"{api}/rest/api/3/issue/{key}", headers={"Authorization": f"Basic {sign}", "Accept": "application/json"})
        try:
            with opener(request) as answer:
                fields = json.loads(answer.read())["fields"]
        except urllib.error.HTTPError as error:
            if error.code == 404:
                continue
            raise
        rows.append((key, fields.get("summary"), (fields.get("status") or {}).get("name"), rich_text(fields.get("description")), (fields.get("issuetype") or {}).get("name")))
    return spark.createDataFrame(rows, schemas.JIRA)


def configured(spark: SparkSession, config: dict, folder: str, keys: list[str]) -> DataFrame | None:
    """Issues as a configuration says: None if off; source `rest` (default) or `file`, its path below folder."""
    if not config.get("enabled"):
        return None
    source = config.get("source", "rest")
    if source == "rest":
        return from_rest(spark, config["api"], keys)
    if source == "file":
        return pick(from_file(spark, os.path.join(folder, config["path"])), keys)
    raise ValueError(f"unknown tracker source {source!r}")


def everything(spark: SparkSession, config: dict, folder: str) -> DataFrame | None:
    """All issues of a tracker file, by key; None without one, or where it can't be read: a full compile goes on without issues."""
    if not config.get("enabled") or config.get("source", "rest") != "file":
        return None
    try:
        rows = from_file(spark, os.path.join(folder, config["path"])).orderBy("key")
        rows.count()
        return rows
    except Exception:
        return None


def facts(issues: DataFrame, linked: DataFrame, repo_id: str) -> DataFrame:
    """(repo_id, fact_type, payload, ...) of issues joined to linked(key, linked_pr)."""
    joined = issues.join(linked, "key", "left")
    payload = F.to_json(F.struct("description", "issue_type", "key", "linked_pr", "status", "summary"), {"ignoreNullFields": "false"})
    return joined.select(F.lit(repo_id).alias("repo_id"), F.lit("jira_observed").alias("fact_type"), payload.alias("payload"), F.array().cast("array<string>").alias("artifact_refs"), F.lit("tracker").alias("extractor"), F.sha2(payload, 256).alias("content_hash"), F.array().cast(f"array<{schemas.ANCHOR}>").alias("anchors"))
