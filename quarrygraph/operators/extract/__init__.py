"""Fact extraction: one artifact in, many facts out, as a map over partitions; facts carry no identity."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions import scalars as S

from . import javascript, python

ANCHOR = "struct<file_path:string,symbol_path:string,span:struct<lo:int,hi:int>>"
FACTS = f"repo_id string, fact_type string, payload string, artifact_refs array<string>, extractor string, content_hash string, anchors array<{ANCHOR}>"
_COLUMNS = ["repo_id", "fact_type", "payload", "artifact_refs", "extractor", "content_hash", "anchors"]


def canonical(payload: dict) -> str:
    """JSON with sorted keys and no spaces: equal payloads have equal text."""
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fact(repo_id: str, fact_type: str, payload: dict, refs: list[str], extractor: str, anchors: list[dict]) -> tuple:
    text = canonical(payload)
    return repo_id, fact_type, text, refs, extractor, hashlib.sha256(text.encode()).hexdigest(), anchors


def _analyse(batches: Iterator[pd.DataFrame], configs: list[tuple]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for repo_id, ref, module, test, content in zip(*(batch.iloc[:, k] for k in range(5))):  # by place: the optimizer may rename columns
            if content is None:
                continue
            if ref.endswith(".py"):
                found, name = python.analyse(ref, module, test, content), "python-analyzer"
            elif ref.endswith(javascript.TS_EXTENSIONS):
                found, name = javascript.analyse(ref, module, test, content, configs.get(repo_id, [])), "typescript-analyzer"
            elif ref.endswith(javascript.JS_EXTENSIONS):
                found, name = javascript.analyse(ref, module, test, content, None), "javascript-analyzer"
            else:
                continue
            rows += [fact(repo_id, kind, payload, [ref], name, anchors) for kind, payload, anchors in found]
        yield pd.DataFrame(rows, columns=_COLUMNS)


def extract_facts(artifacts: DataFrame) -> DataFrame:
    """Facts of artifacts(repo_id, source_ref, content). The path aliases of a repository's tsconfig files go along with the code: a few rows a repository."""
    configs: dict[str, list] = {}
    for row in artifacts.where(F.regexp_like("source_ref", F.lit(r"(^|/)tsconfig\.json$"))).select("repo_id", "source_ref", "content").toLocalIterator():
        if parsed := javascript.aliases(row["source_ref"], row["content"]):
            configs.setdefault(row["repo_id"], []).append(parsed)
    code = artifacts.where(F.regexp_like("source_ref", F.lit(r"\.(py|tsx?|jsx?|mjs|cjs)$"))).select("repo_id", "source_ref", S.module_name(F.col("source_ref")).alias("module"), S.holds_tests(F.col("source_ref")).alias("test"), "content")
    return code.mapInPandas(lambda batches: _analyse(batches, configs), FACTS)
