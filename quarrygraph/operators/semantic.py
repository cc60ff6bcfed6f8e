"""Semantic extraction by a language model: cached, checked, grounded in what the syntax shows, and within a budget.

A provider is any object with complete(prompt, schema_name) -> text. Keys of the cache don't hold the path, so equal files share
an answer; the first answer that was stored stays.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph import schemas
from quarrygraph.functions import scalars as S

from .extract import FACTS, fact
from .extract.python import external_keys

TEMPLATE_ID, TEMPLATE_VERSION = "file-knowledge", "1"
LINK_ID, LINK_VERSION = "story-features", "1"
#: Fields of each kind in an answer, besides name, symbol_paths and related_components; any other field rejects the answer.
KINDS = {"business_rules": ("business_rule_candidate", ("statement", "intent")), "features": ("feature_candidate", ("narrative",)), "risks": ("risk_candidate", ("description", "category"))}
_COMMON = ("name", "symbol_paths", "related_components")
NARRATIVE_CHARS, DESCRIPTION_CHARS = 120, 800


class Provider(Protocol):
    def complete(self, prompt: str, schema_name: str) -> str: ...


class BudgetError(RuntimeError):
    """More calls are needed than the budget allows; answered has those that were made, so that the next run needs fewer."""

    def __init__(self, message: str, answered: DataFrame | None = None):
        super().__init__(message)
        self.answered = answered


class Scripted:
    """A provider for tests: the answer of the first phrase that the prompt contains."""

    def __init__(self, answers: dict[str, str]):
        self.answers, self.calls = answers, 0

    def complete(self, prompt: str, schema_name: str) -> str:
        self.calls += 1
        return next((a for phrase, a in self.answers.items() if phrase in prompt), json.dumps({k: [] for k in KINDS} if schema_name == TEMPLATE_ID else {"motivates": []}))


def file_prompt(path: str, module: str, symbols: list[str], source: str) -> str:
    listed = "\n".join(f"* {s}" for s in symbols) or "* none"
    wanted = "; ".join(f"{k}: {', '.join((*_COMMON, *fields))}" for k, (_, fields) in KINDS.items())
    return f"List the domain rules, user-facing features and risks that this file shows, as one JSON object of three lists. Fields of their items: {wanted}. Use only these symbols:\n{listed}\nfile {path}, module {module}\n\n{source}"


def story_prompt(key: str, summary: str, description: str, features: dict[str, str]) -> str:
    listed = "\n".join(f"* {n}: {t[:NARRATIVE_CHARS]}" for n, t in sorted(features.items())) or "* none"
    return f"Which of these features does the story ask for? Answer with a JSON object whose list `motivates` holds their exact names.\n{listed}\nstory {key}: {summary}\n{(description or 'none')[:DESCRIPTION_CHARS]}"


def parse_answer(text: str) -> dict[str, list[dict]]:
    """The answer's three lists; raises ValueError unless exactly the known fields are there with their kinds of values."""
    answer = json.loads(text)
    if not isinstance(answer, dict) or set(answer) != set(KINDS):
        raise ValueError("the answer has other lists")
    for kind, (_, fields) in KINDS.items():
        for item in answer[kind]:
            if not isinstance(item, dict) or set(item) != {*_COMMON, *fields}:
                raise ValueError(f"an item of {kind} has other fields")
            lists, texts = ("symbol_paths", "related_components"), ("name", *fields)
            if not all(isinstance(item[f], str) for f in texts) or not all(isinstance(item[f], list) and all(isinstance(x, str) for x in item[f]) for f in lists):
                raise ValueError(f"an item of {kind} has values of other kinds")
    return answer


def parse_links(text: str, known: set[str]) -> list[str]:
    answer = json.loads(text)
    if not isinstance(answer, dict) or set(answer) != {"motivates"} or not all(isinstance(x, str) for x in answer["motivates"]):
        raise ValueError("the answer is not a list of names")
    return sorted(known & set(answer["motivates"]))


def candidate_facts(repo_id: str, ref: str, source: str, symbols: dict[str, tuple[int, int]], answer: dict) -> list[tuple]:
    """Facts of an answer: anchored at symbols that the syntax has, or at the file; with the key that the source declares for the first of them."""
    keys, out = external_keys(source), []
    for kind, (fact_type, fields) in KINDS.items():
        for item in answer[kind]:
            seen = sorted(s for s in set(item["symbol_paths"]) if s in symbols)
            anchors = [{"file_path": ref, "symbol_path": s, "span": {"lo": symbols[s][0], "hi": symbols[s][1]}} for s in seen] or [{"file_path": ref, "symbol_path": None, "span": None}]
            payload = {"name": item["name"], "related_components": item["related_components"], **{f: item[f] for f in fields}}
            key = next((keys[s.rsplit(".", 1)[-1]] for s in sorted(item["symbol_paths"]) if s.rsplit(".", 1)[-1] in keys), None)
            if key:
                payload["external_key"] = key
            out.append(fact(repo_id, fact_type, payload, [ref], "semantic", anchors))
    return out


def eligible(artifacts: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo_id, source_ref, content, module, symbols): files with a module that have no test case; symbols are (symbol_path, lo, hi)."""
    seen = facts.where("fact_type = 'component_observed'").select("repo_id", F.get_json_object("payload", "$.file").alias("source_ref"), F.get_json_object("payload", "$.path").alias("module"))
    tests = facts.where("fact_type = 'test_case_observed'").select("repo_id", F.get_json_object("payload", "$.file").alias("source_ref")).distinct()
    shown = facts.where("fact_type = 'symbol_observed'").select("repo_id", F.get_json_object("payload", "$.file").alias("source_ref"), F.explode("anchors").alias("a")).groupBy("repo_id", "source_ref").agg(F.array_sort(F.collect_set(F.struct("a.symbol_path", "a.span.lo", "a.span.hi"))).alias("symbols"))
    files = artifacts.where("content IS NOT NULL").select("repo_id", "source_ref", "content").join(seen, ["repo_id", "source_ref"]).join(tests, ["repo_id", "source_ref"], "left_anti")
    return files.join(shown, ["repo_id", "source_ref"], "left")


def keyed(files: DataFrame, model_id: str) -> DataFrame:
    return files.withColumn("cache_key", S.cache_key(F.lit(TEMPLATE_ID), F.lit(TEMPLATE_VERSION), F.lit(model_id), F.sha2(F.col("content").cast("binary"), 256)))


_ANSWERED = f"{schemas.LLM_CACHE}, warning string"


def _ask(provider: Provider, model_id: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.set_axis(["cache_key", "source_ref", "module", "symbols", "content"], axis=1).itertuples():
                symbols = [s["symbol_path"] for s in r.symbols] if r.symbols is not None else []
                output, warning = None, None
                for _ in range(2):  # one more try for an answer that doesn't fit
                    try:
                        output = provider.complete(file_prompt(r.source_ref, r.module, symbols, r.content), TEMPLATE_ID)
                        parse_answer(output)
                        warning = None
                        break
                    except Exception as error:  # an answer or a call that fails skips the file and says so
                        output, warning = None, f"{r.source_ref}: {error}"
                rows.append((r.cache_key, TEMPLATE_ID, TEMPLATE_VERSION, model_id, output, warning))
            yield pd.DataFrame(rows, columns=["cache_key", "template_id", "template_version", "model_id", "output", "warning"])

    return run


def extract_semantic(artifacts: DataFrame, facts: DataFrame, cache: DataFrame, provider: Provider, model_id: str, budget: int | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidate facts, new cache rows, warnings). `keep` makes the answers durable, so that the provider is asked once."""
    files = keyed(eligible(artifacts, facts), model_id)
    misses = files.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    needed = 0 if budget is None else misses.count()
    over = budget is not None and needed > budget
    misses = misses.orderBy("cache_key").limit(budget) if over else misses
    answered = keep(misses.select("cache_key", "source_ref", "module", "symbols", "content").mapInPandas(_ask(provider, model_id), _ANSWERED))
    fresh = answered.where("output IS NOT NULL").select(*[c.split()[0] for c in schemas.LLM_CACHE.split(", ")])
    if over:
        raise BudgetError(f"{needed} calls are needed, {budget} are allowed", fresh)
    known = cache.unionByName(fresh).dropDuplicates(["cache_key"])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.set_axis(["repo_id", "source_ref", "content", "symbols", "output"], axis=1).itertuples():
                symbols = {s["symbol_path"]: (s["lo"], s["hi"]) for s in r.symbols} if r.symbols is not None else {}
                rows += candidate_facts(r.repo_id, r.source_ref, r.content, symbols, parse_answer(r.output))
            yield pd.DataFrame(rows, columns=["repo_id", "fact_type", "payload", "artifact_refs", "extractor", "content_hash", "anchors"])

    made = files.join(known.select("cache_key", "output"), "cache_key").select("repo_id", "source_ref", "content", "symbols", "output").mapInPandas(build, FACTS)
    return made, fresh, answered.where("warning IS NOT NULL").select("warning")


def link_stories(stories: DataFrame, features: DataFrame, cache: DataFrame, provider: Provider, model_id: str, repo_id: str) -> tuple[DataFrame, DataFrame]:
    """(facts, new cache rows): which features each story(key, summary, description) asked for; features(name, narrative) are a repository's own.

    A story whose answer fails has no link. The set of feature names is part of the cache key.
    """
    spark = stories.sparkSession
    known = {r["name"]: r["narrative"] or "" for r in features.select("name", "narrative").toLocalIterator()}
    names = hashlib.sha256("\0".join(sorted(known)).encode()).hexdigest()
    asked = stories.withColumn("cache_key", S.cache_key(F.lit(LINK_ID), F.lit(LINK_VERSION), F.lit(model_id), F.sha2(F.concat_ws("\x00", "key", "summary", "description", F.lit(names)), 256)))
    stored, rows, fresh = {r["cache_key"]: r["output"] for r in cache.join(asked.select("cache_key"), "cache_key", "left_semi").toLocalIterator()}, [], []
    for r in asked.orderBy("key").toLocalIterator():
        try:
            if (text := stored.get(r["cache_key"])) is None:
                text = provider.complete(story_prompt(r["key"], r["summary"] or "", r["description"] or "", known), LINK_ID)
                found = parse_links(text, set(known))
                fresh.append((r["cache_key"], LINK_ID, LINK_VERSION, model_id, text))
            else:
                found = parse_links(text, set(known))
        except Exception:  # an answer or a call that fails leaves the story without links
            continue
        if found:
            rows.append(fact(repo_id, "jira_feature_link_observed", {"jira_key": r["key"], "feature_names": found}, [], "semantic", []))
    return spark.createDataFrame(rows, FACTS), spark.createDataFrame(fresh, schemas.LLM_CACHE)
