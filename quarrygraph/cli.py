"""Command line: init, compile, reconcile, verify, inspect, validate-test, validate-okf, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quarrygraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _options(section: dict, *without: str) -> dict:
    return {k: v for k, v in section.items() if k not in ("enabled", *without)}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quarrygraph", description=__doc__)
    parser.add_argument("--repo", default=".", help="folder of the repository")
    parser.add_argument("--store", default=".graph", help="folder of the graph, below the repository unless absolute or a URI")
    commands = parser.add_subparsers(dest="command", required=True)
    init = commands.add_parser("init")
    init.add_argument("slug")
    init.add_argument("--branch", default="main")
    compiling = commands.add_parser("compile", help="the whole working tree, or one merged pull request")
    compiling.add_argument("--pr", type=int)
    compiling.add_argument("--emit-only", action="store_true", help="write the pages of the stored graph again, compile nothing")
    reconciling = commands.add_parser("reconcile", help="merged changes since the last one that was compiled")
    reconciling.add_argument("changes", nargs="?", help="Parquet folder with merged_prs and commits; without it the forge of the configuration")
    reconciling.add_argument("--expect", help="key of a change that must be among the compiled ones")
    for command in (compiling, reconciling):
        command.add_argument("--no-llm", action="store_true")
    commands.add_parser("verify")
    commands.add_parser("inspect")
    test = commands.add_parser("validate-test")
    test.add_argument("test_file")
    test.add_argument("--for-entity", required=True)
    commands.add_parser("validate-okf").add_argument("folder", nargs="?")
    commands.add_parser("serve")
    return parser


def _steps(given, settings: dict, pages: str):
    """What the configuration asks for beyond the deterministic families."""
    from quarrygraph import compiler, interfaces

    llm, vectors, branch = (settings.get(k) or {} for k in ("llm", "embeddings", "publisher"))
    steps = compiler.Steps(pages=pages, expected=bool(llm.get("enabled")))
    if llm.get("enabled") and not given.no_llm:
        options = _options(llm, "provider", "max_calls_per_run", "model")
        steps.provider = interfaces.make("provider", llm.get("provider", "http"), model_id=llm["model"], **options)
        steps.model_id, steps.budget = llm["model"], llm.get("max_calls_per_run", 200)
    if vectors.get("enabled"):
        steps.embedder = _embedder(vectors)
    if branch.get("enabled"):
        steps.publisher = interfaces.make("publisher", branch.get("kind", "branch"), repo=given.repo, **_options(branch, "kind"))
    return steps


def _embedder(section: dict):
    from quarrygraph import interfaces

    options = _options(section, "provider", "model")
    return interfaces.make("embedder", section.get("provider", "http"), **({"model_id": section["model"]} if "model" in section else {}), **options)


def _said(summary) -> None:
    print(f"run {summary.run}: {summary.entities} entities, {summary.edges} edges, {summary.dirty} dirty{', degraded' if summary.degraded else ''}")
    print("  " + (", ".join(f"{n} {op}" for op, n in sorted(summary.changes.items())) or "no change"))
    print(f"  {summary.pages} pages, {summary.vectors} vectors" + (f", published {summary.published[:12]}" if summary.published else ""))
    for warning in summary.warnings:
        print(f"  warning: {warning}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    given = _parser().parse_args(argv)

    from quarrygraph import compiler, interfaces, server
    from quarrygraph.operators import serve, validate, wiki
    from quarrygraph.operators.store import Store
    from quarrygraph.service import Graph
    from quarrygraph.sources import config, git, tracker

    spark = _session()
    store = Store(spark, given.store if "://" in given.store else os.path.join(os.path.abspath(given.repo), given.store))
    if given.command == "init":
        fresh = config.write_config(given.repo, given.slug)
        compiler.register(spark, store, given.slug, given.slug, given.branch)
        print("written" if fresh else "there already")
        return 0
    settings = config.read_config(given.repo)
    slug, branch = settings["repo"]["slug"], settings["repo"].get("default_branch", "main")
    pages = os.path.join(os.path.abspath(given.repo), (settings.get("wiki") or {}).get("output_dir", "wiki"))
    if given.command == "validate-okf":
        folder = os.path.abspath(given.folder or pages)
        files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
        path = F.substring_index(F.col("_metadata.file_path"), f"{folder}/", -1)
        issues = wiki.conformance(files.select(path.alias("path"), F.col("value").alias("text"))).orderBy("path", "rule").collect()
        print(json.dumps([r.asDict() for r in issues], indent=1))
        return int(bool(issues))
    embeddings = settings.get("embeddings") or {}
    graph = Graph(store, slug, config.dependencies(settings), store.read("embeddings").where(F.col("repo_id") == slug), _embedder(embeddings) if embeddings.get("enabled") else None)
    if given.command == "serve":
        server.serve(graph)
        return 0
    if given.command == "inspect":
        graph.knowledge_stats().show(truncate=False)
        serve.recent_ops(graph._table("runs"), graph._table("deltas")).show(truncate=False)
        return 0
    if given.command == "validate-test":
        with open(given.test_file, encoding="utf-8") as f:
            source = f.read()
        if graph.entities.where(F.col("slug") == given.for_entity).isEmpty():
            print(f"{given.for_entity} is not in the graph", file=sys.stderr)
            return 1
        one = validate.claims(spark.createDataFrame([(slug, given.for_entity, given.test_file, source)], "repo_id string, slug string, test_file string, source string"))
        found = validate.score(one, graph.test_plan(given.for_entity), graph.entities).first().asDict(True)
        print(json.dumps(found, indent=1))
        return int(not found["header_found"] or bool(found["nonexistent"]))
    declared = config.declared_facts(slug, settings, given.repo)
    always = compiler.extra_fact(spark, declared) if declared else None
    if given.command == "verify":
        changes = compiler.verify(spark, store, slug, slug, git.working_tree(spark, given.repo, slug), always).collect()
        print(json.dumps([r.asDict() for r in changes], indent=1))
        return int(bool(changes))
    if given.command == "compile" and given.emit_only:
        warnings = graph.emit(pages)
        print("\n".join(warnings) or "written")
        return int(bool(warnings))
    steps, issues = _steps(given, settings, pages), settings.get("jira") or {}
    if given.command == "compile" and given.pr is None:
        known = tracker.everything(spark, issues, given.repo)
        if known is not None:
            stories = tracker.facts(known, spark.createDataFrame([], "key string, linked_pr int"), slug)
            always = stories if always is None else always.unionByName(stories)
        _said(compiler.compile_run(spark, store, slug, slug, git.working_tree(spark, given.repo, slug), more=always, unit={"sha": git.head_commit(given.repo)}, steps=steps))
        return 0
    section = settings.get("forge") or {}
    if given.command == "reconcile" and given.changes:
        prs, commits = (spark.read.parquet(f"{given.changes}/{n}") for n in ("merged_prs", "commits"))
    else:
        from quarrygraph import schemas

        forge = interfaces.make("forge", section.get("kind", "rest"), **_options(section, "kind"))
        if given.command == "compile":
            prs, commits = forge.one_pr(spark, given.pr), spark.createDataFrame([], schemas.COMMITS)
        else:
            since = compiler.watermark_of(store, slug)
            prs, commits = forge.merged_prs(spark, branch, since), forge.commits(spark, branch, since)
    at = lambda unit, paths: git.at_commit(spark, given.repo, slug, unit["sha"], paths)
    known = (lambda keys: tracker.configured(spark, issues, given.repo, keys)) if issues.get("enabled") else None
    expect = str(given.pr) if given.command == "compile" else given.expect
    done = compiler.reconcile_changes(spark, store, slug, slug, prs, commits, at, expect, known, steps, always, forced=given.command == "compile")
    print("\n".join(done))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
