"""Compiling artifacts into the graph: full, one change unit at a time, and a shadow run that writes nothing."""

from __future__ import annotations

import datetime
import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph import schemas
from quarrygraph.functions import scalars as S
from quarrygraph.operators import diff, embed, publish, semantic, wiki
from quarrygraph.operators.durable import durable
from quarrygraph.operators.extract import canonical, extract_facts
from quarrygraph.operators.normalize import CandidateState, normalize
from quarrygraph.operators.store import Store
from quarrygraph.sources import tracker
from quarrygraph.streaming import reconcile


def extra_fact(spark: SparkSession, rows: list[tuple[str, str, dict, list[dict]]]) -> DataFrame:
    """Facts of given (repo_id, fact_type, payload, anchors), for sources that are small by nature: changes, issues, journeys, scores."""
    import hashlib

    made = [(repo, kind, text := canonical(payload), [], "declared", hashlib.sha256(text.encode()).hexdigest(), anchors) for repo, kind, payload, anchors in rows]
    return spark.createDataFrame(made, schemas.FACTS)


def pr_facts(prs: DataFrame, repo_id: str) -> DataFrame:
    """A fact for each pull request, and one for each of its renames."""
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    whole = F.struct("body", F.transform("files", lambda f: f["path"]).alias("files"), S.issue_keys(text).alias("linked_issue_keys"), "merge_commit_sha", F.date_format("merged_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("merged_at"), "number", "title")
    moved = prs.select(F.explode("files").alias("f")).where("f.change = 'renamed' AND f.old_path IS NOT NULL").select(F.struct("f.change", F.col("f.path").alias("new_path"), "f.old_path").alias("p")).select(F.struct(F.col("p.change").alias("change"), F.col("p.new_path").alias("new_path"), F.col("p.old_path").alias("old_path")).alias("p"))
    one = lambda df, kind: df.select(F.lit(repo_id).alias("repo_id"), F.lit(kind).alias("fact_type"), F.to_json("p", {"ignoreNullFields": "false"}).alias("payload")).select("repo_id", "fact_type", "payload", F.array().cast("array<string>").alias("artifact_refs"), F.lit("forge").alias("extractor"), F.sha2("payload", 256).alias("content_hash"), F.array().cast(f"array<{schemas.ANCHOR}>").alias("anchors"))
    return one(prs.select(whole.alias("p")), "pr_observed").unionByName(one(moved, "source_change_observed"))


@dataclass
class Steps:
    """What a compile does beyond the deterministic families; every part may be left out.

    A provider that fails leaves a degraded run; more calls than the budget fail the run, and answers so far are kept, so that it
    can go on. Pages, vectors and publishing come after the commit: what fails there is a warning.
    """

    provider: semantic.Provider | None = None
    model_id: str = "none"
    budget: int | None = None
    expected: bool = False  # the configuration wants the semantic family, so a run without it is degraded
    embedder: embed.Embedder | None = None
    pages: str | None = None
    publisher: publish.Branch | None = None


@dataclass
class Summary:
    """One compile in figures: numbers of the state, of changes by kind, of pages and vectors, and what was said on the way."""

    run: int
    entities: int = 0
    edges: int = 0
    changes: dict[str, int] = field(default_factory=dict)
    dirty: int = 0
    degraded: bool = False
    pages: int = 0
    vectors: int = 0
    published: str | None = None
    warnings: list[str] = field(default_factory=list)


def _run_row(spark: SparkSession, repo_id: str, run: int, unit: dict, status: str, began: datetime.datetime, error: str | None = None) -> DataFrame:
    row = (repo_id, run, unit.get("scope", "full"), unit.get("key"), unit.get("pr_number"), unit.get("sha"), unit.get("merged_at"), unit.get("commit_timestamp"), status, bool(unit.get("degraded")), error, began, _now(), schemas.VERSIONS)
    return spark.createDataFrame([row], schemas.RUNS)


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)


def semantic_facts(store: Store, repo_id: str, artifacts: DataFrame, facts: DataFrame, steps: Steps) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(facts, new answers, warnings) of the semantic family: candidates of files, then the features that stories asked for. Nothing where the provider is out."""
    known = store.read("llm_cache")
    made, fresh, said = semantic.extract_semantic(artifacts, facts, known, steps.provider, steps.model_id, steps.budget, durable)
    made = durable(made)
    if made.isEmpty() and fresh.isEmpty() and not said.isEmpty():
        return None, None, said
    stories = facts.where("fact_type = 'jira_observed'").select(*[F.get_json_object("payload", f"$.{c}").alias(c) for c in ("key", "summary", "description")])
    narrative = F.get_json_object("payload", "$.narrative").alias("narrative")
    new = made.where("fact_type = 'feature_candidate'").select(F.get_json_object("payload", "$.name").alias("name"), narrative, F.lit(0).alias("age"))
    old = store.read("entities").where((F.col("repo_id") == repo_id) & (F.col("entity_type") == "feature")).select("name", narrative, F.lit(1).alias("age"))
    features = new.unionByName(old).groupBy("name").agg(F.min_by("narrative", F.struct("age", "narrative")).alias("narrative"))
    if not stories.isEmpty() and not features.isEmpty():
        links, more = semantic.link_stories(stories, features, known, steps.provider, steps.model_id, repo_id)
        made, fresh = made.unionByName(links), fresh.unionByName(more)
    return made, fresh, said


def all_facts(artifacts: DataFrame, more: DataFrame | None = None) -> DataFrame:
    facts = extract_facts(artifacts)
    return durable(facts if more is None else facts.unionByName(more))


def state_of(spark: SparkSession, store: Store, repo_id: str, repo_slug: str, facts: DataFrame, scope: diff.Scope) -> tuple[CandidateState, DataFrame, DataFrame, DataFrame]:
    """(candidate, entity changes, edge changes, dirty slugs) of facts against the stored state, without writing."""
    current = store.read("entities").where(F.col("repo_id") == repo_id)
    edges = store.read("edges").where(F.col("repo_id") == repo_id)
    repositories = spark.createDataFrame([(repo_id, repo_slug)], "repo_id string, repo_slug string")
    state = normalize(spark, facts, current, repositories)
    state.entities, state.edges = durable(state.entities), durable(state.edges)
    changes, edge_changes, dirty = diff.compute(state.entities, state.edges, current, edges, scope)
    changes, edge_changes = durable(changes), durable(edge_changes)
    return state, changes, edge_changes, dirty


def compile_state(spark: SparkSession, store: Store, repo_id: str, repo_slug: str, artifacts: DataFrame, scope: diff.Scope, more: DataFrame | None = None) -> tuple[CandidateState, DataFrame, DataFrame, DataFrame]:
    return state_of(spark, store, repo_id, repo_slug, all_facts(artifacts, more), scope)


def compile_once(spark: SparkSession, store: Store, repo_id: str, repo_slug: str, artifacts: DataFrame, scope: diff.Scope | None = None, more: DataFrame | None = None, unit: dict | None = None, steps: Steps | None = None) -> int:
    """The run of compile_run."""
    return compile_run(spark, store, repo_id, repo_slug, artifacts, scope, more, unit, steps).run


def compile_run(spark: SparkSession, store: Store, repo_id: str, repo_slug: str, artifacts: DataFrame, scope: diff.Scope | None = None, more: DataFrame | None = None, unit: dict | None = None, steps: Steps | None = None) -> Summary:
    """One compile: its state, logs and ledger row become visible together. A failure leaves a failed ledger row and raises again."""
    scope, unit, steps, began = scope or diff.Scope(), dict(unit or {}), steps or Steps(), _now()
    stamp = lambda df, run: df.withColumn("compile_run_id", F.lit(run))
    with store.lock(repo_slug):
        run = store.next_version()
        tables, notes = {}, None
        try:
            facts = all_facts(artifacts, more)
            families = set(scope.ran_families)
            if steps.provider is not None:
                made, fresh, notes = semantic_facts(store, repo_id, artifacts, facts, steps)
                if made is not None:
                    facts, families = durable(facts.unionByName(made)), families | {"llm"}
                    tables["llm_cache"] = fresh
            unit["degraded"] = unit.get("degraded") or (steps.expected or steps.provider is not None) and "llm" not in families
            scope = diff.Scope(scope.full, frozenset(families), scope.in_scope_files)
            state, changes, edge_changes, dirty = state_of(spark, store, repo_id, repo_slug, facts, scope)
            dirty = durable(dirty)
            ours, our_edges = (store.read(name).where(F.col("repo_id") == repo_id) for name in ("entities", "edges"))
            proof = state.evidence.select("repo_id", "slug", F.map_concat(F.create_map(F.lit("rule"), "rule"), F.transform_values("signals", lambda k, v: v.cast("string"))).alias("evidence"))
            deltas = stamp(changes.join(proof, ["repo_id", "slug"], "left"), run)
            deltas = deltas.withColumn("evidence", F.when((F.col("op") == "removed") | F.col("evidence").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.col("evidence")))
            alive = changes.where("op <> 'removed'").select("repo_id", "slug")
            said = state.warnings if notes is None else state.warnings.unionByName(notes.select(F.lit(repo_id).alias("repo_id"), "warning"))
            tables |= {
                "entities": diff.upsert(ours, state.entities, changes, run),
                "edges": diff.apply_edges(our_edges, edge_changes),
                "deltas": deltas,
                "edge_deltas": stamp(edge_changes, run),
                "provenance": stamp(state.provenance.join(alive, ["repo_id", "slug"], "left_semi"), run),
                "facts": stamp(facts, run),
                "artifacts": stamp(artifacts, run),
                "conflicts": stamp(state.conflicts, run),
                "warnings": stamp(said, run),
                "runs": _run_row(spark, repo_id, run, unit, "succeeded", began),
            }
            store.commit(run, repo_id, tables)
        except Exception as error:
            if run not in store.versions():
                kept = {"llm_cache": error.answered} if getattr(error, "answered", None) is not None else {}
                store.commit(run, repo_id, {**kept, "runs": _run_row(spark, repo_id, run, unit, "failed", began, str(error)[:2000])})
            raise
        summary = Summary(run, degraded=bool(unit["degraded"]))
        ours, our_edges = (store.read(name).where(F.col("repo_id") == repo_id) for name in ("entities", "edges"))
        summary.entities, summary.edges, summary.dirty = ours.count(), our_edges.count(), dirty.count()
        summary.changes = {r["op"]: r["n"] for r in changes.groupBy("op").agg(F.count(F.lit(1)).alias("n")).collect()}
        summary.warnings = [r["warning"] for r in store.read("warnings").where(F.col("compile_run_id") == run).orderBy("warning").limit(WARNINGS_SHOWN).collect()]
        _after(store, repo_id, unit, dirty, steps, summary)
    return summary


#: How many warnings a summary shows; the store's table has them all.
WARNINGS_SHOWN = 100


def _after(store: Store, repo_id: str, unit: dict, dirty: DataFrame, steps: Steps, summary: Summary) -> None:
    """Pages, vectors and the published branch of a committed run; none of them can undo it."""
    mine = lambda name: store.read(name).where(F.col("repo_id") == repo_id)

    def write_pages() -> None:
        rendered = durable(wiki.pages(mine("entities"), mine("edges"), mine("deltas"), dirty))
        wiki.emit(rendered, steps.pages)
        wiki.emit(wiki.summary_pages(mine("entities"), mine("deltas"), mine("runs")), steps.pages)
        wiki.prune(store.spark, mine("entities"), steps.pages)
        summary.pages = rendered.count()

    def write_vectors() -> None:
        table = durable(embed.embed(mine("entities"), mine("embeddings"), steps.embedder, dirty))
        store.commit(store.next_version(), repo_id, {"embeddings": table})
        counts = {r["status"]: r["n"] for r in table.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        summary.vectors = counts.get("current", 0)
        if counts.get("pending"):
            summary.warnings.append(f"{counts['pending']} vectors wait for the next compile")

    def write_branch() -> None:
        summary.published = steps.publisher.publish(steps.pages, f"run {summary.run} of {(unit.get('sha') or 'the working tree')[:12]}")

    wanted = (("pages", steps.pages, write_pages), ("vectors", steps.embedder, write_vectors), ("publishing", steps.publisher and steps.pages, write_branch))
    for name, asked, step in wanted:
        if not asked:
            continue
        try:
            step()
        except Exception as error:  # the run is committed; these can be made again at any time
            summary.warnings.append(f"{name} failed, the graph is whole: {str(error)[:500]}")
            if name == "pages":
                return


def verify(spark: SparkSession, store: Store, repo_id: str, repo_slug: str, artifacts: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(op, rule, n): what a full compile of the deterministic families would change, and by what evidence; nothing is written."""
    state, changes, edge_changes, _ = compile_state(spark, store, repo_id, repo_slug, artifacts, diff.Scope(), more)
    by_rule = changes.join(state.evidence.select("repo_id", "slug", "rule"), ["repo_id", "slug"], "left").groupBy("op", "rule").agg(F.count(F.lit(1)).alias("n"))
    return by_rule.unionByName(edge_changes.groupBy(F.concat(F.lit("edge_"), "op").alias("op"), F.lit(None).cast("string").alias("rule")).agg(F.count(F.lit(1)).alias("n")))


def register(spark: SparkSession, store: Store, repo_id: str, repo_slug: str, default_branch: str = "main") -> None:
    """Makes a repository known to a store; once is enough."""
    if repo_id not in store.repositories():
        store.commit(store.next_version(), repo_id, {"repositories": spark.createDataFrame([(repo_id, repo_slug, default_branch)], schemas.REPOSITORIES)})


def ledger(store: Store, repo_id: str) -> DataFrame:
    return store.read("runs").where(F.col("repo_id") == repo_id)


def watermark_of(store: Store, repo_id: str) -> datetime.datetime | None:
    seen = reconcile.watermark(ledger(store, repo_id)).first()
    return None if seen is None else seen["watermark"]


def reconcile_changes(spark: SparkSession, store: Store, repo_id: str, repo_slug: str, prs: DataFrame, commits: DataFrame, artifacts_at, expect_key: str | None = None, issues_of=None, steps: Steps | None = None, always: DataFrame | None = None, forced: bool = False) -> list[str]:
    """Compiles merged changes since the watermark one by one. artifacts_at(unit, paths) gives the files of a unit as they were then,
    issues_of(keys) the tracker's issues, always the facts that go with every unit. forced takes
    changes from before the watermark too; what has succeeded is never compiled again."""
    mark = None if forced else watermark_of(store, repo_id)
    since = None if mark is None else F.lit(mark)
    paths = F.array_sort(F.array_distinct(F.concat(F.transform("files", lambda f: f["path"]), F.filter(F.transform("files", lambda f: f["old_path"]), lambda p: p.isNotNull()))))
    left = prs.select(F.lit(repo_id).alias("repo_id"), F.lit("pr").alias("kind"), F.col("number").cast("string").alias("key"), F.col("merged_at").alias("ts"), F.col("merge_commit_sha").alias("sha"), paths.alias("paths"))
    right = commits.select(F.lit(repo_id).alias("repo_id"), F.lit("commit").alias("kind"), F.col("sha").alias("key"), F.col("timestamp").alias("ts"), "sha", F.array_sort("files").alias("paths"))
    units = reconcile.merge_streams(left, right, since)

    def one(unit: dict) -> None:
        pr = unit["kind"] == "pr"
        row = {"scope": unit["kind"], "key": unit["key"], "sha": unit["sha"], "pr_number": int(unit["key"]) if pr else None, "merged_at": unit["ts"] if pr else None, "commit_timestamp": None if pr else unit["ts"]}
        change = prs.where(F.col("number") == int(unit["key"])) if pr else commits.where(F.col("sha") == unit["sha"])
        parts = [pr_facts(change, repo_id)] if pr else []
        if issues_of is not None:
            said = F.concat_ws("\n", "title", "body") if pr else F.col("message")
            keys = sorted({k for r in change.select(S.issue_keys(said).alias("keys")).collect() for k in r["keys"]})
            if keys and (issues := issues_of(keys)) is not None:
                linked = spark.createDataFrame([(k, int(unit["key"]) if pr else None) for k in keys], "key string, linked_pr int")
                parts.append(tracker.facts(issues, linked, repo_id))
        parts += [] if always is None else [always]
        more = functools.reduce(DataFrame.unionByName, parts) if parts else None
        families = frozenset({"deterministic", "event"}) if pr else frozenset({"deterministic"})
        compile_once(spark, store, repo_id, repo_slug, artifacts_at(unit, unit["paths"]), diff.Scope(False, families, tuple(unit["paths"])), more, row, steps)

    return reconcile.reconcile(units, lambda: ledger(store, repo_id), one, expect_key)
