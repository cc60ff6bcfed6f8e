"""Diff of a candidate state against the current one, with scope-aware removal.

entities(repo_id, slug, entity_type, name, payload, content_hash, anchors, owner_slug, files); files decide removal and owner_slug is set
for wiki pages. edges(repo_id, relation_type, from_slug, to_slug).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions import scalars as S

#: Which family of extractors observes a type; types without one are never removed.
FAMILIES = {
    "project": "deterministic", "component": "deterministic", "api": "deterministic", "test_coverage": "deterministic", "user_journey": "deterministic",
    "feature": "llm", "business_rule": "llm", "risk": "llm", "pull_request": "event", "jira_story": "event",
}


@dataclass(frozen=True)
class Scope:
    """What a compile looked at: everything, or a slice of files; and the families of extractors that ran."""

    full: bool = True
    ran_families: frozenset[str] = frozenset({"deterministic"})
    in_scope_files: tuple[str, ...] = field(default=())


_KEY = ["repo_id", "slug"]
_EDGE = ["repo_id", "relation_type", "from_slug", "to_slug"]


def entity_changes(candidate: DataFrame, current: DataFrame) -> DataFrame:
    """(repo_id, slug, entity_type, op, summary): added, changed (hash or name; beats moved) or moved (files of the anchors)."""
    a = candidate.select(*_KEY, "entity_type", F.col("name").alias("n1"), F.col("content_hash").alias("h1"), F.col("payload").alias("p1"), S.anchor_files(F.col("anchors")).alias("f1"))
    b = current.select(*_KEY, F.col("name").alias("n0"), F.col("content_hash").alias("h0"), F.col("payload").alias("p0"), S.anchor_files(F.col("anchors")).alias("f0"), F.lit(True).alias("known"))
    changed = (F.col("h0") != F.col("h1")) | ~F.col("n0").eqNullSafe(F.col("n1"))
    op = F.when(F.col("known").isNull(), "added").when(changed, "changed").when(F.col("f0") != F.col("f1"), "moved")
    pair = lambda old, new: F.struct(old.alias("old"), new.alias("new"))
    named = F.when(F.col("n0").eqNullSafe(F.col("n1")), F.create_map().cast("map<string,struct<old:string,new:string>>")).otherwise(F.create_map(F.lit("name"), pair(F.col("n0"), F.col("n1"))))
    without_name = F.map_filter(S.payload_diff(F.col("p0"), F.col("p1")), lambda k, v: k != "name")
    changes = F.when(F.col("n0").eqNullSafe(F.col("n1")), S.payload_diff(F.col("p0"), F.col("p1"))).otherwise(F.map_concat(without_name, named))
    files = F.create_map(F.lit("anchors"), pair(F.to_json("f0"), F.to_json("f1")))
    summary = F.when(F.col("op") == "changed", changes).when(F.col("op") == "moved", files).otherwise(F.create_map().cast("map<string,struct<old:string,new:string>>"))
    return a.join(b, _KEY, "left").withColumn("op", op).where("op IS NOT NULL").select(*_KEY, "entity_type", "op", summary.alias("summary"))


def removable(scope: Scope, entity_type: Column, files: Column) -> Column:
    """Removal needs evidence: the family ran, and the compile was full or all files of the entity (at least one) were in scope."""
    families = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    ran = F.array(*[F.lit(f) for f in sorted(scope.ran_families)]) if scope.ran_families else F.array().cast("array<string>")
    observed = F.array_contains(ran, families[entity_type]) & ~entity_type.isin("pull_request", "jira_story")
    if scope.full:
        return F.coalesce(observed, F.lit(False))
    seen = F.array(*[F.lit(f) for f in scope.in_scope_files]) if scope.in_scope_files else F.array().cast("array<string>")
    return F.coalesce(observed & (F.size(files) > 0) & (F.size(F.array_except(files, seen)) == 0), F.lit(False))


def unobserved(candidate: DataFrame, current: DataFrame, scope: Scope) -> DataFrame:
    """(repo_id, slug, entity_type, removed): the fate of current entities without a candidate; wiki pages follow their owner."""
    gone = current.join(candidate.select(*_KEY), _KEY, "left_anti")
    plain = gone.where("entity_type <> 'wiki_page'").select(*_KEY, "entity_type", removable(scope, F.col("entity_type"), F.col("files")).alias("removed"))
    pages = gone.where("entity_type = 'wiki_page'").select(*_KEY, "entity_type", "owner_slug")
    fate = plain.select("repo_id", F.col("slug").alias("owner_slug"), F.col("removed").alias("owner_removed"))
    alive = candidate.select("repo_id", F.col("slug").alias("owner_slug"), F.lit(True).alias("owner_alive")).distinct()
    joined = pages.join(fate, ["repo_id", "owner_slug"], "left").join(alive, ["repo_id", "owner_slug"], "left")
    orphan = F.lit(scope.full) & F.col("owner_alive").isNull() & F.col("owner_removed").isNull()
    return plain.unionByName(joined.select(*_KEY, "entity_type", (F.coalesce("owner_removed", F.lit(False)) | orphan).alias("removed")))


def edge_changes(candidate: DataFrame, current: DataFrame, fates: DataFrame) -> DataFrame:
    """(repo_id, relation_type, from_slug, to_slug, op): an edge goes if its origin was observed or removed; edges at removed entities always go."""
    removed = fates.where("removed").select("repo_id", "slug")
    survivors = fates.where("NOT removed").select("repo_id", F.col("slug").alias("from_slug"))
    starts, ends = removed.withColumnRenamed("slug", "from_slug"), removed.withColumnRenamed("slug", "to_slug")
    old, new = current.select(*_EDGE).distinct(), candidate.select(*_EDGE).distinct()
    lost = old.join(new, _EDGE, "left_anti").join(survivors, ["repo_id", "from_slug"], "left_anti")
    cut = old.join(starts, ["repo_id", "from_slug"], "left_semi").unionByName(old.join(ends, ["repo_id", "to_slug"], "left_semi"))
    added = new.join(old, _EDGE, "left_anti").join(starts, ["repo_id", "from_slug"], "left_anti").join(ends, ["repo_id", "to_slug"], "left_anti")
    return lost.unionByName(cut).distinct().select(*_EDGE, F.lit("removed").alias("op")).unionByName(added.select(*_EDGE, F.lit("added").alias("op")))


def dirty(changes: DataFrame, edges: DataFrame, candidate: DataFrame) -> DataFrame:
    """(repo_id, slug): candidates that changed or are an end of a changed edge."""
    touched = changes.where("op <> 'removed'").select(*_KEY).unionByName(edges.select("repo_id", F.col("from_slug").alias("slug"))).unionByName(edges.select("repo_id", F.col("to_slug").alias("slug")))
    return touched.distinct().join(candidate.select(*_KEY), _KEY, "left_semi")


def evidence(match: Column) -> Column:
    """{rule, signals...} of a match evidence struct as a map of texts."""
    signals = F.transform_values(match["signals"], lambda k, v: v.cast("string"))
    return F.when(match.isNull(), F.create_map().cast("map<string,string>")).otherwise(F.map_concat(F.create_map(F.lit("rule"), match["rule"]), F.coalesce(signals, F.create_map().cast("map<string,string>"))))


def compute(candidate: DataFrame, candidate_edges: DataFrame, current: DataFrame, current_edges: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entity changes with removals, edge changes, dirty slugs)."""
    fates = unobserved(candidate, current, scope)
    kept = entity_changes(candidate, current)
    gone = fates.where("removed").select(*_KEY, "entity_type", F.lit("removed").alias("op"), F.create_map().cast("map<string,struct<old:string,new:string>>").alias("summary"))
    changes = kept.unionByName(gone)
    edges = edge_changes(candidate_edges, current_edges, fates)
    return changes, edges, dirty(changes, edges, candidate)


def upsert(current: DataFrame, candidate: DataFrame, changes: DataFrame, run_id: int) -> DataFrame:
    """The next snapshot: new entities, changed ones with the candidate's content and this run as last, others as they were, removed ones gone."""
    ops = changes.select(*_KEY, "op")
    base = [c for c in current.columns if c not in ("first_run", "last_run")]
    staying = current.join(ops, _KEY, "left_anti")
    first = current.select(*_KEY, "first_run")
    written = candidate.join(ops.where("op <> 'removed'"), _KEY).join(first, _KEY, "left").withColumn("first_run", F.coalesce("first_run", F.lit(run_id))).withColumn("last_run", F.lit(run_id))
    return staying.select(*base, "first_run", "last_run").unionByName(written.select(*base, "first_run", "last_run"))


def apply_edges(current: DataFrame, changes: DataFrame) -> DataFrame:
    gone, new = changes.where("op = 'removed'").select(*_EDGE), changes.where("op = 'added'").select(*_EDGE)
    return current.select(*_EDGE).join(gone, _EDGE, "left_anti").unionByName(new).distinct()
