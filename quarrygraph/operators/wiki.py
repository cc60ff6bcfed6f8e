"""Pages of the graph as Markdown, written by the tasks that render them; orphans are pruned, and bundles are checked."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrygraph import schemas
from quarrygraph.functions import scalars as S

VERSION = "0.2"
HISTORY = 5
#: Names on one page of a listing.
PAGE = 1000
#: Headings of relations, by relation and direction.
LABELS = {
    ("depends_on", "out"): "Depends on", ("depends_on", "in"): "Used by", ("contains", "out"): "Contains", ("contains", "in"): "Part of", ("covers", "out"): "Covers", ("covers", "in"): "Covered by",
    ("defined_in", "out"): "Defined in", ("defined_in", "in"): "Defines", ("implemented_by", "out"): "Implemented by", ("implemented_by", "in"): "Implements", ("governs", "out"): "Governs", ("governs", "in"): "Governed by",
    ("affects", "out"): "Affects", ("affects", "in"): "At risk from", ("motivates", "out"): "Motivates", ("motivates", "in"): "Motivated by", ("traverses", "out"): "Steps through", ("traverses", "in"): "Step of",
}


def rel_link(source: str, target: str) -> str:
    return posixpath.relpath(f"{target}.md", posixpath.dirname(f"{source}.md") or ".")


def render(slug: str, entity_type: str, name: str, payload: str, relations: list, history: list) -> str:
    """One page: front matter, the payload's fields, relations by heading, and the newest changes."""
    fields = json.loads(payload or "{}")
    lines = ["---", f"type: {entity_type}", f"title: {json.dumps(name, ensure_ascii=False)}", f"slug: {slug}", "---", "", f"# {name}", ""]
    for key, value in sorted(fields.items()):
        if value in (None, "", [], {}) or key == "name":
            continue
        if isinstance(value, list):
            lines += [f"## {key.replace('_', ' ').capitalize()}", "", *[f"- {x['symbol_path']} ({x['kind']})" if isinstance(x, dict) and "symbol_path" in x else f"- {x}" for x in value], ""]
        else:
            lines += [f"**{key.replace('_', ' ').capitalize()}:** {json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else value}", ""]
    for (relation, direction), label in LABELS.items():
        others = sorted({(r["other"], r["name"]) for r in relations or [] if r["relation_type"] == relation and r["direction"] == direction})
        if others:
            lines += [f"## {label}", "", *[f"- [{title or other}]({rel_link(slug, other)})" for other, title in others], ""]
    if history:
        lines += ["## History", "", *[f"- run {h['compile_run_id']}: {h['op']}" for h in history], ""]
    return "\n".join(lines)


def pages(entities: DataFrame, edges: DataFrame, deltas: DataFrame, dirty: DataFrame | None = None) -> DataFrame:
    """(repo_id, path, slug, text) of the owners of pages; dirty(repo_id, slug) limits them to owners and pages that changed."""
    owned = entities.where("entity_type = 'wiki_page'").select("repo_id", F.col("owner_slug").alias("slug"), F.col("slug").alias("page"))
    todo = owned
    if dirty is not None:
        by_owner = owned.join(dirty.select("repo_id", "slug"), ["repo_id", "slug"], "left_semi")
        todo = by_owner.unionByName(owned.join(dirty.select("repo_id", F.col("slug").alias("page")), ["repo_id", "page"], "left_semi").select(*owned.columns)).distinct()
    both = edges.select("repo_id", F.col("from_slug").alias("slug"), F.lit("out").alias("direction"), "relation_type", F.col("to_slug").alias("other")).unionByName(edges.select("repo_id", F.col("to_slug").alias("slug"), F.lit("in").alias("direction"), "relation_type", F.col("from_slug").alias("other")))
    named = both.join(entities.select("repo_id", F.col("slug").alias("other"), "name"), ["repo_id", "other"]).join(todo.select("repo_id", "slug"), ["repo_id", "slug"], "left_semi")
    linked = named.groupBy("repo_id", "slug").agg(F.array_sort(F.collect_list(F.struct("relation_type", "direction", "other", "name"))).alias("relations"))
    newest = Window.partitionBy("repo_id", "slug").orderBy(F.col("compile_run_id").desc(), "op")
    recent = deltas.join(todo.select("repo_id", "slug"), ["repo_id", "slug"], "left_semi").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= HISTORY)
    past = recent.groupBy("repo_id", "slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "compile_run_id", "op"))), lambda h: F.struct(h["compile_run_id"].alias("compile_run_id"), h["op"].alias("op"))).alias("history"))
    rows = todo.join(entities, ["repo_id", "slug"]).join(linked, ["repo_id", "slug"], "left").join(past, ["repo_id", "slug"], "left")
    shaped = rows.select("repo_id", S.page_path(F.col("slug")).alias("path"), "slug", "entity_type", "name", "payload", "relations", "history")
    return shaped.mapInArrow(_render_batches, "repo_id string, path string, slug string, text string")


def _render_batches(batches):
    import pyarrow as pa

    for batch in batches:
        repo, path, *parts = batch.columns
        lists = [part.to_pylist() for part in parts]
        yield pa.RecordBatch.from_arrays([repo, path, parts[0], pa.array([render(*row) for row in zip(*lists)], pa.string())], ["repo_id", "path", "slug", "text"])


def index_pages(entities: DataFrame) -> DataFrame:
    """(path, text) of the index: one page of counts, and listings of the owners of pages by type, PAGE names on each."""
    shown = entities.where("entity_type = 'wiki_page'").select(F.col("owner_slug").alias("slug"), "repo_id").join(entities, ["repo_id", "slug"]).select("entity_type", "slug", "name")
    place = F.row_number().over(Window.partitionBy("entity_type").orderBy("slug")) - 1
    numbered = shown.withColumn("page", F.floor(place / PAGE).cast("int") + 1)
    listing = numbered.groupBy("entity_type", "page").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slug", "name"))), lambda x: F.concat(F.lit("- ["), x["name"], F.lit("](../"), x["slug"], F.lit(".md)"))), "\n").alias("items"))
    path = F.concat(F.lit("index/"), F.col("entity_type"), F.lit("-"), F.col("page").cast("string"), F.lit(".md"))
    parts = listing.select(path.alias("path"), F.concat(F.lit("---\ntype: index\ntitle: "), "entity_type", F.lit("\n---\n\n# "), "entity_type", F.lit("\n\n"), "items", F.lit("\n")).alias("text"))
    said = listing.select("entity_type", "page", F.concat(F.lit("- ["), "entity_type", F.lit(" "), F.col("page").cast("string"), F.lit("]("), path, F.lit("): "), F.col("n").cast("string")).alias("line"))
    lines = said.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_type", "page", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    top = lines.select(F.lit("index.md").alias("path"), F.concat(F.lit(f'---\nokf_version: "{VERSION}"\n---\n\n# Index\n\n[Recent changes](recent-changes.md) - [Log](log.md)\n\n'), F.coalesce("lines", F.lit("")), F.lit("\n")).alias("text"))
    return top.unionByName(parts)


def log_page(deltas: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, text) of the log: succeeded runs by day with counts of their changes, the newest first; one line a run."""
    per = deltas.groupBy("compile_run_id", "op").agg(F.count(F.lit(1)).alias("n")).groupBy("compile_run_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.col("n").cast("string"), "op"))), ", ").alias("said"))
    joined = runs.where("status = 'succeeded'").join(per, "compile_run_id", "left").withColumn("day", F.coalesce(F.date_format("finished_at", "yyyy-MM-dd"), F.lit("unknown day")))
    line = F.concat(F.lit("- run "), F.col("compile_run_id").cast("string"), F.lit(" ("), F.coalesce(F.substring("sha", 1, 12), F.lit("no commit")), F.lit("): "), F.coalesce("said", F.lit("no change")))
    days = joined.groupBy("day").agg(F.max("compile_run_id").alias("last"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("compile_run_id", line.alias("line"))), asc=False), lambda x: x["line"]), "\n").alias("lines"))
    whole = days.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("last", "day", "lines")), asc=False), lambda x: F.concat(F.lit("## "), x["day"], F.lit("\n\n"), x["lines"])), "\n\n").alias("body"))
    return whole.select(F.lit("log.md").alias("path"), F.concat(F.lit("# Log\n\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("text"))


def recent_page(deltas: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, text): the changes of the last succeeded run by kind, PAGE names of each kind; the rest as a count."""
    last = runs.where("status = 'succeeded'").agg(F.max("compile_run_id").alias("compile_run_id"))
    of_last = deltas.join(last, "compile_run_id", "left_semi")
    ranked = of_last.withColumn("n", F.row_number().over(Window.partitionBy("op").orderBy("slug")))
    name = F.when(F.col("entity_type").isin(*schemas.PAGE_OWNERS), F.concat(F.lit("["), "slug", F.lit("]("), "slug", F.lit(".md)"))).otherwise(F.concat(F.lit("`"), "slug", F.lit("`")))
    listed = ranked.groupBy("op").agg(F.max("n").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= PAGE, F.struct("n", name.alias("name"))))), lambda x: F.concat(F.lit("- "), x["name"])), "\n").alias("names"))
    more = F.when(F.col("total") > PAGE, F.concat(F.lit("\n- and "), (F.col("total") - PAGE).cast("string"), F.lit(" more"))).otherwise("")
    body = listed.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("## "), "op", F.lit("\n\n"), "names", more))), "\n\n").alias("body"))
    text = F.concat(F.lit('---\ntype: recent_changes\ntitle: "Recent changes"\n---\n\n# Recent changes\n\n'), F.when(F.coalesce("body", F.lit("")) == "", F.lit("No changes.")).otherwise(F.col("body")), F.lit("\n"))
    return body.select(F.lit("recent-changes.md").alias("path"), text.alias("text"))


def summary_pages(entities: DataFrame, deltas: DataFrame, runs: DataFrame) -> DataFrame:
    return index_pages(entities).unionByName(log_page(deltas, runs)).unionByName(recent_page(deltas, runs))


def _files(folder: str):
    """(file system, path) of a folder: a plain path, or a URI of any system that tasks and driver share."""
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


def emit(rendered: DataFrame, folder: str) -> None:
    """Write (path, text) rows below a folder that all tasks share. A page that is written again is the same page, so a lost task does no harm."""

    def write(rows) -> None:
        system, root = _files(folder)
        for r in rows:
            target = f"{root}/{r['path']}"
            system.create_dir(posixpath.dirname(target), recursive=True)
            with system.open_output_stream(target) as f:
                f.write(r["text"].encode())

    rendered.select("path", "text").foreachPartition(write)


def prune(spark: SparkSession, entities: DataFrame, folder: str) -> list[str]:
    """Delete pages below the folder that no live page owns; the index, the log and the recent changes stay."""
    from pyarrow import fs

    system, root = _files(folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    there = [posixpath.relpath(f.path, root) for f in found if f.is_file and f.path.endswith(".md")]
    there = [p for p in there if p not in ("index.md", "log.md", "recent-changes.md") and not p.startswith("index/")]
    if not there:
        return []
    live = entities.where("entity_type = 'wiki_page'").select(S.page_path(F.col("owner_slug")).alias("path"))
    gone = sorted(r["path"] for r in spark.createDataFrame([(p,) for p in there], "path string").join(live, "path", "left_anti").toLocalIterator())
    for path in gone:
        system.delete_file(f"{root}/{path}")
    return gone


_FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n"


def front_matter(text):
    """Top-level key: value pairs as a map; null without a block."""
    block = F.regexp_extract(text, _FRONT, 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda line: F.regexp_like(line, F.lit(r"^[A-Za-z_][A-Za-z0-9_]*\s*:")))
    pairs = F.map_from_entries(F.transform(lines, lambda line: F.struct(F.regexp_extract(line, r"^(\w+)", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(line, r"^\w+\s*:\s*(.*)$", 1)), "^[\"']+|[\"']+$", "").alias("v"))))
    return F.when(F.regexp_like(text, F.lit(_FRONT)), pairs)


def conformance(files: DataFrame) -> DataFrame:
    """(path, rule) of files(path, text) that break a rule of page bundles."""
    base = F.element_at(F.split("path", "/"), -1)
    parsed = files.withColumn("_base", base).withColumn("_front", front_matter(F.col("text")))
    extra = F.size(F.filter(F.map_keys("_front"), lambda k: k != "okf_version")) > 0
    rule = (
        F.when((F.col("_base") == "log.md") & F.col("_front").isNotNull(), "log.md-frontmatter")
        .when((F.col("_base") == "index.md") & F.coalesce(extra, F.lit(False)), "index.md-frontmatter")
        .when(F.col("_base").isin("log.md", "index.md"), None)
        .when(F.col("_front").isNull(), "missing-frontmatter")
        .when(F.coalesce(F.col("_front")["type"], F.lit("")) == "", "missing-type")
    )
    return parsed.select("path", rule.alias("rule")).where("rule IS NOT NULL")
