"""Column functions of the knowledge graph: names, routes, anchors, hashes, rates, vectors. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Issue keys of trackers (fixed pattern).
ISSUE_KEY = r"\b([A-Z][A-Z0-9]+-\d+)\b"
HTTP_VERBS = ("get", "post", "put", "delete", "patch", "head", "options")


def slugify(text: Column) -> Column:
    """Lower case, runs of other characters as one dash, no outer dashes; `unnamed` if nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(dashed == "", F.lit("unnamed")).otherwise(dashed)


def entity_slug(entity_type: Column, key: Column) -> Column:
    return F.concat(F.replace(entity_type, F.lit("_"), F.lit("-")), F.lit("/"), slugify(key))


def normalize_route(route: Column) -> Column:
    """Every {parameter} or <parameter> becomes {}."""
    return F.regexp_replace(route, "[{<][^}>]*[}>]", "{}")


def tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: t != ""))


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of token sets; 0 if either has none."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def anchor_overlap(candidate: Column, target: Column) -> Column:
    """Share of the candidate's anchors that the target has: by symbol if both sides have one, else by file."""
    has = lambda anchors: F.exists(anchors, lambda a: F.coalesce(a["symbol_path"], F.lit("")) != "")
    files = lambda anchors: F.array_distinct(F.transform(anchors, lambda a: a["file_path"]))
    symbols = lambda anchors: F.array_distinct(F.transform(F.filter(anchors, lambda a: F.coalesce(a["symbol_path"], F.lit("")) != ""), lambda a: F.concat_ws("\x00", a["file_path"], a["symbol_path"])))
    share = lambda x, y: F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))
    return F.when(has(candidate) & has(target), share(symbols(candidate), symbols(target))).otherwise(share(files(candidate), files(target)))


def file_to_module(path: Column) -> Column:
    """Dotted module of a file; only .py is stripped, a trailing __init__ goes."""
    dotted = F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


def map_anchor(anchor: Column, new_path: Column) -> Column:
    """The anchor after a rename of its file: the module prefix of its symbol follows. A null new_path changes nothing."""
    old_mod, new_mod, symbol = file_to_module(anchor["file_path"]), file_to_module(new_path), anchor["symbol_path"]
    moved = F.when((old_mod != "") & symbol.startswith(F.concat(old_mod, F.lit("."))), F.concat(new_mod, F.substr(symbol, F.length(old_mod) + 1))).when(symbol == old_mod, new_mod).otherwise(symbol)
    return F.when(new_path.isNull(), anchor).otherwise(F.struct(new_path.alias("file_path"), moved.alias("symbol_path"), anchor["span"].alias("span")))


def anchor_files(anchors: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(anchors, lambda a: a["file_path"])))


def payload_diff(old: Column, new: Column) -> Column:
    """Top-level keys of two JSON objects whose values differ: {key: {old, new}}; a missing key equals null."""
    parsed = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    both = F.map_zip_with(parsed(old), parsed(new), lambda k, a, b: F.struct(a.alias("old"), b.alias("new")))
    return F.map_filter(both, lambda k, v: ~v["old"].eqNullSafe(v["new"]))


def entity_files(payload: Column, anchors: Column) -> Column:
    """payload.files if it has any, else payload.file, else the files of the anchors."""
    files = F.from_json(F.get_json_object(payload, "$.files"), "array<string>")
    file = F.get_json_object(payload, "$.file")
    return F.when(F.size(files) > 0, F.array_sort(F.array_distinct(files))).when(F.coalesce(file, F.lit("")) != "", F.array(file)).otherwise(anchor_files(anchors))


def kill_rate(killed: Column, total: Column) -> Column:
    return F.round(killed / F.nullif(total, F.lit(0)), 4)


def module_name(path: Column) -> Column:
    """Dotted module of a code file: its extension goes, and a package's own file (__init__, index) stands for its folder."""
    bare = F.regexp_replace(path, r"\.(py|tsx?|jsx?|mjs|cjs)$", "")
    own = F.when(path.endswith(".py"), F.lit("__init__")).otherwise(F.lit("index"))
    steps = F.filter(F.split(bare, "/"), lambda p: p != "")
    return F.array_join(F.when(F.try_element_at(steps, F.lit(-1)) == own, F.slice(steps, F.lit(1), F.size(steps) - 1)).otherwise(steps), ".")


def holds_tests(path: Column) -> Column:
    """True for the file names of tests in the language of the file."""
    return F.when(path.endswith(".py"), is_test_file(path)).otherwise(F.regexp_like(path, F.lit(r"\.(test|spec)\.[^/]*$")))


def is_test_file(path: Column) -> Column:
    """test_*.py or *_test.py by base name."""
    base = F.element_at(F.split(path, "/"), -1)
    return base.startswith("test_") | base.endswith("_test.py")


def is_test_component(files: Column) -> Column:
    """True if there are files and every one has a test's name."""
    return (F.size(files) > 0) & F.forall(files, lambda f: F.regexp_like(F.element_at(F.split(f, "/"), -1), F.lit(r"^test_|_test\.py$|\.test\.|\.spec\.")))


def issue_keys(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ISSUE_KEY), F.lit(1))))


def content_hash(*fields: Column) -> Column:
    """sha256 over canonical JSON of named fields; the caller names them in the order of their keys. Nulls stay."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def repo_lock_key(slug: Column) -> Column:
    return F.crc32(slug.cast("binary"))


def page_path(slug: Column) -> Column:
    return F.concat(slug, F.lit(".md"))


def embedding_text(entity_type: Column, name: Column, payload: Column) -> Column:
    """Type, name and the payload's non-empty texts in key order, one a line."""
    fields = F.from_json(payload, "map<string,string>")
    texts = F.transform(F.filter(F.array_sort(F.map_entries(fields)), lambda e: (F.coalesce(e["value"], F.lit("")) != "") & ~F.regexp_like(e["value"], F.lit(r"^([\[{]|-?[0-9.]+$|true$|false$)"))), lambda e: e["value"])
    return F.concat_ws("\n", F.replace(entity_type, F.lit("_"), F.lit(" ")), name, texts)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers; null if either is a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def prefixes(path: Column) -> Column:
    """Every dotted prefix of a path, the whole included, with its depth: array<struct<depth, prefix>>."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.concat_ws(".", F.slice(parts, 1, n)).alias("prefix")))


def proper_suffixes(path: Column) -> Column:
    """Every dotted suffix of a path but the whole."""
    parts = F.split(path, r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda k: F.concat_ws(".", F.slice(parts, k, n)))).otherwise(F.array().cast("array<string>"))


def iso_timestamp(text: Column) -> Column:
    return F.to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
