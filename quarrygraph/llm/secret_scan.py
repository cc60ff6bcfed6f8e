"""Secret scanning with a random forest that removes false positives; scanning and scoring in DataFrame operations only.

Candidates are all runs of 16 key characters or more, private-key blocks and known key formats, found word by
word; a word may hold several. Each has features: its length, how often the kind of character changes, its share of distinct characters, digits
and hexadecimal characters, how much of it dictionary words cover, its vowels and how often a vowel and a consonant alternate, whether its path (source) speaks of tests or examples, and
whether the neighbouring words speak of keys or of harmless values. A random forest trained on labelled findings scores
candidates; its trees become one SQL expression, so scoring stays in generated code.

Labelled findings are a table (candidate, before, after, path, label) that the caller gives; `findings_of` makes one from labelled lines, and
`evaluate` scores a forest on findings that it has not seen. The default ones are made from a rule, of LABELLED_ROWS rows.

Findings never hold the secret itself but its digest and a masked form; redaction replaces every place of it in its text.

Defined cases: null text has no findings; a null source is a path without hints; repeated rows each have their findings;
an empty table gives an empty result; other columns pass through redaction, whatever their names; whole texts are scanned, words never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

MIN_LENGTH = 16
TREES, DEPTH, SEED = 20, 6, 11
THRESHOLD = 0.5
LABELLED_ROWS = 4000
NEIGHBOURS = 3
REDACTED = "[REDACTED]"
#: Words that speak for harmless values inside a candidate.
DICTIONARY = ("example", "sample", "dummy", "test", "token", "secret", "password", "passwd", "placeholder", "change", "your", "here", "insert", "replace", "fake", "mock", "demo", "default", "key", "api", "access", "user", "admin", "value", "string", "config", "version", "release", "build", "license", "http", "https", "www", "com", "org", "net", "html", "mail", "page", "index", "image", "file", "name", "path", "data", "time", "date", "abc", "xyz", "xxxx", "0000", "1234", "lorem", "ipsum", "the", "and", "tion", "ing", "ment")
#: Neighbouring words that speak of keys, or of harmless values.
KEY_WORDS = "token|secret|passw|passwd|pwd|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private|client[_-]?secret|signing"
CALM_WORDS = r"\b(commit|sha[0-9]*|md5|checksum|digest|hash|uuid|guid|revision|etag|version|order|invoice|phone|card|isbn|example|sample|placeholder)\b"
TEST_PATHS = "test|spec|example|sample|fixture|mock|demo|docs?/"
#: Known key formats (fixed values, as their issuers publish them), also where punctuation follows.
FORMATS = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*|glpat-[A-Za-z0-9_-]{20,})[.\-/+=]*$"
CORE = r"([A-Za-z0-9_+/.\-]{16,}=*)"
#: A key block, cut at its BEGIN mark: up to the END mark or, without one, headers and the key lines that follow. Line ends may be escaped.
_HEAD = r"^[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_KEY_LINE = r"[A-Za-z0-9+/]{16,}|[A-Za-z+/]{0,15}[0-9+/=][A-Za-z0-9+/=]{0,15}(?![A-Za-z0-9+/=.,:;\-])"
PEM = rf"{_HEAD}(?s:.*?)-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
PEM_OPEN = rf"{_HEAD}(?:(?:\\+[rn]|\s){{0,8}}(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID): ?[^\r\n\\]*){{0,8}}(?:\\+[rn]|\s){{1,8}}(?={_KEY_LINE})[A-Za-z0-9+/=\s\\]*?(?=\z|[^A-Za-z0-9+/=\s\\]|(?:\\+[rn]|\s)\s*+(?!\\+[rn]|{_KEY_LINE}))"
FEATURES = ("f_length", "f_changes", "f_distinct", "f_digits", "f_hex", "f_upper", "f_dictionary", "f_format", "f_key_word", "f_calm_word", "f_test_path", "f_assigned", "f_vowels", "f_turns")


def feature_columns(candidate: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """The forest's features, named as in FEATURES."""
    low = F.lower(before)
    share = lambda pattern: (F.length(candidate) - F.length(F.regexp_replace(candidate, pattern, ""))) / F.length(candidate)
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))
    changes = F.size(F.regexp_extract_all(candidate, F.lit(r"([a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9]))"), F.lit(1)))
    covered = F.length(F.regexp_replace(F.lower(candidate), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))
    found = [
        F.least(F.length(candidate), F.lit(200)).cast("double"),
        changes / F.greatest(F.length(candidate) - 1, F.lit(1)),
        F.size(F.array_distinct(F.split(candidate, ""))) / F.least(F.length(candidate), F.lit(64)),
        share("[0-9]"),
        share("[0-9a-f]"),
        share("[A-Z]"),
        1 - covered / F.length(candidate),
        flag(candidate.rlike(FORMATS) | candidate.startswith("-----BEGIN")),
        flag(low.rlike(KEY_WORDS)),
        flag(F.concat_ws(" ", low, F.lower(after)).rlike(CALM_WORDS)),
        flag(F.lower(F.coalesce(path, F.lit(""))).rlike(TEST_PATHS)),
        flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        share("[aeiouAEIOU]"),
        F.size(F.regexp_extract_all(candidate, F.lit("([aeiouAEIOU][b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])"), F.lit(1))) / F.length(candidate),
    ]
    return [c.cast("double").alias(name) for name, c in zip(FEATURES, found, strict=True)]


def default_findings(spark: SparkSession, rows: int = LABELLED_ROWS) -> DataFrame:
    """Labelled findings from a rule: random keys after words of keys are secrets; digests, numbers, slugs and placeholders are not."""
    k = F.col("id")
    hexa = lambda salt: F.sha2(F.concat(k.cast("string"), F.lit(salt)), 512)
    mixed = lambda salt: F.regexp_replace(F.base64(F.unhex(hexa(salt))), "[+/=]", "x")
    n = lambda low, span: (F.lit(low) + k % span).cast("int")
    pick = lambda words, step: F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(k / step) % len(words) + 1).cast("int"))
    filler = pick(("and then the", "with of for", "", "is set to", "de la que", "der die und"), 5)
    key = F.concat(filler, F.lit(" "), pick(("token =", "api_key =", "secret:", "password =", "TOKEN =", "access_key:", "auth_token ="), 7))
    calm = F.concat(filler, F.lit(" "), pick(("commit", "sha1", "md5:", "order", "checksum", "uuid =", "version", "phone"), 7))
    plain = F.concat(filler, F.lit(" "), pick(("then", "with", "see", "from", "the"), 3))
    number = F.substring(F.concat(*[F.lpad(F.crc32(F.concat(k.cast("string"), F.lit(i)).cast("binary")).cast("string"), 10, "7") for i in range(3)]), F.lit(1), n(16, 8))
    slug = F.concat_ws("-", *[pick(DICTIONARY, s) for s in (1, 2, 3, 11)], (k % 90 + 10).cast("string"))
    uuid = F.regexp_replace(F.substring(hexa("u"), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    holder = F.concat(pick(("YOUR_API_KEY_HERE_", "example_token_value_", "replace_with_secret_", "xxxxxxxxxxxxxxxx", "test_password_0000_"), 2), (k % 1000).cast("string"))
    # Words that can be spoken: a consonant and a vowel by turns.
    said = lambda i: F.translate(F.substring(hexa(f"w{i}"), F.lit(1), F.lit(2) * (k % 3 + 2 + i % 2).cast("int")), "0123456789abcdef", "bacedifogulanesi")
    spoken = F.concat(said(0), said(1), said(2), said(3))
    kinds = [
        (F.substring(hexa("a"), F.lit(1), n(24, 41)), key, F.lit("")), (F.substring(mixed("b"), F.lit(1), n(20, 44)), key, F.lit("")), (F.concat(F.lit("AKIA"), F.upper(F.substring(mixed("c"), F.lit(1), F.lit(16)))), F.when(k % 2 == 0, key).otherwise(plain), F.lit("")),
        (F.concat(F.lit("ghp_"), F.substring(mixed("d"), F.lit(1), F.lit(36))), F.when(k % 2 == 0, key).otherwise(plain), F.lit("")), (F.upper(F.substring(hexa("e"), F.lit(1), n(24, 41))), key, F.lit("")),
        (F.substring(hexa("f"), F.lit(1), pick((32, 40, 64), 13).cast("int")), calm, F.lit("")), (F.substring(hexa("h"), F.lit(1), pick((32, 40, 64), 13).cast("int")), key, F.lit("")), (number, F.when(k % 3 == 0, key).otherwise(plain), F.lit("")), (slug, F.when(k % 2 == 0, key).otherwise(plain), F.lit("")), (uuid, F.when(k % 2 == 0, calm).otherwise(plain), F.lit("")), (holder, key, F.lit("")),
        (F.substring(hexa("g"), F.lit(1), n(24, 41)), key, F.lit("tests/fixtures/")), (F.concat(slug, F.lit("."), F.lit("example.com")), plain, F.lit("")),
        (F.substring(F.translate(mixed("i"), "0123456789", "qWzKxVjGhP"), F.lit(1), n(20, 44)), key, F.lit("")), (spoken, F.when(k % 3 == 0, key).otherwise(plain), F.lit("")), (F.regexp_replace(F.initcap(F.concat_ws(" ", said(0), said(1), said(2))), " ", ""), F.when(k % 3 == 0, key).otherwise(plain), F.lit("")),
        (F.concat_ws("/", said(0), said(1), said(2), said(3)), F.when(k % 3 == 0, key).otherwise(plain), F.lit("")), (F.concat_ws("_", F.upper(said(0)), F.upper(said(1)), F.upper(said(2))), F.when(k % 3 == 0, key).otherwise(plain), F.lit("")), (F.concat_ws("-", said(0), said(1), said(2)), plain, F.lit("")),
    ]
    shape = k % len(kinds)
    choose = lambda part: F.coalesce(*[F.when(shape == i, kind[part]) for i, kind in enumerate(kinds)])
    return spark.range(0, rows, 1, 4).select(choose(0).alias("candidate"), choose(1).alias("before"), F.lit("").alias("after"), choose(2).alias("path"), F.when((shape < 5) | (shape == 6) | (shape == 13), 1.0).otherwise(0.0).alias("label"))


def fit_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH):
    """A random forest over FEATURES from labelled findings (candidate, before, after, path, label); their number is the caller's bound."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(findings.select("label", *feature_columns(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, subsamplingRate=0.8, featureSubsetStrategy="4").fit(rows.select("features", "label"))


def forest_sql(model, at: str = "") -> str:
    """The forest's probability of a secret as a SQL expression over FEATURES (fields of `at`, if given): the mean of its trees' leaves."""

    def leaf(node) -> str:
        stats = list(node.impurityStats().stats())
        return repr(stats[1] / sum(stats))

    def tree(node) -> str:
        if node.subtreeDepth() == 0:
            return leaf(node)
        split = node.split()
        return f"IF({at}{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D, {tree(node.leftChild())}, {tree(node.rightChild())})"

    roots = [t._call_java("rootNode") for t in model.trees]
    return "(" + " + ".join(f"CAST({tree(r)} AS DOUBLE)" for r in roots) + f") / {len(roots)}"


def findings_of(labelled: DataFrame) -> DataFrame:
    """Labelled findings from labelled lines (text, source, secret): every candidate of a line, labelled 1 if it is the line's secret (null: the line has none)."""
    each = with_candidates(labelled).select(F.explode("_near").alias("x"), F.col("row.source").alias("path"), F.col("row.secret").alias("_secret"))
    return each.select("x.candidate", "x.before", "x.after", "path", F.when(F.coalesce(F.col("x.candidate") == F.col("_secret"), F.lit(False)), 1.0).otherwise(0.0).alias("label"))


def evaluate(model, findings: DataFrame, threshold: float = THRESHOLD) -> dict[str, int]:
    """How a forest fares on labelled findings: secrets found and missed, and harmless candidates reported and left alone."""
    rows = findings.select("label", *feature_columns(F.col("candidate"), F.col("before"), F.col("after"), F.col("path")))
    said = rows.select((F.col("label") > 0).alias("real"), (F.round(F.expr(forest_sql(model)), 6) >= threshold).alias("told")).groupBy("real", "told").count().collect()
    counts = {(r["real"], r["told"]): r["count"] for r in said}
    return {name: counts.get(at, 0) for name, at in (("found", (True, True)), ("missed", (True, False)), ("reported", (False, True)), ("left_alone", (False, False)))}


def with_candidates(docs: DataFrame) -> DataFrame:
    """(row, _near): every row of docs as one struct, so that no name can clash, and its candidates as an array of (at, candidate, before, after); at is the number of the candidate's word, -1 for a key block."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    text = F.col("_text")
    # A text without sixteen key characters in a row can't hold a candidate.
    likely = rows.withColumn("_words", F.when(text.rlike(r"[A-Za-z0-9_+/.\-]{16}"), F.split(text, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))
    # Every run of a word, with the word's parts around the runs: split and extract_all agree run by run.
    runs = r"regexp_extract_all(w, r'[A-Za-z0-9_+/.\-]{16,}=*', 0)"
    cut = rf"transform(_words, (w, i) -> IF(length(w) >= 16, struct(CAST(i AS BIGINT) AS at, {runs} AS runs, split(w, r'[A-Za-z0-9_+/.\-]{{16,}}=*', -1) AS gaps), NULL))"
    # A run's name is the gap before it or, where that has no letter (NAME=value, "name":"value"), also the run and the gap before.
    named = "concat(IF(k > 0 AND NOT x.gaps[k] rlike '[A-Za-z]', concat(x.gaps[k - 1], x.runs[k - 1]), ''), x.gaps[k])"
    hits = rf"flatten(transform(filter({cut}, x -> size(x.runs) > 0), x -> transform(x.runs, (r, k) -> struct(x.at AS at, r AS candidate, {named} AS name))))"
    placed = likely.withColumn("_hits", F.expr(hits))
    near = rf"""transform(_hits, x -> struct(x.at AS at, x.candidate AS candidate,
        concat_ws(' ', slice(_words, CAST(greatest(x.at - {NEIGHBOURS}, 0) + 1 AS INT), CAST(least(x.at, {NEIGHBOURS}) AS INT)), x.name) AS before,
        concat_ws(' ', slice(_words, CAST(x.at + 2 AS INT), {NEIGHBOURS})) AS after))"""
    pieces = F.transform(F.filter(F.split(text, "-----BEGIN ", -1), lambda p, i: i > 0), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, PEM, 0), F.lit("")), F.regexp_extract(p, PEM_OPEN, 0)))
    keys = F.when(text.contains("PRIVATE KEY"), F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.concat(F.lit("-----BEGIN "), p))).otherwise(F.array().cast("array<string>"))
    blocks = F.transform(keys, lambda b: F.struct(F.lit(-1).cast("long").alias("at"), b.alias("candidate"), F.lit("").alias("before"), F.lit("").alias("after")))
    return placed.select("row", F.concat(F.expr(near), blocks).alias("_near"))


def with_features(docs: DataFrame) -> DataFrame:
    """(row, _found): the candidates of with_candidates as (at, candidate, f_...)."""
    path = F.col("row.source").cast("string")
    featured = F.transform("_near", lambda x: F.struct(x["at"].alias("at"), x["candidate"].alias("candidate"), *feature_columns(x["candidate"], x["before"], x["after"], path)))
    return with_candidates(docs).select("row", featured.alias("_found"))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every candidate with its features and probability; is_secret where that is at least the threshold. `secret` is for redaction, not for reports."""
    spark = docs.sparkSession
    model = fit_forest(default_findings(spark) if findings is None else findings)
    each = with_features(docs.select("doc_id", "text", "source")).where(F.size("_found") > 0).select("row.doc_id", F.explode("_found").alias("_one")).select("doc_id", "_one.*")
    scored = each.withColumn("probability", F.round(F.expr(forest_sql(model)), 6))
    return scored.select("doc_id", "at", F.col("candidate").alias("secret"), *FEATURES, "probability", (F.col("probability") >= threshold).alias("is_secret"))


def report(found: DataFrame) -> DataFrame:
    """Findings without the secrets: digest, masked form and length."""
    masked = F.concat(F.substring("secret", 1, 4), F.lit("…"))
    return found.select("doc_id", "at", F.sha2(F.col("secret").cast("binary"), 256).alias("secret_sha256"), masked.alias("masked"), F.length("secret").cast("long").alias("n_chars"), "probability", "is_secret")


def redact(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every place of a text's own secrets replaced, longest first; each row is scored where it stands, without a join."""
    spark = docs.sparkSession
    model = fit_forest(default_findings(spark) if findings is None else findings)
    secrets = F.expr(f"array_distinct(filter(_found, y -> round({forest_sql(model, 'y.')}, 6) >= {threshold}).candidate)")
    known = with_features(docs).select("row", secrets.alias("_secrets"))
    clean = F.expr(f"IF(size(_secrets) = 0 OR row.text IS NULL, row.text, aggregate(array_sort(_secrets, (a, b) -> length(b) - length(a)), row.text, (t, s) -> replace(t, s, '{REDACTED}')))")
    return known.select(*[clean.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(read(spark, sf_dir, "documents")))
