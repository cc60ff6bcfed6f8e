"""Line-first quality rules, in DataFrame and SQL operations only.

Each line of a text is judged alone: symbols, shouting, navigation, missing punctuation, one word over and over, and
boilerplate phrases. Failing lines are removed; then a document is rejected if it loses too much of its text, or
if the base rules of the whole text fail (too few words, too many words in repeated three-word windows).

Defined cases: null text counts as empty and fails the base rules; words are never cut, lines are the parts between
\\n; repeated rows are judged alike; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document must keep this percentage of its characters outside line ends.
MIN_KEPT_PERCENT = 60
SYMBOLS = r"[#*$%&|<>]"
#: Lower-case phrases of page furniture.
BOILERPLATE = r"cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here|subscribe (now|to our)|sign up for|javascript|lorem ipsum|powered by|share this|read more|log in to|zur startseite|tous droits réservés|todos los derechos"
SEPARATORS = r"[|»›•·>]"

#: Characters without which neither symbols, nor shouting marks, nor separators need counting.
ODD = r"[#*$%&|<>!?»›•·]"

#: True for a line that fails. The same text runs in Spark and DuckDB, with the counters of either filled in.
LINE_FAILS = """(
  {chars} > 0 AND (
    ({odd} AND (
      {symbols} * 10 > {solid}
      OR ({words} >= 3 AND {bangs} * 3 >= {words})
      OR ({words} >= 4 AND {seps} >= 3 AND {seps} * 5 >= {words})))
    OR ({words} >= 12 AND {unstopped})
    OR ({solid} >= 20 AND {capitals} * 10 > {solid} * 6)
    OR ({words} >= 10 AND {distinct_words} * 10 < {words} * 3)
    OR ({words} <= 40 AND {boiler})))"""


def _spark_count(line: str, pattern: str) -> str:
    return f"(length({line}) - length(regexp_replace({line}, r'{pattern}', '')))"


def good_lines_sql(lines: str) -> str:
    """Spark SQL for the lines of an array that don't fail; each line is split into words once."""
    line, words, trimmed = "x.l", "x.n", r"btrim(l, ' \u0009\u000A\u000B\u000C\u000D')"
    fails = LINE_FAILS.format(
        chars=f"length({line})", odd=f"{line} rlike r'{ODD}'", symbols=_spark_count(line, SYMBOLS), solid="x.s", words=words, bangs=_spark_count(line, "[!?]"), seps=_spark_count(line, SEPARATORS),
        capitals=_spark_count(line, r"\p{Lu}"), unstopped=f"NOT {line} rlike r'[.!?:;…。]'", distinct_words="size(array_distinct(x.w))", boiler=f"lower({line}) rlike r'{BOILERPLATE}'",
    )
    parts = rf"transform(transform({lines}, l -> struct(l AS l, split({trimmed}, r'[\x20\x09-\x0D]+') AS w)), y -> struct(y.l AS l, y.w AS w, IF(y.w[0] = '', 0, size(y.w)) AS n, length(regexp_replace(y.l, r'[\x20\x09-\x0D]+', '')) AS s))"
    return f"filter({parts}, x -> NOT {fails}).l"


def _repeat_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: the words within three-word windows found twice or more. Windows are compared by 64-bit hash."""
    hashed = rows.withColumn("_h", F.expr("transform(_words, w -> xxhash64(w))"))
    paired = hashed.withColumn("_t", F.expr("slice(zip_with(zip_with(_h, slice(_h, 2, greatest(size(_h), 1)), (a, b) -> xxhash64(a, b)), slice(_h, 3, greatest(size(_h), 1)), (p, c) -> xxhash64(p, c)), 1, greatest(size(_h) - 2, 0))"))
    ordered = paired.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_t)) = size(_t) THEN NULL ELSE sort_array(transform(_t, (h, i) -> struct(h, i))) END"))
    marked = ordered.withColumn("_p", F.expr("""
        sort_array(filter(zip_with(
            zip_with(_s, slice(_s, 2, size(_s)), (a, b) -> struct(a.h AS h, a.i AS i, coalesce(a.h = b.h, false) AS again)),
            slice(concat(array(named_struct('h', CAST(NULL AS BIGINT), 'i', CAST(NULL AS INT))), _s), 1, size(_s)),
            (a, b) -> IF(a.again OR coalesce(a.h = b.h, false), a.i, NULL)), x -> x IS NOT NULL))"""))
    counted = F.expr("coalesce(aggregate(zip_with(_p, slice(_p, 2, greatest(size(_p), 1)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (s, x) -> s + x), 0L)")
    return marked.withColumn("n_repeat_words", counted).drop("_h", "_t", "_s", "_p")


def judge(docs: DataFrame) -> DataFrame:
    """Every row's id, base counts, verdict and cleaned text: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines_removed, kept_percent, clean_text."""
    whole = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    split = whole.select("doc_id", "_text", F.expr(r"regexp_extract_all(_text, r'([^\x20\x09-\x0D]+)', 1)").alias("_words"), F.split("_text", "\n").alias("_lines"))
    lined = split.withColumn("_said", F.expr(r"filter(_lines, l -> l rlike r'[^\x20\x09-\x0D]')")).withColumn("_good", F.expr(good_lines_sql("_lines")))
    counted = _repeat_words(lined).select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_said") - F.size(F.array_distinct("_said"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.size("_lines") - F.size("_good")).cast("long").alias("lines_removed"),
        F.length(F.array_join("_good", "")).cast("long").alias("_left"),
        (F.length("_text") - F.size("_lines") + 1).cast("long").alias("_all"),
        F.array_join("_good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("_left") >= MIN_KEPT_PERCENT * F.col("_all"))).drop("_left", "_all")


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    count = lambda pattern: f"(length(l) - length(regexp_replace(l, '{pattern}', '', 'g')))"
    found = r"regexp_extract_all(l, '[^\x20\x09-\x0D]+')"
    fails = LINE_FAILS.format(
        chars="length(l)", odd=f"regexp_matches(l, '{ODD}')", symbols=count(SYMBOLS), solid=count(r"[^\x20\x09-\x0D]"), words=f"len({found})", bangs=count("[!?]"), seps=count(SEPARATORS), capitals=count(r"\p{Lu}"),
        unstopped="NOT regexp_matches(l, '[.!?:;…。]')", distinct_words=f"len(list_distinct({found}))", boiler=f"regexp_matches(lower(l), '{BOILERPLATE}')",
    )
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
tok AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM docs),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM tok)),
many AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM many, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
lines AS (SELECT rid, unnest(ls) AS l FROM tok),
judged AS (SELECT rid, sum(CASE WHEN {fails} THEN 0 ELSE length(l) END) AS good, sum(length(l)) AS total,
  count(*) FILTER (regexp_matches(l, '[^\x20\x09-\x0D]')) - count(DISTINCT l) FILTER (regexp_matches(l, '[^\x20\x09-\x0D]')) AS dup FROM lines GROUP BY rid),
base AS (SELECT tok.rid, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, good, total
  FROM tok JOIN judged USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * good >= {MIN_KEPT_PERCENT} * total) AS kept
FROM base
"""


ORACLE = _oracle()
