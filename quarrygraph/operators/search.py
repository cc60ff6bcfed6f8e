"""Search: keyword match with BM25, exact nearest neighbours, reciprocal rank fusion, and what is left to embed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.functions import scalars as S

TOKEN = r"[^a-z0-9]+"
K1, B = 1.2, 0.75
RRF = 60


def parse(query: str) -> list[list[tuple[bool, tuple[str, ...]]]]:
    """A web-style query: alternatives (or) of terms that must all match; a term is (wanted, words), several words are a phrase, - excludes."""
    groups: list[list[tuple[bool, tuple[str, ...]]]] = [[]]
    for m in re.finditer(r'(-?)(?:"([^"]*)"|(\S+))', query.lower()):
        if m[3] == "or" and not m[1]:
            groups.append([])
            continue
        words = tuple(w for w in re.split(TOKEN, m[2] if m[2] is not None else m[3]) if w)
        if words:
            groups[-1].append((not m[1], words))
    return _spread([g for g in groups if g])


def _spread(groups: list) -> list:
    """`a or b -c`: exclusions hold for every alternative."""
    without = [t for g in groups for t in g if not t[0]]
    return [[t for t in g if t[0]] + without for g in groups if any(t[0] for t in g)]


def _occurrences(word: str) -> Column:
    return F.size(F.filter("_tokens", lambda t: t == word))


def match(docs: DataFrame, query: str) -> DataFrame:
    """docs(key, body) that match, with n_tokens and counts (word -> occurrences) of the query's words."""
    groups = parse(query)
    wanted = sorted({w for g in groups for _, words in g for w in words})
    tokens = F.filter(F.split(F.lower(F.coalesce("body", F.lit(""))), TOKEN), lambda t: t != "")
    listed = docs.withColumn("_tokens", tokens)
    joined = F.concat(F.lit(" "), F.array_join("_tokens", " "), F.lit(" "))
    has = lambda words: F.contains(F.col("_text"), F.lit(" " + " ".join(words) + " "))
    found = F.lit(False)
    for group in groups:
        every = F.lit(True)
        for want, words in group:
            every = every & (has(words) if want else ~has(words))
        found = found | every
    kept = listed.withColumn("_text", joined).where(found)
    counts = F.map_from_arrays(F.array(*[F.lit(w) for w in wanted]), F.array(*[_occurrences(w) for w in wanted])) if wanted else F.create_map().cast("map<string,int>")
    return kept.withColumn("counts", counts).withColumn("n_tokens", F.size("_tokens")).drop("_tokens", "_text")


def keyword(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """(key, score): the best matches by BM25, ties by key. Document frequencies and the mean length are those of all docs."""
    wanted = sorted({w for g in parse(query) for want, words in g if want for w in words})
    tokens = F.filter(F.split(F.lower(F.coalesce("body", F.lit(""))), TOKEN), lambda t: t != "")
    sized = docs.select(tokens.alias("t"))
    stats = sized.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("mean"), *[F.count_if(F.array_contains("t", w)).alias(f"df_{i}") for i, w in enumerate(wanted)]).alias("s")).scalar()
    score = F.lit(0.0)
    for i, w in enumerate(wanted):
        tf = F.coalesce(F.col("counts")[w], F.lit(0))
        df = F.col(f"_s.df_{i}")
        score = score + F.log(1 + (F.col("_s.n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tokens") / F.col("_s.mean")))
    return match(docs, query).withColumn("_s", stats).select("key", F.round(score, 8).alias("score")).orderBy(F.col("score").desc(), "key").limit(limit)


def nearest(vectors: DataFrame, query: DataFrame, limit: int) -> DataFrame:
    """(key, score): the rows of vectors(key, vector) closest to query's one vector by cosine, rounded to 6 places, ties by key."""
    one = query.select("vector").limit(1).scalar()
    scored = vectors.withColumn("_q", one).select("key", F.round(S.cosine(F.col("vector"), F.col("_q")), 6).alias("score"))
    return scored.where("score IS NOT NULL").orderBy(F.col("score").desc(), "key").limit(limit)


def fuse(branches: list[DataFrame], limit: int) -> DataFrame:
    """Reciprocal rank fusion of short ranked lists (key, score): sum of 1 / (60 + rank)."""
    ranked = None
    for branch in branches:
        rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "key"))  # a branch is a top-k list
        one = branch.select("key", (1.0 / (RRF + rank)).alias("part"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked.groupBy("key").agg(F.round(F.sum("part"), 8).alias("score")).orderBy(F.col("score").desc(), "key").limit(limit)


def hybrid(docs: DataFrame, vectors: DataFrame | None, query: str, query_vector: DataFrame | None, limit: int = 10) -> DataFrame:
    """Keyword and vector search fused; keyword alone where there are no current vectors. Each branch gives 2 * limit."""
    words = keyword(docs, query, 2 * limit)
    if vectors is None or query_vector is None or vectors.isEmpty():
        return fuse([words], limit)
    return fuse([words, nearest(vectors, query_vector, 2 * limit)], limit)


def backfill_todo(entities: DataFrame, stored: DataFrame, model_id: str, dirty: DataFrame | None = None) -> DataFrame:
    """entities(repo_id, slug, text_hash) without a current vector of this model and text, and the dirty ones among them."""
    current = stored.where((F.col("model_id") == model_id) & (F.col("status") == "current")).select("repo_id", "slug", F.col("content_hash").alias("text_hash"))
    return entities.join(current, ["repo_id", "slug", "text_hash"], "left_anti") if dirty is None else entities.join(current, ["repo_id", "slug", "text_hash"], "left_anti").unionByName(entities.join(dirty, ["repo_id", "slug"], "left_semi")).distinct()
