"""A corpus pipeline: language ID, near-duplicate removal, secret redaction, source mixing, byte-level BPE.

Further columns pass through every stage but the last, whatever their names; empty tables give empty results. Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; stages before the last return
the columns of documents. A stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm import byte_bpe, language_id, mixing, near_dedup, secret_scan
from quarrygraph.llm.common import durable, read

#: No SQL twin: suffix automata, MinHash and a random forest are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a language of the labelled rows; the automata learn from rows that are not held out.

    Null texts, texts without a letter and texts of no known language go, of any size; equal rows are judged alike; where no row is
    labelled, no language is known and all rows go.
    """
    return language_id.accepted(docs, language_id.training_samples(docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the least doc_id, rows without an id last.

    Ties go to the least row digest, so reruns agree. Different texts that share a doc_id, or have none, are judged each on its
    own. Rows without a word are linked with nothing; of rows that are equal in every column one stays.
    """
    return near_dedup.unique(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets are replaced in their texts, and n_chars follows (null for a null text)."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them; a null source is a source of its own, and equal rows are taken alike."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of the mix, repeats included; a null text has no ids."""
    return byte_bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
