"""A training corpus from raw documents: quality rules, near-duplicate removal, secret
redaction, mixing to target weights, and token ids.

Every stage takes what the one before kept, written as Parquet, and all but the last return the
columns of ``documents``. Stages decide by row: rows that repeat, share a doc_id or have none are
rows of their own. An empty table gives empty stages, whole texts are used however long, and extra
columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, quality, secretscan, simhash, triebpe
from quarry.llm.common import read, ready, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the current quality policy rejects; null, empty and short texts are
    among them. Equal rows share a verdict."""
    ready(spark)
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every SimHash component (three-word shingles, two bits): the smallest doc_id,
    null last, then the first row. All texts without a word are one component."""
    ready(spark)
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the spans of secrets by their kinds; a null text stays null, equal texts change alike."""
    ready(spark)
    return secretscan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops rows as the mix takes them, each by its own place in its source's queue; null
    is a source, a text without a word is never taken, ties are queued by doc_id, size and row."""
    ready(spark)
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row; a null or empty text has no token."""
    ready(spark)
    return triebpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing", mix),
    ("BPE encoding", tokens),
]

#: Byte-pair encoding and redaction have no SQL form; tests/llm checks the rows instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(ready(spark), sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out.write.parquet(f"{folder}/{k}")
            out = spark.read.parquet(f"{folder}/{k}")
        docs = out
    return docs
