"""The corpus pipeline: from documents to the token ids of a mixed, deduplicated and redacted corpus.

Each stage takes (spark, docs, sf_dir) and gives the rows that the next one reads, written as Parquet in between; all but the
last return the columns of documents. Rows without doc_id pass through; null texts stay null until they are encoded as nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketlens.llm import bpe, minhash, mixing, pii, toxicity
from basketlens.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects; it learns from the labels of these documents."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of texts that five-word shingles link at a similarity of 0.8 or more."""
    return minhash.without_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows them."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the target weights of their sources."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, decoded again as a check: (doc_id, n_tokens, ids, exact)."""
    return bpe.checked(docs)


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_duplicates), ("personal data", redact), ("mixing", mix), ("encoding", encode)]

#: No SQL: models are fitted and merges are applied on the way; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
