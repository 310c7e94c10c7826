"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet below the
shared folder and gives the reread table to the next stage. All stages but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickloom.llm import decontaminate, exact_dedup, pieces, quality, simhash
from clickloom.llm.common import table, tuned
from clickloom.session import stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    tuned(spark)
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest doc_id stays."""
    tuned(spark)
    return simhash.dedup(docs, words=3, bits=2)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids, and the text that these decode to."""
    tuned(spark)
    return pieces.encode_decode(docs)


STAGES = [
    ("good_quality", good_quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_free", benchmark_free),
    ("token_ids", token_ids),
]

# neither a trained classifier nor SimHash can be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
