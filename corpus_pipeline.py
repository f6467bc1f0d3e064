"""Corpus pipeline: raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows of its
predecessor; its result is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenflow.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from tokenflow.llm.common import table
from tokenflow.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; n_chars follows the
    text. A document that loses all its lines goes."""
    out = line_dedup.dedup(docs)
    gone = (F.col("line_dedup.n_removed") > 0) & (F.col("line_dedup.n_removed") == F.col("line_dedup.n_lines"))
    n_chars = F.when(F.col("line_dedup.n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~gone).withColumn("n_chars", n_chars).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs, with_ids=False)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: EM, suffix array, component and packing stages have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = scratch_path(spark, f"llm/pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
