"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokenflow.session import checkpoint_dir, scratch_path

#: white space of the word contract: space, tab, LF, VT, FF, CR
SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any path that Spark can open)."""
    checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder of ``spark.checkpoint.dir`` and
    cut its lineage there: a lost executor costs a re-read, not a re-run, and
    later plans read the written rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def narrowed(df: DataFrame, rows: int, per_task: int = 100_000) -> DataFrame:
    """``df`` in no more partitions than ``rows`` rows need: a small table in
    the many partitions of a large one costs a file per partition in every
    exchange. Larger tables keep their partitions."""
    return df.coalesce(max(1, -(-rows // per_task)))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared folder: like ``cut``
    for wide rows, compressed and with column pruning on each later read."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, everything else unchanged."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null text: none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def doc_key(c: Column) -> Column:
    """Text of an id for hashing: null is the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; only the id of the file is in this
    repository, the file itself comes with the installed package."""
    import public_tokenizers
    return public_tokenizers.path(name)


def task_env() -> None:
    """Single-threaded native libraries inside tasks (one task per core)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
