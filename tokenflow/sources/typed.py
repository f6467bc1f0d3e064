"""Typed TX / HOLDER from loosely typed input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenflow.functions import scalar as S
from tokenflow.schemas import GAS_PRICE, HOLDER, HOLDER_COLUMNS, TX, TX_COLUMNS


def with_holding_period_days(h: DataFrame) -> DataFrame:
    """Whole days last_activity - first_seen; 0 when either is null;
    negatives clamped to 0 (on exact microseconds, not calendar days)."""
    d = F.greatest(F.lit(0), S.whole_days_between("last_activity", "first_seen"))
    return h.withColumn("holding_period_days",
                        F.when(F.col("first_seen").isNull() | F.col("last_activity").isNull(), F.lit(0))
                        .otherwise(d).cast("bigint"))


def negative_periods(h: DataFrame) -> DataFrame:
    """Count of holders whose last activity precedes first_seen (clamped)."""
    return h.agg(F.count_if(F.col("last_activity") < F.col("first_seen")).cast("bigint")
                 .alias("negative_periods"))


def typed_tx(raw: DataFrame) -> DataFrame:
    """S3: all-string transfer records -> TX; bad amount / timestamp -> NULL.
    Use ``df.observe`` on ``amount is null`` to count bad amounts."""
    return raw.select(
        F.col("transaction_hash").cast("string"),
        F.col("block_number").try_cast("bigint").alias("block_number"),
        S.safe_timestamp("timestamp").alias("timestamp"),
        F.col("from_address").cast("string"), F.col("to_address").cast("string"),
        S.safe_decimal("amount").alias("amount"),
        "stablecoin", "chain", "activity_type", "source_explorer",
        F.col("gas_used").try_cast("bigint").alias("gas_used"),
        F.nullif(F.trim(F.col("gas_price")), F.lit("")).try_cast(GAS_PRICE).alias("gas_price"))


def typed_holders(raw: DataFrame) -> DataFrame:
    """All-string holder records -> HOLDER + holding_period_days."""
    h = raw.select(
        "address", S.safe_decimal("balance").alias("balance"), "stablecoin", "chain",
        S.safe_timestamp("first_seen").alias("first_seen"),
        S.safe_timestamp("last_activity").alias("last_activity"),
        (F.lower(F.col("is_store_of_value")) == "true").alias("is_store_of_value"),
        "source_explorer",
        F.coalesce(F.lower(F.col("is_sov_heuristic")) == "true", F.lit(False)).alias("is_sov_heuristic"))
    return with_holding_period_days(h)


def conform(df: DataFrame, schema) -> DataFrame:
    """Frame -> fixed schema; required columns are kept even when the
    input lacks them (typed NULL)."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def tx_frame(df: DataFrame) -> DataFrame:
    return conform(df, TX)


def holder_frame(df: DataFrame) -> DataFrame:
    return conform(df, HOLDER)


def empty_tx(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TX)


def empty_holders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], HOLDER)


__all__ = ["typed_tx", "typed_holders", "with_holding_period_days", "conform", "tx_frame",
           "holder_frame", "empty_tx", "empty_holders", "TX_COLUMNS", "HOLDER_COLUMNS"]
