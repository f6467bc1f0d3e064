"""Activity classification and holder store-of-value logic."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, functions as F

from tokenflow import dims
from tokenflow.functions import scalar as S


def classify_transactions(tx: DataFrame) -> DataFrame:
    """P6 on every row (pure projection)."""
    return tx.withColumn("activity_type",
                         S.classify_tx("from_address", "to_address", "amount"))


def _ts_lit(reference_time) -> F.Column:
    if isinstance(reference_time, F.Column):
        return reference_time
    if isinstance(reference_time, str):
        return F.lit(reference_time).cast("timestamp")
    return F.lit(reference_time).cast("timestamp")


def address_sides(tx: DataFrame) -> DataFrame:
    """(address, last_out, first_in) from one pass over TX: every transfer is
    exploded to its two ends, aggregated map-side, shuffled once."""
    ends = tx.select(
        F.explode(F.array(
            F.struct(F.lower("from_address").alias("address"), F.lit(True).alias("out"),
                     F.col("timestamp").alias("ts")),
            F.struct(F.lower("to_address").alias("address"), F.lit(False).alias("out"),
                     F.col("timestamp").alias("ts")))).alias("e")).select("e.*")
    return ends.groupBy("address").agg(
        F.max(F.when(F.col("out"), F.col("ts"))).alias("last_out"),
        F.min(F.when(~F.col("out"), F.col("ts"))).alias("first_in"))


def holding_period(holders: DataFrame, tx: DataFrame, reference_time,
                   out_col: str = "holding_period") -> DataFrame:
    """Whole days since the last outgoing transfer of the address, else
    since its first incoming one, else 0; never negative. Any coin/chain.

    Two aggregates fused into one (address_sides) + one left join, instead
    of a scan of all transfers per holder.
    """
    ref = _ts_lit(reference_time)
    sides = address_sides(tx).withColumnRenamed("address", "_akey")
    h = holders.withColumn("_akey", F.lower("address")).join(sides, "_akey", "left")
    days = (F.when(F.col("last_out").isNotNull(),
                   F.greatest(F.lit(0), S.whole_days_between(ref, "last_out")))
            .when(F.col("first_in").isNotNull(),
                  F.greatest(F.lit(0), S.whole_days_between(ref, "first_in")))
            .otherwise(F.lit(0)))
    return h.withColumn(out_col, days.cast("bigint")).drop("_akey", "last_out", "first_in")


def sov_heuristic(holders: DataFrame, tx: DataFrame, reference_time,
                  threshold_days: int = dims.STORE_OF_VALUE_DAYS,
                  keep_period: bool = False) -> DataFrame:
    """Store of value when the holding period is >= threshold (inclusive,
    as tested); sets both flags."""
    h = holding_period(holders, tx, reference_time, "_hp")
    flag = F.col("_hp") >= threshold_days
    h = h.withColumn("is_store_of_value", flag).withColumn("is_sov_heuristic", flag)
    return h.withColumnRenamed("_hp", "holding_period") if keep_period else h.drop("_hp")


def check_unique_predictions(predictions: DataFrame) -> None:
    dup = predictions.groupBy("address").count().where("count > 1").limit(1).collect()
    if dup:
        raise ValueError("Duplicate addresses in ML predictions")


def sov_ml_override(holders: DataFrame, predictions: DataFrame | None) -> DataFrame:
    """Replace the SoV flag by the ML prediction where the (case-sensitive)
    address matches. Accepts ``prediction`` or ``predicted_class``; missing
    columns leave holders unchanged; duplicate addresses raise."""
    if predictions is None:
        return holders
    pcol = ("prediction" if "prediction" in predictions.columns
            else "predicted_class" if "predicted_class" in predictions.columns else None)
    if pcol is None or "address" not in predictions.columns:
        return holders
    check_unique_predictions(predictions)
    p = predictions.select(F.col("address").alias("_paddr"),
                           F.col(pcol).cast("boolean").alias("_pred"))
    j = holders.join(p, holders["address"] == p["_paddr"], "left")
    return (j.withColumn("is_store_of_value",
                         F.coalesce(F.col("_pred"), F.col("is_store_of_value")))
             .drop("_paddr", "_pred"))
