"""Time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tokenflow.functions import scalar as S
from tokenflow.functions.frames import attach_scalars
from tokenflow.operators.analytics import require_columns

PERIODS = ["daily", "weekly", "monthly"]


def _check(aggregation: str) -> None:
    if aggregation not in PERIODS:
        raise ValueError(f"Invalid aggregation '{aggregation}'. Must be one of: {PERIODS}")


def time_series(tx: DataFrame, aggregation: str = "daily",
                keys: tuple[str, ...] = ("activity_type", "stablecoin"),
                week_start: str = "tuesday", sort: bool = False) -> DataFrame:
    """By (period, *keys): count of non-null timestamps and volume.
    Rows with a null key (incl. null timestamp) are dropped, as pandas
    groupby does. ``sort`` adds a global ``orderBy(period)`` (a range
    shuffle) -- leave it off unless the consumer needs ordered output."""
    _check(aggregation)
    require_columns(tx, {"timestamp", "amount", *keys})
    df = tx.withColumn("period", S.period_bucket("timestamp", aggregation, week_start))
    cond = F.col("period").isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    out = (df.where(cond).groupBy("period", *keys)
             .agg(F.count("timestamp").cast("bigint").alias("transaction_count"),
                  F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(38,18)")).alias("volume")))
    return out.orderBy("period", *keys) if sort else out


def time_series_totals(tx: DataFrame, aggregation: str = "daily") -> DataFrame:
    """The A6 series plus overall count (all rows) and volume as columns,
    for the conservation check (totals can exceed the series: Q9)."""
    series = time_series(tx, aggregation)
    tot = tx.agg(F.count("*").cast("bigint").alias("total_count"),
                 F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(38,18)")).alias("total_volume"))
    return attach_scalars(series, tot)


def ts_by_activity(tx: DataFrame, aggregation: str = "daily") -> DataFrame:
    """A8."""
    return time_series(tx, aggregation, ("activity_type",))


def ts_by_stablecoin(tx: DataFrame, aggregation: str = "daily") -> DataFrame:
    """A9."""
    return time_series(tx, aggregation, ("stablecoin",))


def ts_all_levels(tx: DataFrame, aggregation: str = "daily") -> DataFrame:
    """A6 + A8 + A9 in one scan and one shuffle: GROUPING SETS over
    (period, activity, coin), (period, activity), (period, coin).
    ``level`` names the grouping set."""
    _check(aggregation)
    df = (tx.withColumn("period", S.period_bucket("timestamp", aggregation))
            .where(F.col("period").isNotNull()))
    return tx.sparkSession.sql("""
        SELECT CASE WHEN grouping(activity_type) = 0 AND grouping(stablecoin) = 0 THEN 'activity_coin'
                    WHEN grouping(activity_type) = 0 THEN 'activity' ELSE 'coin' END AS level,
               period, activity_type, stablecoin,
               CAST(count(timestamp) AS BIGINT) AS transaction_count,
               coalesce(sum(amount), CAST(0 AS DECIMAL(38,18))) AS volume
        FROM {src}
        GROUP BY GROUPING SETS ((period, activity_type, stablecoin), (period, activity_type),
                                (period, stablecoin))
        HAVING (grouping(activity_type) = 1 OR activity_type IS NOT NULL)
           AND (grouping(stablecoin) = 1 OR stablecoin IS NOT NULL)""", src=df)


def ts_summary(series: DataFrame) -> DataFrame:
    """A18 over an A8 series: distinct periods, total count and volume, peak
    period by summed count (earliest on ties) and its count."""
    per = series.groupBy("period").agg(F.sum("transaction_count").alias("cnt"))
    peak = per.agg(
        F.count("*").cast("bigint").alias("total_periods"),
        F.max_by(F.col("period"), F.struct(F.col("cnt"), (-F.unix_date("period")).alias("e")))
        .alias("peak_period"),
        F.max("cnt").cast("bigint").alias("peak_count"))
    tot = series.agg(F.coalesce(F.sum("transaction_count"), F.lit(0)).cast("bigint").alias("total_transactions"),
                     F.coalesce(F.sum("volume"), F.lit(0).cast("decimal(38,18)")).alias("total_volume"))
    return attach_scalars(peak, tot)
