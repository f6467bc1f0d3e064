"""Exact global percentile ranks (W1) and medians (A5) without a single-partition window.

pandas ``rank(pct=True)`` = average rank of ties / non-null count. A window
``ORDER BY value`` without PARTITION BY would pull every row into one task.
Instead:

1. aggregate to distinct values with their counts (map-side combine: a hot
   value is one row, whatever its frequency);
2. range-partition those distinct values and freeze the assignment with a
   reliable ``checkpoint()`` (in the shared ``spark.checkpoint.dir``), so
   partition ids and offsets always agree, also after a lost executor;
3. per-partition totals (one row per partition) -> prefix offsets, broadcast;
4. a window partitioned by the range id gives the running count inside a
   partition; offset + running count = rows strictly below the value;
5. join back on the value (AQE splits a skewed value on the row side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tokenflow.session import checkpoint_dir


def value_ranks(df: DataFrame, value_col: str, partitions: int | None = None) -> DataFrame:
    """(value, cnt, below, total) for every distinct non-null value."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    counts = (df.where(F.col(value_col).isNotNull()).groupBy(value_col)
                .agg(F.count("*").alias("_cnt")))
    ranged = (counts.repartitionByRange(n, value_col)
                    .withColumn("_pid", F.spark_partition_id())
                    .checkpoint(eager=True))
    per = ranged.groupBy("_pid").agg(F.sum("_cnt").alias("_pcnt"))
    w_off = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = (per.withColumn("_off", F.coalesce(F.sum("_pcnt").over(w_off), F.lit(0)))
               .withColumn("_total", F.sum("_pcnt").over(Window.partitionBy())))  # n rows only
    w_in = (Window.partitionBy("_pid").orderBy(value_col)
                  .rowsBetween(Window.unboundedPreceding, -1))
    return (ranged.join(F.broadcast(offs.select("_pid", "_off", "_total")), "_pid")
                  .withColumn("_below", F.col("_off") + F.coalesce(F.sum("_cnt").over(w_in), F.lit(0)))
                  .select(value_col, "_cnt", "_below", "_total"))


def average_percentile(df: DataFrame, value_col: str, out_col: str = "percentile",
                       partitions: int | None = None) -> DataFrame:
    """``out_col`` = (rows below + (ties + 1) / 2) / non-null rows * 100;
    NULL for a NULL value."""
    r = value_ranks(df, value_col, partitions)
    pct = ((F.col("_below").cast("double") + (F.col("_cnt").cast("double") + 1.0) / 2.0)
           / F.col("_total").cast("double") * 100.0)
    r = r.select(F.col(value_col).alias("_v"), pct.alias(out_col))
    return df.join(r, df[value_col] == r["_v"], "left").drop("_v")


def median(df: DataFrame, value_col: str, partitions: int | None = None) -> DataFrame:
    """One row ``median``: the exact interpolated median of the non-null
    values (null without any). An order statistic by counting: the two middle
    places are looked up in the running counts of the range partitions, so no
    task holds more than its range of distinct values."""
    r = value_ranks(df, value_col, partitions)
    lower, upper = (F.col("_total") - 1) / 2, F.col("_total") / 2  # places n - 1 and n halved: the middle one or two
    holds = [(F.col("_below") <= F.floor(p)) & (F.floor(p) < F.col("_below") + F.col("_cnt")) for p in (lower, upper)]
    picked = r.where(holds[0] | holds[1]).select(  # at most two rows
        F.when(holds[0], F.col(value_col)).alias("lo"), F.when(holds[1], F.col(value_col)).alias("hi"))
    return picked.agg((F.max("lo").cast("double") * 0.5 + F.max("hi").cast("double") * 0.5).alias("median"))
