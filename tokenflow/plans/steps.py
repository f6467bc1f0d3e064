"""Serialisable outputs of the four analysis steps: one JSON text (S16
rules: decimals as text, no NaN), or for the time series one JSON text per period row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tokenflow.operators import analytics as A, timeseries as TS
from tokenflow.sources.export import json_safe


def _map(rows: DataFrame, key: str, value: Column) -> Column:
    return F.map_from_entries(F.array_agg(F.struct(F.col(key), value)))


def activity_step(tx: DataFrame) -> DataFrame:
    """One row ``output``: counts, percentages, volumes and volume
    percentages by activity (A1; the enum has three values)."""
    b = A.activity_breakdown(tx)
    parts = {"counts": F.col("tx_count"), "percentages": F.col("count_pct"),
             "volumes": F.col("volume").cast("decimal(38,18)").cast("string"), "volume_percentages": F.col("volume_pct")}
    return b.agg(F.to_json(F.struct(*[_map(b, "activity_type", c).alias(n) for n, c in parts.items()])).alias("output"))


def holder_step(holders: DataFrame, top_n: int = 10) -> DataFrame:
    """One row ``output``: the metrics of A5, averages as text, and the top
    holders of T1 in order."""
    top = json_safe(A.top_holders_table(holders, top_n))
    fields = ["address", "balance", "stablecoin", "chain", "is_store_of_value"]
    listed = top.agg(F.transform(F.array_sort(F.array_agg(F.struct("rank", F.struct(*fields).alias("h")))), lambda x: x["h"]).alias("t"))
    m = A.holder_metrics(holders)
    texts = {c: F.col(c).cast("string") for c in ("avg_balance_sov", "avg_balance_active")}
    m = json_safe(m.withColumns(texts)).withColumn("top_holders", listed.scalar())
    return m.select(F.to_json(F.struct(*m.columns)).alias("output"))


def time_series_step(tx: DataFrame, aggregation: str = "daily") -> DataFrame:
    """One row ``output`` per period, activity and coin (A6): rows, not one document, since periods grow."""
    t = json_safe(TS.time_series(tx, aggregation))
    return t.select(F.to_json(F.struct(*t.columns)).alias("output"))


def chain_step(tx: DataFrame, holders: DataFrame | None = None) -> DataFrame:
    """One row ``output``: the metrics of A10 as a list in chain order."""
    c = A.by_chain(tx, holders)
    names = [x for x in c.columns if x != "chain_rank"]
    s = json_safe(c.select("chain_rank", *names))
    rows = F.transform(F.array_sort(F.array_agg(F.struct("chain_rank", F.struct(*names).alias("m")))), lambda x: x["m"])
    return s.agg(F.to_json(F.struct(rows.alias("chain_metrics"))).alias("output"))
