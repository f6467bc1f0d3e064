"""End-to-end compositions (lifecycles L1-L3) of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenflow import dims
from tokenflow.session import checkpoint_dir


def select_sources(spark: SparkSession, explorers: list[str] | None = None,
                   coins: list[str] | None = None) -> DataFrame:
    """Enabled sources, optional source / coin filter, symbol -> contract
    per chain. Output (source_explorer, chain, stablecoin, contract): a few
    rows, broadcast by callers."""
    s = dims.sources(spark).where("enabled")
    if explorers:
        s = s.where(F.col("source_explorer").isin(*explorers))
    c = dims.contracts(spark)
    if coins:
        c = c.where(F.col("stablecoin").isin(*coins))
    return s.join(c, "chain").select("source_explorer", "chain", "stablecoin", "contract")


def analysis_pipeline(spark: SparkSession, tx: DataFrame, holders: DataFrame, reference_time,
                      aggregation: str = "daily") -> dict[str, DataFrame]:
    """Classification, SoV heuristic, the four analysis steps and the
    features of one run, as DataFrames sharing one canonical TX
    (cached by the caller if reused across many actions). The holders with their flags and
    the features, which several outputs read, are computed once and kept in the shared folder."""
    from tokenflow.operators import analytics as A, classify as CL, features as FE, timeseries as TS
    from tokenflow.sources.typed import with_holding_period_days
    tx = CL.classify_transactions(tx)
    checkpoint_dir(spark)
    h = with_holding_period_days(CL.sov_heuristic(holders, tx, reference_time)).checkpoint(eager=True)
    feats = FE.holder_features(h, tx, reference_time).checkpoint(eager=True)
    return {"activity_breakdown": A.activity_breakdown(tx), "holder_metrics": A.holder_metrics(h),
            "top_holders": A.top_holders(h), "time_series": TS.time_series(tx, aggregation),
            "chain_metrics": A.by_chain(tx, h), "features": feats,
            "wallet_labels": FE.label_wallets(feats).select("address", "behavior_class")}


def write_outputs(spark: SparkSession, outputs: dict[str, DataFrame], base: str, run_id: str) -> DataFrame:
    """Write every output below ``base/<name>/run_id=<id>``; returns
    (output, rows) read back from what was written."""
    from functools import reduce
    parts = []
    for name, df in outputs.items():
        path = f"{base}/{name}/run_id={run_id}"
        df.write.mode("overwrite").parquet(path)
        parts.append(spark.read.parquet(path).agg(F.count("*").cast("bigint").alias("rows"))
                     .select(F.lit(name).alias("output"), "rows"))
    return reduce(DataFrame.unionByName, parts)
