"""Per-wallet features and wallet labels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tokenflow.functions import scalar as S
from tokenflow.operators.rank import average_percentile, value_ranks
from tokenflow.schemas import FEATURES


def _ref(reference_time):
    return F.lit(reference_time).cast("timestamp")


def side_stats(tx: DataFrame) -> DataFrame:
    """Per lower-cased address, one pass over TX (each transfer exploded to
    its two ends, aggregated map-side before the shuffle):
    counts, exact decimal sums, sample std and first / last chain per side
    (two chains exactly if they differ). TX without a chain column has one.
    Chains are compared by 64-bit hashes: with fixed-size values only, the
    aggregate is a hash table, not a sort of all transfer ends."""
    if "chain" not in tx.columns:
        tx = tx.withColumn("chain", F.lit(""))
    chain = F.when(F.col("chain").isNotNull(), F.xxhash64("chain"))
    ends = tx.select(F.explode(F.array(
        F.struct(F.lower("from_address").alias("a"), F.lit(True).alias("out"),
                 F.col("amount").alias("amt"), chain.alias("ch")),
        F.struct(F.lower("to_address").alias("a"), F.lit(False).alias("out"),
                 F.col("amount").alias("amt"), chain.alias("ch")))).alias("e")).select("e.*")
    o, i = F.col("out"), ~F.col("out")
    return ends.groupBy("a").agg(
        F.count_if(o).alias("n_from"), F.count_if(i).alias("n_to"),
        F.sum(F.when(o, F.col("amt"))).alias("sum_from"), F.count(F.when(o, F.col("amt"))).alias("c_from"),
        F.sum(F.when(i, F.col("amt"))).alias("sum_to"), F.count(F.when(i, F.col("amt"))).alias("c_to"),
        F.stddev_samp(F.when(o, F.col("amt").cast("double"))).alias("std_from"),
        F.stddev_samp(F.when(i, F.col("amt").cast("double"))).alias("std_to"),
        (F.min(F.when(o, F.col("ch"))) != F.max(F.when(o, F.col("ch")))).alias("chains_from"),
        (F.min(F.when(i, F.col("ch"))) != F.max(F.when(i, F.col("ch")))).alias("chains_to"))


def holder_features(holders: DataFrame, tx: DataFrame | None, reference_time,
                    rank_partitions: int | None = None) -> DataFrame:
    """M1: the 8 features, one row per holder row.

    Missing holder columns take the reference's defaults (balance -> 50th
    percentile, dates -> 0 days); empty or absent TX -> zero activity."""
    ref = _ref(reference_time)
    h = holders.select("address", *[c for c in ("balance", "first_seen", "last_activity")
                                    if c in holders.columns])
    if "balance" in h.columns:
        h = average_percentile(h, "balance", "balance_percentile", rank_partitions)
    else:
        h = h.withColumn("balance_percentile", F.lit(50.0))
    for src, name in (("first_seen", "holding_period_days"), ("last_activity", "activity_recency_days")):
        if src in h.columns:
            h = h.withColumn(name, F.greatest(F.coalesce(S.fractional_days_between(ref, src), F.lit(0.0)),
                                              F.lit(0.0)))
        else:
            h = h.withColumn(name, F.lit(0.0))
    if tx is not None:
        st = side_stats(tx)
        h = h.withColumn("_a", F.lower("address")).join(st, F.col("_a") == st["a"], "left")
        mean_from = F.coalesce(F.col("sum_from").cast("double") / F.col("c_from").cast("double"), F.lit(0.0))
        mean_to = F.coalesce(F.col("sum_to").cast("double") / F.col("c_to").cast("double"), F.lit(0.0))
        h = h.select(
            "*",
            (F.coalesce("n_from", F.lit(0)) + F.coalesce("n_to", F.lit(0))).cast("bigint").alias("transaction_count"),
            F.when((mean_from > 0) & (mean_to > 0), (mean_from + mean_to) / 2.0)
             .otherwise(F.greatest(mean_from, mean_to)).alias("avg_transaction_size"),
            ((F.coalesce("std_from", F.lit(0.0)) + F.coalesce("std_to", F.lit(0.0))) / 2.0).alias("balance_volatility"),
            (F.coalesce("chains_from", F.lit(False)) | F.coalesce("chains_to", F.lit(False)))
            .cast("int").alias("cross_chain_flag"))
    else:
        h = h.select("*", F.lit(0).cast("bigint").alias("transaction_count"),
                     F.lit(0.0).alias("avg_transaction_size"), F.lit(0.0).alias("balance_volatility"),
                     F.lit(0).alias("cross_chain_flag"))
    h = h.withColumn("transaction_frequency", F.col("transaction_count").cast("double")
                     / F.greatest(F.col("holding_period_days"), F.lit(1.0)))
    return h.select("address", *FEATURES)


@dataclass(frozen=True)
class Thresholds:
    """Wallet taxonomy thresholds (defaults are the reference's v1.0)."""
    trader_frequency: float = 1.0
    trader_holding_max: float = 7.0
    holder_frequency: float = 0.1
    holder_holding_min: float = 30.0
    whale_percentile: float = 99.0
    taxonomy_version: str = "1.0"


def label_wallets(features: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """M3: whale > trader > holder > retail; missing columns default to
    frequency 0, holding 0, percentile 50."""
    def get(c, d):
        return F.col(c) if c in features.columns else F.lit(d)
    f, d, p = get("transaction_frequency", 0.0), get("holding_period_days", 0.0), get("balance_percentile", 50.0)
    whale = F.coalesce(p >= t.whale_percentile, F.lit(False))
    trader = F.coalesce((f > t.trader_frequency) & (d < t.trader_holding_max), F.lit(False))
    holder = F.coalesce((f < t.holder_frequency) & (d > t.holder_holding_min), F.lit(False))
    cls = (F.when(whale, "whale").when(trader, "trader").when(holder, "holder").otherwise("retail"))
    return features.withColumn("behavior_class", cls)


def class_weights(labeled: DataFrame, label_col: str = "behavior_class") -> DataFrame:
    """M4: weight = total / (classes x class count); (label, count, weight)."""
    g = labeled.groupBy(label_col).agg(F.count("*").alias("n"))
    from pyspark.sql import Window
    w = Window.partitionBy()  # over the handful of class rows
    return g.select(label_col, F.col("n").cast("bigint").alias("count"),
                    (F.sum("n").over(w).cast("double")
                     / (F.count("*").over(w) * F.col("n")).cast("double")).alias("weight"))


def with_weights(labeled: DataFrame, label_col: str = "behavior_class") -> DataFrame:
    """Attach the class weight as ``weight`` (broadcast of the few class rows)."""
    w = class_weights(labeled, label_col).select(label_col, "weight")
    return labeled.join(F.broadcast(w), label_col, "left")


def split(df: DataFrame, key: str = "address", test_size: float = 0.2, seed: int = 42,
          label: str | None = None) -> DataFrame:
    """M5: deterministic train/test flag, independent of partitioning.

    Rows are ordered by md5(key | seed); the first ``round(test_size * n)`` of
    each class of ``label`` are the test side (exactly, if keys are unique;
    rows of one key stay together). Without a label, or when the smallest
    class has fewer than max(2, ceil(1 / test_size)) rows, the whole frame is
    one class. Ranks come from the range-partitioned rank over (class, hash),
    so no class is gathered into one task."""
    hash_ = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    cls = F.lit("") if label is None else F.coalesce(F.col(label).cast("string"), F.lit(""))
    x = df.withColumn("_cls", cls).withColumn("_h", hash_)
    if label is not None:
        least = x.groupBy("_cls").count().agg(F.min("count")).first()[0]
        if least is not None and least < max(2, math.ceil(1 / test_size)):
            x = x.withColumn("_cls", F.lit(""))
    x = x.withColumn("_o", F.struct("_cls", "_h"))
    ranks = value_ranks(x, "_o")
    per = ranks.groupBy("_o._cls").agg(F.sum("_cnt").alias("_n"), F.min("_below").alias("_first"))
    test = (ranks.withColumn("_cls", F.col("_o._cls")).join(per, "_cls")
            .where(F.col("_below") - F.col("_first") < F.round(F.lit(test_size) * F.col("_n")))
            .select(F.col("_o._cls").alias("_tc"), F.col("_o._h").alias("_th"), F.lit(True).alias("_t")))
    out = x.join(test, (F.col("_cls") == F.col("_tc")) & (F.col("_h") == F.col("_th")), "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_t", F.lit(False)).alias("is_test"))


def feature_stats(features: DataFrame, cols=FEATURES) -> DataFrame:
    """(feature, mean, std, min, max) in one aggregation + unpivot."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    one = features.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__mean`, `{c}__std`, `{c}__min`, `{c}__max`" for c in cols)
    return one.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, mean, std, min, max)")
