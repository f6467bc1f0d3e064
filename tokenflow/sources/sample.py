"""Seeded synthetic transfers / holders (S17) and their summary.

Values derive from ``xxhash64(id, seed, field)``, so they do not depend on
partitioning or task retries (``rand()`` would). The ids come from a
DataFrame (e.g. any table's key column), so the work scales with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tokenflow import dims
from tokenflow.schemas import AMOUNT, GAS_PRICE

EPOCH_2024 = 1704067200


def _u(idc, seed: int, salt: int):
    """uniform [0,1) from a hash."""
    return F.pmod(F.xxhash64(idc, F.lit(seed), F.lit(salt)), F.lit(1_000_000_007)).cast("double") / 1_000_000_007.0


def _hex(idc, seed, salt, n):
    h = F.concat(*[F.lpad(F.hex(F.xxhash64(idc, F.lit(seed), F.lit(salt), F.lit(i))), 16, "0") for i in range((n + 15) // 16)])
    return F.lower(F.substring(h, 1, n))


def sample_transactions(ids: DataFrame, id_col: str, seed: int = 42, n_addresses: int = 500,
                        days: int = 90, sov_share: float = 0.3) -> DataFrame:
    """Activity 60/30/10, 90 % with gas, addresses from a pool of
    ``n_addresses``, timestamps over ``days`` days from 2024-01-01."""
    i = F.col(id_col)
    u_act, u_gas = _u(i, seed, 1), _u(i, seed, 2)
    chain_idx = F.floor(_u(i, seed, 3) * 3).cast("int")
    chain = F.element_at(F.array(*[F.lit(c) for c in dims.CHAINS]), chain_idx + 1)
    coin = F.when(_u(i, seed, 4) < 0.5, "USDC").otherwise("USDT")
    frm = F.pmod(F.xxhash64(i, F.lit(seed), F.lit(5)), F.lit(n_addresses))
    to = F.pmod(F.xxhash64(i, F.lit(seed), F.lit(6)), F.lit(n_addresses))
    addr = lambda k: F.concat(F.lit("0x"), F.lpad(F.hex(k), 40, "0"))
    return ids.select(
        F.concat(F.lit("0x"), _hex(i, seed, 7, 64)).alias("transaction_hash"),
        (F.lit(18_000_000) + i).cast("bigint").alias("block_number"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + F.floor(_u(i, seed, 8) * days * 86400).cast("bigint")).alias("timestamp"),
        F.lower(addr(frm)).alias("from_address"), F.lower(addr(to)).alias("to_address"),
        (F.round(_u(i, seed, 9) * 100000, 6)).cast(AMOUNT).alias("amount"),
        coin.alias("stablecoin"), chain.alias("chain"),
        F.when(u_act < 0.6, "transaction").when(u_act < 0.6 + sov_share, "store_of_value")
         .otherwise("other").alias("activity_type"),
        dims.explorer_expr(chain).alias("source_explorer"),
        F.when(u_gas < 0.9, (F.lit(21000) + F.floor(_u(i, seed, 10) * 100000)).cast("bigint")).alias("gas_used"),
        F.when(u_gas < 0.9, (F.floor(_u(i, seed, 11) * 100) * 1e9).cast(GAS_PRICE)).alias("gas_price"))


def sample_summary(tx: DataFrame) -> DataFrame:
    """(kind, key, count, volume) for coins, activities and chains,
    zero-filled over the enums, in one GROUPING SETS pass."""
    spark = tx.sparkSession
    # three single-column grouping sets in one scan (Expand x3, partial aggregation)
    by = spark.sql("""
        SELECT CASE WHEN grouping(stablecoin) = 0 THEN 'stablecoin'
                    WHEN grouping(activity_type) = 0 THEN 'activity_type' ELSE 'chain' END AS kind,
               coalesce(stablecoin, activity_type, chain) AS key,
               CAST(count(*) AS BIGINT) AS count, sum(amount) AS volume
        FROM {t} GROUP BY GROUPING SETS ((stablecoin), (activity_type), (chain))""", t=tx)
    enum = spark.createDataFrame(
        [("stablecoin", c) for c in dims.STABLECOINS] + [("activity_type", a) for a in dims.ACTIVITY_TYPES]
        + [("chain", c) for c in dims.CHAINS], "kind string, key string")
    out = enum.join(by, ["kind", "key"], "full")
    return out.select("kind", "key", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
                      F.coalesce("volume", F.lit(0).cast("decimal(38,18)")).alias("volume"))
