"""Small fixed dimension tables (enums, decimals, contracts, genesis).

All of these are a handful of rows: they are built from literals and are
safe to broadcast (their size does not grow with the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# --- fixed values (must equal the reference's for equal results) ---------
ACTIVITY_TYPES = ["transaction", "store_of_value", "other"]
ACTIVITY_TYPES_COLLECT = ["transaction", "store_of_value", "other", "unknown"]
STABLECOINS = ["USDC", "USDT"]
CHAINS = ["ethereum", "bsc", "polygon"]
EXPLORERS = {"ethereum": "etherscan", "bsc": "bscscan", "polygon": "polygonscan"}
DEFAULT_EXPLORER = "etherscan"
ZERO_ADDRESS = "0x0000000000000000000000000000000000000000"
# token decimals per (chain, coin); unknown coin -> 18
TOKEN_DECIMALS = [("ethereum", "USDC", 6), ("ethereum", "USDT", 6),
                  ("bsc", "USDC", 18), ("bsc", "USDT", 18),
                  ("polygon", "USDC", 6), ("polygon", "USDT", 6)]
DEFAULT_DECIMALS = 18
# chain genesis, unix seconds
GENESIS = {"ethereum": 1438269973, "bsc": 1598671449, "polygon": 1590824836}
# token contracts per (coin, chain), as configured
CONTRACTS = [
    ("USDC", "ethereum", "0xA0b86991c6218b36c1d19D4a2e9Eb0cE3606eB48"),
    ("USDC", "bsc", "0x8AC76a51cc950d9822D68b83fE1Ad97B32Cd580d"),
    ("USDC", "polygon", "0x2791Bca1f2de4661ED88A30C99A7a9449Aa84174"),
    ("USDT", "ethereum", "0xdAC17F958D2ee523a2206206994597C13D831ec7"),
    ("USDT", "bsc", "0x55d398326f99059fF775485246999027B3197955"),
    ("USDT", "polygon", "0xc2132D05D31c914a87C6611C10748AEb04B58e8F"),
]
BEHAVIOR_CLASSES = ["trader", "holder", "whale", "retail"]
STORE_OF_VALUE_DAYS = 30
# ------------------------------------------------------------------------


def _rank_map(values: list[str]):
    """`array_position`-style rank column builder for a fixed order (built
    lazily: columns need an active session)."""
    return lambda c: F.array_position(F.array(*[F.lit(v) for v in values]), c)


chain_rank = _rank_map(CHAINS)
activity_rank = _rank_map(ACTIVITY_TYPES)
coin_rank = _rank_map(STABLECOINS)


def activities(spark: SparkSession, values: list[str] | None = None) -> DataFrame:
    vals = values or ACTIVITY_TYPES
    return spark.createDataFrame([(v, i) for i, v in enumerate(vals)],
                                 "activity_type string, activity_rank int")


def chains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i, EXPLORERS[c]) for i, c in enumerate(CHAINS)],
                                 "chain string, chain_rank int, explorer string")


def stablecoins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(STABLECOINS)],
                                 "stablecoin string, coin_rank int")


def chain_activity_grid(spark: SparkSession) -> DataFrame:
    """The complete (chain, activity) grid as literal rows (9 rows)."""
    rows = [(c, ci, a, ai) for ci, c in enumerate(CHAINS)
            for ai, a in enumerate(ACTIVITY_TYPES)]
    return spark.createDataFrame(rows, "chain string, chain_rank int, "
                                       "activity_type string, activity_rank int")


def coin_activity_grid(spark: SparkSession) -> DataFrame:
    rows = [(c, ci, a, ai) for ci, c in enumerate(STABLECOINS)
            for ai, a in enumerate(ACTIVITY_TYPES)]
    return spark.createDataFrame(rows, "stablecoin string, coin_rank int, "
                                       "activity_type string, activity_rank int")


def token_decimals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOKEN_DECIMALS, "chain string, stablecoin string, decimals int")


def genesis(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GENESIS.items()), "chain string, genesis_epoch long")


def contracts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTRACTS, "stablecoin string, chain string, contract string")


def sources(spark: SparkSession) -> DataFrame:
    rows = [(EXPLORERS[c], c, i, True) for i, c in enumerate(CHAINS)]
    return spark.createDataFrame(rows, "source_explorer string, chain string, "
                                       "source_rank int, enabled boolean")


def explorer_expr(chain_col):
    """Chain -> explorer, default etherscan."""
    m = F.create_map(*[x for kv in EXPLORERS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(m[chain_col], F.lit(DEFAULT_EXPLORER))
