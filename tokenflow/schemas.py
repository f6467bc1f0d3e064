"""Fixed schemas (nothing is inferred)."""

from pyspark.sql import types as T

AMOUNT = T.DecimalType(38, 18)
GAS_PRICE = T.DecimalType(38, 9)

TX = T.StructType([
    T.StructField("transaction_hash", T.StringType()),
    T.StructField("block_number", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("from_address", T.StringType()),
    T.StructField("to_address", T.StringType()),
    T.StructField("amount", AMOUNT),
    T.StructField("stablecoin", T.StringType()),
    T.StructField("chain", T.StringType()),
    T.StructField("activity_type", T.StringType()),
    T.StructField("source_explorer", T.StringType()),
    T.StructField("gas_used", T.LongType()),
    T.StructField("gas_price", GAS_PRICE),
])
TX_COLUMNS = [f.name for f in TX.fields]

HOLDER = T.StructType([
    T.StructField("address", T.StringType()),
    T.StructField("balance", AMOUNT),
    T.StructField("stablecoin", T.StringType()),
    T.StructField("chain", T.StringType()),
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_activity", T.TimestampType()),
    T.StructField("is_store_of_value", T.BooleanType()),
    T.StructField("source_explorer", T.StringType()),
    T.StructField("is_sov_heuristic", T.BooleanType()),
])
HOLDER_COLUMNS = [f.name for f in HOLDER.fields]

# Required columns of the frame conversions (object <-> frame).
TX_REQUIRED = TX_COLUMNS
HOLDER_REQUIRED = ["address", "balance", "stablecoin", "chain", "first_seen",
                   "last_activity", "is_store_of_value", "source_explorer"]

# Export document: every leaf read as string so that validation sees the raw
# text (V9) and typing is a separate, safe step.
_TX_STR = T.StructType([T.StructField(c, T.StringType()) for c in TX_COLUMNS])
_HOLDER_STR = T.StructType([T.StructField(c, T.StringType()) for c in HOLDER_COLUMNS])
DOC = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("run_id", T.StringType()),
        T.StructField("collection_timestamp", T.StringType()),
        T.StructField("agent_version", T.StringType()),
        T.StructField("explorers_queried", T.ArrayType(T.StringType())),
        T.StructField("total_records", T.StringType()),
        T.StructField("user_id", T.StringType()),
    ])),
    T.StructField("summary", T.StringType()),
    T.StructField("transactions", T.ArrayType(_TX_STR)),
    T.StructField("holders", T.ArrayType(_HOLDER_STR)),
    T.StructField("errors", T.ArrayType(T.StringType())),
])
TX_STRING = _TX_STR
HOLDER_STRING = _HOLDER_STR

# Raw explorer page: `result` is an array or a message string -> kept as text.
PAGE = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("result", T.StringType()),
])
RAW_TRANSFER = T.StructType([T.StructField(c, T.StringType()) for c in [
    "hash", "blockNumber", "timeStamp", "from", "to", "value", "gasUsed",
    "gasPrice", "contractAddress"]])
RAW_HOLDER = T.StructType([T.StructField(c, T.StringType()) for c in [
    "TokenHolderAddress", "TokenHolderQuantity"]])

SOURCE_RUN = T.StructType([
    T.StructField("source_explorer", T.StringType()),
    T.StructField("chain", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("seconds", T.DoubleType()),
])

FEATURES = ["transaction_count", "avg_transaction_size", "balance_percentile",
            "holding_period_days", "activity_recency_days",
            "transaction_frequency", "balance_volatility", "cross_chain_flag"]

RUN_EVENTS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("progress", T.DoubleType()),
    T.StructField("message", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
])
