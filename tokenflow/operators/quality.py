"""Data-quality jobs (V6-V21): rule columns, quarantine split, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tokenflow import dims
from tokenflow.functions import rules as R
from tokenflow.operators.select import first_n

ERR = "errors"


def tx_record_errors(tx: DataFrame, reference_time=None, max_known: str | None = None) -> DataFrame:
    """V6 over raw (string) transfer records: one entry per failed field."""
    checks = [("transaction_hash", R.tx_hash_ok("transaction_hash")),
              ("from_address", R.address_ok("from_address")),
              ("to_address", R.address_ok("to_address")),
              ("amount", R.amount_ok("amount"))]
    if "block_number" in tx.columns:
        checks.append(("block_number", R.block_ok(F.col("block_number").try_cast("bigint"),
                                                  max_known)))
    if reference_time is not None and "timestamp" in tx.columns:
        checks.append(("timestamp", R.timestamp_ok(F.col("timestamp"), F.col("chain"), reference_time)))
    return tx.withColumn(ERR, R.errors_array(checks))


def holder_record_errors(h: DataFrame) -> DataFrame:
    """V6 over raw holder records: address and balance text."""
    return h.withColumn(ERR, R.errors_array([("address", R.address_ok("address")),
                                             ("balance", R.amount_ok("balance"))]))


def split_valid(df: DataFrame, errors_col: str = ERR):
    """(valid, quarantine, reject counts per field)."""
    valid = df.where(F.size(errors_col) == 0).drop(errors_col)
    quarantine = df.where(F.size(errors_col) > 0)
    counts = (quarantine.select(F.explode(errors_col).alias("field"))
              .groupBy("field").agg(F.count("*").cast("bigint").alias("rejected")))
    return valid, quarantine, counts


# V7 -------------------------------------------------------------------------
def required_tx(tx: DataFrame) -> DataFrame:
    ok = (R.nonempty("transaction_hash") & R.nonempty("from_address") & R.nonempty("to_address")
          & F.col("timestamp").isNotNull() & R.nonempty("stablecoin") & R.nonempty("chain"))
    return tx.where(ok)


def required_holder(h: DataFrame) -> DataFrame:
    ok = (R.nonempty("address") & R.nonempty("stablecoin") & R.nonempty("chain")
          & F.col("balance").isNotNull())
    return h.where(ok)


# V8 -------------------------------------------------------------------------
def tx_invariant_errors(tx: DataFrame) -> DataFrame:
    """Typed-TX constructor invariants as reasons."""
    return tx.withColumn(ERR, R.errors_array([
        ("transaction_hash", R.nonempty("transaction_hash")),
        ("from_address", R.nonempty("from_address")),
        ("to_address", R.nonempty("to_address")),
        ("block_number", F.coalesce(F.col("block_number") >= 0, F.lit(False))),
        ("amount", F.coalesce(F.col("amount") >= 0, F.lit(False))),
        ("gas_used", F.col("gas_used").isNull() | (F.col("gas_used") >= 0)),
        ("gas_price", F.col("gas_price").isNull() | (F.col("gas_price") >= 0)),
        ("stablecoin", F.coalesce(F.col("stablecoin").isin(*dims.STABLECOINS), F.lit(False))),
        ("chain", F.coalesce(F.col("chain").isin(*dims.CHAINS), F.lit(False))),
        ("activity_type", F.coalesce(F.col("activity_type").isin(*dims.ACTIVITY_TYPES_COLLECT),
                                     F.lit(False)))]))


def holder_invariant_errors(h: DataFrame) -> DataFrame:
    return h.withColumn(ERR, R.errors_array([
        ("address", R.nonempty("address")),
        ("balance", F.coalesce(F.col("balance") >= 0, F.lit(False))),
        ("stablecoin", F.coalesce(F.col("stablecoin").isin(*dims.STABLECOINS), F.lit(False))),
        ("chain", F.coalesce(F.col("chain").isin(*dims.CHAINS), F.lit(False))),
        ("last_activity", F.col("first_seen").isNull() | F.col("last_activity").isNull()
         | (F.col("first_seen") <= F.col("last_activity")))]))


# V9 -------------------------------------------------------------------------
ISO_RE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"


def export_tx_errors(records: DataFrame, pos_col: str = "pos") -> DataFrame:
    """V9 record rules over exploded export transactions (all strings):
    messages carry the array index and the field, never the value."""
    def msg(field, ok):
        return (field, ok)
    p = F.col(pos_col).cast("string")
    rules = [
        msg("transaction_hash", R.nonempty("transaction_hash")),
        msg("timestamp", F.coalesce(F.col("timestamp").rlike(ISO_RE), F.lit(False))),
        msg("from_address", R.nonempty("from_address")),
        msg("to_address", R.nonempty("to_address")),
        msg("amount", F.coalesce(F.col("amount").try_cast("decimal(38,18)") >= 0, F.lit(False))),
        msg("stablecoin", F.coalesce(F.col("stablecoin").isin(*dims.STABLECOINS), F.lit(False))),
        msg("chain", F.coalesce(F.col("chain").isin(*dims.CHAINS), F.lit(False))),
        msg("activity_type", F.coalesce(F.col("activity_type").isin(*dims.ACTIVITY_TYPES), F.lit(False))),
        msg("block_number", F.coalesce(F.col("block_number").rlike(r"^[0-9]+$"), F.lit(False))),
        msg("source_explorer", R.nonempty("source_explorer")),
        msg("gas_used", F.col("gas_used").isNull() | F.col("gas_used").rlike(r"^[0-9]+$")),
        msg("gas_price", F.col("gas_price").isNull()
            | F.coalesce(F.col("gas_price").try_cast("decimal(38,18)") >= 0, F.lit(False))),
    ]
    arr = F.array_compact(F.array(*[F.when(~ok, F.concat(F.lit("transactions["), p, F.lit(f"].{f}: invalid")))
                                    for f, ok in rules]))
    return records.withColumn(ERR, arr)


def export_holder_errors(records: DataFrame, pos_col: str = "pos") -> DataFrame:
    p = F.col(pos_col).cast("string")
    fs = F.try_to_timestamp(F.col("first_seen"))
    la = F.try_to_timestamp(F.col("last_activity"))
    rules = [
        ("address", R.nonempty("address")),
        ("balance", F.coalesce(F.col("balance").try_cast("decimal(38,18)") >= 0, F.lit(False))),
        ("stablecoin", F.coalesce(F.col("stablecoin").isin(*dims.STABLECOINS), F.lit(False))),
        ("chain", F.coalesce(F.col("chain").isin(*dims.CHAINS), F.lit(False))),
        ("is_store_of_value", F.coalesce(F.lower("is_store_of_value").isin("true", "false"), F.lit(False))),
        ("source_explorer", R.nonempty("source_explorer")),
        ("first_seen", F.coalesce(F.col("first_seen").rlike(ISO_RE), F.lit(False))),
        ("last_activity", F.coalesce(F.col("last_activity").rlike(ISO_RE), F.lit(False))
         & F.coalesce(la >= fs, F.lit(True))),
    ]
    arr = F.array_compact(F.array(*[F.when(~ok, F.concat(F.lit("holders["), p, F.lit(f"].{f}: invalid")))
                                    for f, ok in rules]))
    return records.withColumn(ERR, arr)


# V10 ------------------------------------------------------------------------
def assert_writable(df: DataFrame, required: list[str]) -> DataFrame:
    """Before-write check: required keys present (plan time) and non-null
    (lazy ``raise_error`` inside a filter: fails the write job)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required fields: {missing}")
    bad = None
    for c in required:
        cond = F.col(c).isNull()
        bad = cond if bad is None else bad | cond
    return df.where(F.coalesce(F.when(bad, F.raise_error(F.lit("required field is null"))),
                               F.lit(True)))


#: fixed values: required fields of an export, by section
SECTIONS = {
    "metadata": ["run_id", "collection_timestamp", "agent_version", "explorers_queried", "total_records"],
    "summary": ["kind", "key", "count", "volume"],
    "transactions": ["transaction_hash", "block_number", "timestamp", "from_address", "to_address", "amount", "stablecoin",
                     "chain", "activity_type", "source_explorer"],
    "holders": ["address", "balance", "stablecoin", "chain", "first_seen", "last_activity", "is_store_of_value", "source_explorer"],
}
METADATA_TYPES = {"run_id": ("a string", T.StringType), "collection_timestamp": ("a string", T.StringType),
                  "explorers_queried": ("a list", T.ArrayType), "total_records": ("an integer", T.IntegralType)}


def section_problems(sections: dict[str, DataFrame]) -> list[str]:
    """What is wrong with the sections of an export before anything is written:
    missing sections and fields, types of the metadata (all from schemas, no
    job), and missing parts of the summary."""
    out = [f"Missing '{s}' section" for s in SECTIONS if s not in sections]
    for name, required in SECTIONS.items():
        if name in sections:
            out += [f"{name}: missing field {c}" for c in required if c not in sections[name].columns]
    meta = sections.get("metadata")
    if meta is not None:
        out += [f"'{c}' must be {what}" for c, (what, kind) in METADATA_TYPES.items()
                if c in meta.columns and not isinstance(meta.schema[c].dataType, kind)]
    summary = sections.get("summary")
    if summary is not None and "kind" in summary.columns:
        kinds = {r[0] for r in summary.where(F.col("kind").isin(SUMMARY_PARTS)).select("kind").distinct().collect()}
        out += [f"Missing summary field by_{k}" for k in SUMMARY_PARTS if k not in kinds]
    return out


def validate_before_write(sections: dict[str, DataFrame], nullable: tuple[str, ...] = ("first_seen", "last_activity")) -> dict[str, DataFrame]:
    """Raise on the first look at schemas and summary, and return record
    sections that fail the write job if a required field is null (one pass, while writing)."""
    problems = section_problems(sections)
    if problems:
        raise ValueError("; ".join(problems))
    return {name: assert_writable(df, [c for c in SECTIONS[name] if c not in nullable]) if name in ("transactions", "holders") else df
            for name, df in sections.items()}


def missing_required(df: DataFrame, required: list[str]) -> DataFrame:
    """(field, missing) for every required field: rows in which it is null, or
    all rows if there is no such column; one pass."""
    n = df.agg(F.count("*").cast("bigint").alias("_rows"), *[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in required if c in df.columns])
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c if c in df.columns else "_rows").alias("missing"))
                                        for c in required])).alias("m")).select("m.*")


# V18 / V20 / V21 -------------------------------------------------------------
def invalid_enum_rows(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Non-strict V18: rows whose value is outside the enum (left-anti join
    against the literal enum table)."""
    spark = df.sparkSession
    e = spark.createDataFrame([(v,) for v in allowed], f"{column} string")
    return df.where(F.col(column).isNotNull()).join(F.broadcast(e), column, "left_anti")


def class_filter(df: DataFrame, classes: list[str]) -> DataFrame:
    return df.where(F.col("behavior_class").isin(*classes))


def run_filters(tx: DataFrame, sources: list[str] | None = None, coins: list[str] | None = None,
                max_records: int | None = None, order_cols=("block_number", "timestamp")) -> DataFrame:
    """Per-run source and coin filters and the newest ``max_records``
    per (source, coin) (the explorer returns newest first), by cut-off keys:
    no source or coin is gathered in one task."""
    out = tx
    if sources:
        out = out.where(F.col("source_explorer").isin(*sources))
    if coins:
        out = out.where(F.col("stablecoin").isin(*coins))
    if max_records is not None:
        out = first_n(out, ["source_explorer", "stablecoin"],
                      [*[(c, False) for c in order_cols], ("transaction_hash", True)], max_records)
    return out


#: fixed values: the parts that a run's summary must have
SUMMARY_PARTS = ["stablecoin", "activity_type", "chain"]


def export_summary_errors(summary: DataFrame) -> DataFrame:
    """V9/V10 rules on a run's summary rows (kind, key, count, volume): one
    ``error`` row per missing part, negative count or negative volume."""
    spark = summary.sparkSession
    parts = spark.createDataFrame([(k,) for k in SUMMARY_PARTS], "kind string")
    missing = parts.join(summary.select("kind").distinct(), "kind", "left_anti").select(
        F.concat(F.lit("summary.by_"), "kind", F.lit(": missing")).alias("error"))
    bad = [summary.where(~F.coalesce(F.col(c) >= 0, F.lit(False))).select(
        F.concat(F.lit("summary.by_"), "kind", F.lit("."), "key", F.lit(f".{c}: invalid")).alias("error"))
        for c in ("count", "volume")]
    return missing.unionByName(bad[0]).unionByName(bad[1])


def export_metadata_errors(meta: DataFrame) -> DataFrame:
    """V9 document rules on the metadata row of each export: required fields,
    ISO collection time, integer non-negative total_records, explorers list
    present; messages name the field only."""
    rules = [
        ("metadata.run_id", R.nonempty("run_id")),
        ("metadata.collection_timestamp",
         F.coalesce(F.col("collection_timestamp").rlike(ISO_RE), F.lit(False))),
        ("metadata.agent_version", R.nonempty("agent_version")),
        ("metadata.explorers_queried", F.col("explorers_queried").isNotNull()),
        ("metadata.total_records",
         F.coalesce(F.col("total_records").cast("string").rlike(r"^[0-9]+$"), F.lit(False))),
    ]
    arr = F.array_compact(F.array(*[F.when(~ok, F.concat(F.lit(f"{f}: "), F.lit("missing or invalid")))
                                    for f, ok in rules]))
    return meta.withColumn(ERR, arr)
