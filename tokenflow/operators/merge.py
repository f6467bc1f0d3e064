"""Union, de-duplication, holder merge and the collection gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tokenflow import dims

ORDER = "ingest_key"


# D1 -----------------------------------------------------------------------
def union_sources(batches: list[DataFrame], order_col: str = ORDER) -> DataFrame:
    """UNION ALL of per-source batches in source order.

    ``ingest_key`` = struct(source_rank, within-source order). Every batch must
    carry its order column (e.g. file name + array position from S1/S5): scan
    order changes with file splits and retries. Where batches order by different types,
    the within-source order has one field per type and a batch fills its own, so
    every batch keeps its own order (9 before 10 in numbers).
    """
    for b in batches:
        if order_col not in b.columns:
            raise ValueError(f"union_sources needs an order column {order_col!r} in every batch")
    kinds = list(dict.fromkeys(b.schema[order_col].dataType for b in batches))
    parts = []
    for rank, b in enumerate(batches):
        own = b.schema[order_col].dataType
        inner = F.col(order_col) if len(kinds) == 1 else F.struct(*[
            (F.col(order_col) if k == own else F.lit(None).cast(k)).alias(f"k{i}") for i, k in enumerate(kinds)])
        parts.append(b.withColumn(order_col, F.struct(F.lit(rank).alias("source_rank"),
                                                      inner.alias("pos"))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# D2 -----------------------------------------------------------------------
def dedup_tx(tx: DataFrame, keys: tuple[str, ...] = ("transaction_hash", "chain"),
             extra_keys: tuple[str, ...] = (), order_col: str = ORDER,
             shuffle_first: bool = True) -> DataFrame:
    """Keep the first row (smallest ``ingest_key``) per (hash, chain).

    ``groupBy`` + ``min(order)`` / ``min_by(rest, order)`` aggregates map-side
    before the shuffle, so only one candidate per key and map partition
    crosses the network; ``dropDuplicates`` would keep an arbitrary row.
    Columns that are already fields of the order struct are not carried a
    second time. Callers with wide rows should dedup on compact keys and
    derive the wide columns afterwards (see ``sources.testdata``).

    ``shuffle_first`` hash-partitions on the keys before aggregating: the
    same single exchange the aggregate would add, but the (sort-based) first
    pick then runs in the post-shuffle tasks. Copies of one transfer arrive
    from different sources, i.e. different input partitions, so map-side
    pre-aggregation removes almost nothing; set False when copies are
    co-located in the input.
    """
    k = list(keys) + list(extra_keys)
    if order_col not in tx.columns:
        raise ValueError(f"dedup_tx needs an order column {order_col!r}")
    rest = [c for c in tx.columns if c not in k and c != order_col]
    aggs = [F.min(F.col(order_col)).alias(order_col)]
    if rest:
        aggs.append(F.min_by(F.struct(*rest), F.col(order_col)).alias("_first"))
    src = tx.repartition(*k) if shuffle_first else tx
    agg = src.groupBy(*k).agg(*aggs)
    return agg.select(*k, *[F.col(f"_first.{c}").alias(c) for c in rest], order_col).select(*tx.columns)


def duplicates_removed(raw: DataFrame, keys=("transaction_hash", "chain")) -> DataFrame:
    """One row: input rows, unique keys, removed duplicates."""
    return (raw.groupBy(*keys).agg(F.count("*").alias("n"))
            .agg(F.sum("n").cast("bigint").alias("input_rows"),
                 F.count("*").cast("bigint").alias("unique_rows"))
            .withColumn("duplicates_removed", F.col("input_rows") - F.col("unique_rows")))


# D3 -----------------------------------------------------------------------
def merge_holders(holders: DataFrame, order_col: str = ORDER) -> DataFrame:
    """Per (lower(address), coin, chain): max balance, null-ignoring min
    first_seen / max last_activity, OR of both SoV flags, address spelling
    of the first row, source names joined by ',' in first-appearance order.

    The source list is built from one row per (key, source) after a partial
    aggregation, so its length is bounded by the number of sources, never by
    the number of rows of a hot key.
    """
    h = holders
    if order_col not in h.columns:
        raise ValueError(f"merge_holders needs an order column {order_col!r}")
    key = [F.lower("address").alias("_akey"), "stablecoin", "chain"]
    h = h.select(*key, *[c for c in h.columns])
    k = ["_akey", "stablecoin", "chain"]
    per_src = (h.groupBy(*k, "source_explorer")
               .agg(F.min(order_col).alias("_sfirst"),
                    F.max("balance").alias("balance"),
                    F.min("first_seen").alias("first_seen"),
                    F.max("last_activity").alias("last_activity"),
                    F.bool_or(F.coalesce("is_store_of_value", F.lit(False))).alias("sov"),
                    F.bool_or(F.coalesce("is_sov_heuristic", F.lit(False))).alias("sovh"),
                    F.min_by("address", F.col(order_col)).alias("address")))
    merged = per_src.groupBy(*k).agg(
        F.min_by("address", F.col("_sfirst")).alias("address"),
        F.max("balance").alias("balance"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_activity").alias("last_activity"),
        F.bool_or("sov").alias("is_store_of_value"),
        F.bool_or("sovh").alias("is_sov_heuristic"),
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct(F.col("_sfirst").alias("o"), F.col("source_explorer").alias("s")))),
            lambda x: x["s"]), ",").alias("source_explorer"),
        F.sum(F.lit(1)).alias("_nsrc"))
    return merged.select("address", "balance", "stablecoin", "chain", "first_seen",
                         "last_activity", "is_store_of_value", "source_explorer",
                         "is_sov_heuristic")


# D4 -----------------------------------------------------------------------
def completeness(source_runs: DataFrame, expected_sources: int = 3) -> DataFrame:
    """One row: successful / expected ratio and the source name lists."""
    return source_runs.agg(
        F.count_if(F.col("success")).cast("bigint").alias("successful_sources"),
        F.lit(expected_sources).cast("bigint").alias("expected_sources"),
        (F.count_if(F.col("success")).cast("double") / F.lit(float(expected_sources)))
        .alias("completeness_ratio"),
        F.array_sort(F.collect_list(F.when(F.col("success"), F.col("source_explorer"))))
        .alias("successful"),
        F.array_sort(F.collect_list(F.when(~F.col("success"), F.col("source_explorer"))))
        .alias("failed"))


def completeness_gate(source_runs: DataFrame, data: DataFrame, min_sources: int = 2,
                      expected_sources: int = 3) -> DataFrame:
    """Raise when fewer than ``min_sources`` sources succeeded; otherwise only
    rows of successful sources flow on (left-semi join on the tiny
    SOURCE_RUN table, broadcast)."""
    row = completeness(source_runs, expected_sources).first()
    if row["successful_sources"] < min_sources:
        raise RuntimeError(
            f"Data completeness check failed: {row['successful_sources']}/"
            f"{expected_sources} sources succeeded, minimum {min_sources} required")
    ok = source_runs.where("success").select("source_explorer")
    return data.join(F.broadcast(ok), "source_explorer", "left_semi")


# D5 -----------------------------------------------------------------------
def collection_report(tx: DataFrame, holders: DataFrame, source_runs: DataFrame) -> DataFrame:
    """Per source: records (tx + holders), errors, failed = has errors and no
    records; plus run totals as columns."""
    recs = (tx.select("source_explorer").unionByName(holders.select("source_explorer"))
            .groupBy("source_explorer").agg(F.count("*").cast("bigint").alias("records")))
    runs = source_runs.select("source_explorer", "errors", "seconds")
    r = runs.join(recs, "source_explorer", "full").select(
        "source_explorer", F.coalesce("records", F.lit(0)).cast("bigint").alias("records"),
        F.coalesce(F.size("errors"), F.lit(0)).cast("bigint").alias("error_count"),
        F.coalesce("seconds", F.lit(0.0)).alias("seconds"))
    r = r.withColumn("failed", (F.col("error_count") > 0) & (F.col("records") == 0))
    w = Window.partitionBy()
    return (r.withColumn("total_records", F.sum("records").over(w).cast("bigint"))
             .withColumn("success", F.col("total_records") > 0))
