"""Run history, audit listings and request rates over event logs
(R1, T2-T4, E6, W3, W4, S22). Row updates of the reference become "latest
state per key" aggregates over append-only events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tokenflow.session import checkpoint_dir

TERMINAL = ["completed", "failed", "partial"]  # `partial` accepted as terminal (Q33)
STATUSES = ["pending", "running", "completed", "failed", "cancelled", "partial"]
# fixed names: step outputs loaded from the newest completed run
ARTIFACTS = ["activity_breakdown", "holder_metrics", "time_series", "chain_metrics",
             "sov_predictions", "wallet_classifications"]


def run_state(events: DataFrame) -> DataFrame:
    """Per run: latest valid status, latest progress, completion time
    (last terminal status event), latest error, creation time. ``seq``
    breaks timestamp ties. All one partial-aggregating groupBy."""
    order = F.struct("ts", "seq")
    st = F.when(F.col("status").isin(*STATUSES), F.col("status"))
    return events.groupBy("run_id").agg(
        F.min("user_id").alias("user_id"),
        F.min("ts").alias("created_at"),
        F.max_by(st, F.when(st.isNotNull(), order)).alias("status"),
        F.max_by(F.col("progress"), F.when(F.col("progress").isNotNull(), order)).alias("progress"),
        F.max(F.when(F.col("status").isin(*TERMINAL), F.col("ts"))).alias("completed_at"),
        F.max_by(F.col("error"), F.when(F.col("error").isNotNull(), order)).alias("error_message"),
        F.count("*").cast("bigint").alias("events"))


def newest_per_key(df: DataFrame, keys: list[str], order_cols: list[str], limit: int = 50,
                   offset: int = 0) -> DataFrame:
    """Per key newest first, rows offset+1 .. offset+limit. The
    ``row_number() <= k`` filter lets Spark insert a partial per-partition
    group limit before the shuffle (WindowGroupLimit), so a hot key ships at
    most k rows per map partition."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_cols])
    return (df.withColumn("row_num", F.row_number().over(w))
              .where((F.col("row_num") > offset) & (F.col("row_num") <= offset + limit)))


def user_runs(runs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return newest_per_key(runs, ["user_id"], ["created_at", "run_id"], limit, offset)


def user_audit(audit: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return newest_per_key(audit, ["user_id"], ["timestamp", "log_id"], limit, offset)


def resource_audit(audit: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return newest_per_key(audit, ["resource_type", "resource_id"], ["timestamp", "log_id"], limit, offset)


def run_with_result(runs: DataFrame, results: DataFrame) -> DataFrame:
    """One left join instead of a lookup per run."""
    return runs.join(results.drop("user_id"), "run_id", "left")


def latest_run(runs: DataFrame, pipeline_col: str = "pipeline") -> DataFrame:
    """Newest run per pipeline and run count."""
    return runs.groupBy(pipeline_col).agg(
        F.max_by("run_id", F.struct("created_at", "run_id")).alias("latest_run_id"),
        F.max("created_at").alias("latest_created_at"),
        F.count("*").cast("bigint").alias("run_count"))


def latest_artifacts(runs: DataFrame, pipeline_col: str = "pipeline", base: str = "") -> DataFrame:
    """Newest *completed* run per pipeline -> its six artifact paths."""
    done = runs.where(F.col("status") == "completed")
    last = done.groupBy(pipeline_col).agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
    arr = F.array(*[F.lit(a) for a in ARTIFACTS])
    return last.select(pipeline_col, "run_id", F.explode(arr).alias("artifact")).withColumn(
        "path", F.concat(F.lit(base), F.col("run_id"), F.lit("/"), F.col("artifact")))


def request_rate(events: DataFrame, key: str = "user_id", ts: str = "ts",
                 window_seconds: int = 60, limit: int = 100, partitions: int | None = None) -> DataFrame:
    """Sliding-window request count per key for every event.

    Frame = events of the key in (ts - window, ts] (an event exactly one
    window old is outside). ``window_load`` gives the frame of every time at which
    the key has events; a key's timeline may span any number of tasks.

    allowed = earlier events in the frame < limit; remaining = limit -
    frame count when allowed else 0; retry_after = max(1, int(oldest +
    window - now) + 1) when refused. Unlike the live limiter, refused
    requests are counted too (rate report over the full log, Q28). Events without
    a key form one group; events without a time have null results."""
    e = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    load = window_load(e.select(F.col(key).alias("_key"), F.col("_us").alias("_at")), window_seconds * 1_000_000, partitions)
    r = e.join(load, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_us") == F.col("_at")), "left")
    allowed = (F.col("in_window") - 1) < limit
    retry = F.greatest(F.lit(1), F.floor((F.col("_free") - F.col("_us")) / F.lit(1_000_000)) + 1)
    return r.select(*events.columns, "in_window", allowed.alias("allowed"),
                    F.when(allowed, F.lit(limit) - F.col("in_window")).when(~allowed, 0).cast("bigint").alias("remaining"),
                    F.when(allowed, F.lit(0)).when(~allowed, retry).cast("bigint").alias("retry_after"))


def window_load(events: DataFrame, window_us: int, partitions: int | None = None) -> DataFrame:
    """(_key, _at, in_window, _free) for every time ``_at`` (microseconds) at which a
    key has events: the events in (_at - window, _at], and the time at which the
    oldest of them leaves.

    Every event is +1 at its time and -1 one window later; the count is the prefix
    sum of these differences, and the oldest event leaves at the next -1. Equal
    times are added up first, the differences are range-partitioned by (key, time) and
    frozen in the shared folder, sums run inside a range partition, and one row per
    (key, range partition) carries the totals over the borders. So a key with
    nearly all events is spread over all tasks."""
    steps = differences(events, window_us, partitions)
    leaves = F.when(F.col("_go") > 0, F.col("_at"))
    borders = steps.groupBy("_key", "_part").agg(F.sum(F.col("_come") - F.col("_go")).alias("_sum"), F.min(leaves).alias("_next"))
    before = Window.unboundedPreceding, -1
    across = Window.partitionBy("_key")  # at most one row per range partition
    borders = borders.select(F.col("_key").alias("_bkey"), F.col("_part").alias("_bpart"),
                             F.coalesce(F.sum("_sum").over(across.orderBy("_part").rowsBetween(*before)), F.lit(0)).alias("_carried"),
                             F.min("_next").over(across.orderBy(F.desc("_part")).rowsBetween(*before)).alias("_later"))
    inside = Window.partitionBy("_part", "_key")
    steps = steps.withColumns({
        "_run": F.sum(F.col("_come") - F.col("_go")).over(inside.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)),
        "_soon": F.min(leaves).over(inside.orderBy(F.desc("_at")).rowsBetween(*before))})  # running, not per-row, minimum
    return (steps.where("_come > 0").join(borders, F.col("_key").eqNullSafe(F.col("_bkey")) & (F.col("_part") == F.col("_bpart")))
            .select("_key", "_at", (F.col("_carried") + F.col("_run")).cast("bigint").alias("in_window"),
                    F.coalesce("_soon", "_later").alias("_free")))


def differences(events: DataFrame, window_us: int, partitions: int | None = None) -> DataFrame:
    """(_key, _at, _come, _go, _part): how many events come and leave at each
    time, dealt by ranges of (key, time) and frozen there."""
    spark = events.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    steps = events.where(F.col("_at").isNotNull()).select("_key", F.explode(F.array(
        F.struct(F.col("_at").alias("at"), F.lit(1).alias("come"), F.lit(0).alias("go")),
        F.struct((F.col("_at") + window_us).alias("at"), F.lit(0).alias("come"), F.lit(1).alias("go")))).alias("s"))
    return (steps.groupBy("_key", F.col("s.at").alias("_at")).agg(F.sum("s.come").alias("_come"), F.sum("s.go").alias("_go"))
             .repartitionByRange(n, "_key", "_at").withColumn("_part", F.spark_partition_id()).checkpoint(eager=True))
