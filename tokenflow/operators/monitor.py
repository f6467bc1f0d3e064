"""Model-quality monitoring (N1-N6) over long metric frames
(model_name, version, metric, value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

METRICS = ["precision", "recall", "f1", "auc"]


@dataclass(frozen=True)
class Thresholds:
    # fixed default values (config defaults)
    precision_min: float = 0.70
    recall_min: float = 0.65
    f1_min: float = 0.67
    auc_min: float = 0.75
    relative_drop_max: float = 0.10


def thresholds_frame(spark: SparkSession, per_model: dict[str, Thresholds] | None = None,
                     default: Thresholds = Thresholds()) -> DataFrame:
    """THRESHOLDS dim: one row per (model_name, metric); model '*' = default."""
    rows = []
    for name, t in [("*", default), *((per_model or {}).items())]:
        for m in METRICS:
            rows.append((name, m, float(getattr(t, f"{m}_min")), float(t.relative_drop_max)))
    return spark.createDataFrame(rows, "model_name string, metric string, min_value double, relative_drop_max double")


def to_long(wide: DataFrame, keys=("model_name", "version")) -> DataFrame:
    """Wide metric columns -> (keys, metric, value); trainer names
    (auc_roc, *_macro) are mapped to the monitor's names (Q15 adapter)."""
    rename = {"auc_roc": "auc", "precision_macro": "precision", "recall_macro": "recall", "f1_macro": "f1"}
    w = wide
    for a, b in rename.items():
        if a in w.columns and b not in w.columns:
            w = w.withColumnRenamed(a, b)
    present = [m for m in METRICS if m in w.columns]
    return w.select(*keys, *[F.col(m).cast("double").alias(m) for m in present]).unpivot(
        list(keys), present, "metric", "value")


def threshold_violations(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Absolute check per (model, version, metric); a missing metric
    counts as 0; < min -> warning, < 0.9 * min -> critical. Metrics are
    completed against the 4 names first (small broadcast joins)."""
    mv = metrics.select("model_name", "version").distinct()
    grid = _grid(mv)
    m = grid.join(metrics, ["model_name", "version", "metric"], "left").withColumn(
        "value", F.coalesce("value", F.lit(0.0)))
    specific = thresholds.where(F.col("model_name") != "*")
    default = thresholds.where(F.col("model_name") == "*").drop("model_name")
    j = (m.join(F.broadcast(specific.withColumnRenamed("min_value", "_smin")
                            .withColumnRenamed("relative_drop_max", "_sdrop")), ["model_name", "metric"], "left")
          .join(F.broadcast(default.withColumnRenamed("min_value", "_dmin")
                            .withColumnRenamed("relative_drop_max", "_ddrop")), "metric", "left"))
    thr = F.coalesce("_smin", "_dmin")
    sev = (F.when(F.col("value") < thr * 0.9, "critical").when(F.col("value") < thr, "warning"))
    return j.select("model_name", "version", "metric", "metric_rank", "value", thr.alias("threshold"),
                    F.lit("absolute").alias("violation_type"), sev.alias("severity"),
                    F.coalesce("_sdrop", "_ddrop").alias("relative_drop_max")).where(F.col("severity").isNotNull())


def _grid(mv: DataFrame) -> DataFrame:
    """(model, version) x 4 metric names without a cross join: an array of
    the fixed names exploded per row."""
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(i).alias("metric_rank"))
                    for i, m in enumerate(METRICS)])
    return mv.select("*", F.inline(arr))


def relative_drop(metrics: DataFrame, production: DataFrame, max_drop: float = 0.10) -> DataFrame:
    """(prod - new) / prod > max_drop -> warning, for prod > 0; a
    missing candidate metric counts as 0."""
    p = production.select("model_name", "metric", F.col("value").alias("prod_value"))
    mv = metrics.select("model_name", "version").distinct()
    g = _grid(mv)
    j = (g.join(metrics, ["model_name", "version", "metric"], "left")
          .join(p, ["model_name", "metric"], "inner")
          .withColumn("value", F.coalesce("value", F.lit(0.0))))
    drop = (F.col("prod_value") - F.col("value")) / F.col("prod_value")
    return (j.where((F.col("prod_value") > 0) & (drop > max_drop))
             .select("model_name", "version", "metric", "metric_rank", "value",
                     F.col("prod_value").alias("threshold"), F.lit("relative").alias("violation_type"),
                     F.lit("warning").alias("severity")))


def overall(violations: DataFrame, checked: DataFrame) -> DataFrame:
    """Per (model, version): severity none / warning / critical, violated
    metric names in check order, recommendation text."""
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    order = F.when(F.col("violation_type") == "absolute", 0).otherwise(1) * 10 + F.col("metric_rank")
    v = violations.groupBy("model_name", "version").agg(
        F.max(rank).alias("_r"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("metric").alias("m")))),
                                 lambda x: x["m"]), ", ").alias("violated"),
        F.count("*").cast("bigint").alias("violation_count"))
    j = checked.select("model_name", "version").distinct().join(v, ["model_name", "version"], "left")
    r = F.coalesce("_r", F.lit(0))
    sev = F.when(r == 2, "critical").when(r == 1, "warning").otherwise("none")
    rec = (F.when(r == 0, F.lit("Model meets all performance thresholds. Safe to promote."))
           .when(r == 2, F.lit("CRITICAL: Model shows significant performance degradation. "
                               "Do not promote. Review training data and model configuration."))
           .otherwise(F.concat(F.lit("WARNING: Model shows degradation in: "), F.col("violated"),
                               F.lit(". Manual review required before promotion."))))
    return j.select("model_name", "version", sev.alias("severity"), (r > 0).alias("is_degraded"),
                    F.coalesce("violation_count", F.lit(0)).cast("bigint").alias("violation_count"),
                    F.coalesce("violated", F.lit("")).alias("violated_metrics"), rec.alias("recommendation"))


def check_models(metrics: DataFrame, thresholds: DataFrame, production: DataFrame | None = None) -> DataFrame:
    v = threshold_violations(metrics, thresholds).drop("relative_drop_max")
    if production is not None:
        v = v.unionByName(relative_drop(metrics, production))
    return overall(v, metrics)


def monitor_audit(result: DataFrame) -> DataFrame:
    """One audit row per check (count, names)."""
    return result.select(F.lit("model_check").alias("action"), "model_name", "version",
                         "violation_count", "violated_metrics", "severity")


def promotion_policy(result: DataFrame, metrics: DataFrame, production: DataFrame | None,
                     enabled: bool = True, require_thresholds: bool = True,
                     require_improvement: bool = False) -> DataFrame:
    """promotable = enabled and (thresholds met if required) and
    (f1 improved over production if required)."""
    ok = F.lit(enabled)
    if require_thresholds:
        ok = ok & ~F.col("is_degraded")
    out = result
    if require_improvement and production is not None:
        new = metrics.where(F.col("metric") == "f1").select("model_name", "version", F.col("value").alias("_new"))
        old = production.where(F.col("metric") == "f1").select("model_name", F.col("value").alias("_old"))
        out = out.join(new, ["model_name", "version"], "left").join(old, "model_name", "left")
        ok = ok & (F.coalesce("_old", F.lit(0.0)) < F.coalesce("_new", F.lit(0.0)))
        return out.withColumn("promotable", ok).drop("_new", "_old")
    return out.withColumn("promotable", ok)
