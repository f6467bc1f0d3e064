"""The named step outputs of a run, written with a manifest and loaded
from the newest completed run with a declared schema per artifact."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tokenflow.operators.history import ARTIFACTS

MANIFEST = "artifact string, path string, rows long, columns array<string>"
#: columns (and kinds of type) that a loaded artifact must have
SCHEMAS = {
    "activity_breakdown": {"activity_type": "string", "tx_count": "integral", "volume": "number"},
    "holder_metrics": {"total_holders": "integral", "sov_count": "integral", "median_holding_period_days": "number"},
    "time_series": {"period": "date", "activity_type": "string", "stablecoin": "string", "transaction_count": "integral", "volume": "number"},
    "chain_metrics": {"chain": "string", "transaction_count": "integral", "total_volume": "number", "sov_ratio": "number"},
    "sov_predictions": {"address": "string", "sov_probability": "number", "predicted_class": "boolean"},
    "wallet_classifications": {"address": "string", "behavior_class": "string"},
}
_KINDS = {"string": T.StringType, "integral": T.IntegralType, "number": T.NumericType, "date": T.DateType, "boolean": T.BooleanType}


class LoadedArtifacts(NamedTuple):
    run_id: str
    frames: dict[str, DataFrame]  # the artifacts that could be loaded
    problems: dict[str, str]  # why the others could not


def write_artifacts(spark: SparkSession, base: str, run_id: str, frames: dict[str, DataFrame]) -> None:
    """``<base>/run_id=<id>/<artifact>`` and, last, the manifest of what was written."""
    unknown = set(frames) - set(ARTIFACTS)
    if unknown:
        raise ValueError(f"unknown artifacts: {sorted(unknown)}")
    rows = []
    for name, df in frames.items():
        path = f"{base}/run_id={run_id}/{name}"
        df.write.mode("overwrite").parquet(path)
        rows.append((name, name, spark.read.parquet(path).count(), df.columns))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{base}/run_id={run_id}/_manifest")


def schema_problem(df: DataFrame, declared: dict[str, str]) -> str | None:
    for name, kind in declared.items():
        if name not in df.columns:
            return f"column {name} is missing"
        if not isinstance(df.schema[name].dataType, _KINDS[kind]):
            return f"column {name} is not of kind {kind}"
    return None


def newest_completed(runs: DataFrame, pipeline: str, pipeline_col: str = "pipeline") -> str | None:
    done = runs.where((F.col("status") == "completed") & (F.col(pipeline_col) == pipeline))
    return done.agg(F.max_by("run_id", F.struct("created_at", "run_id")).cast("string")).first()[0]


def load_latest_artifacts(spark: SparkSession, runs: DataFrame, base: str, pipeline: str,
                          pipeline_col: str = "pipeline") -> LoadedArtifacts | None:
    """The artifacts of the newest completed run of a pipeline; None without
    such a run. An artifact that is not in the manifest, does not have its
    declared columns or not as many rows as were written is a problem, and the others are loaded all the same."""
    run_id = newest_completed(runs, pipeline, pipeline_col)
    if run_id is None:
        return None
    folder = f"{base}/run_id={run_id}"
    try:
        listed = {r.artifact: r for r in spark.read.schema(MANIFEST).json(f"{folder}/_manifest").collect()}  # at most six rows
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return LoadedArtifacts(run_id, {}, dict.fromkeys(ARTIFACTS, "the run has no manifest"))
    frames, problems = {}, {}
    for name in ARTIFACTS:
        if name not in listed:
            problems[name] = "not in the manifest"
            continue
        try:
            df = spark.read.parquet(f"{folder}/{listed[name].path}")
        except AnalysisException as e:
            problems[name] = f"cannot be read: {e.getCondition()}"
            continue
        wrong = schema_problem(df, SCHEMAS[name])
        if wrong is None and df.count() != listed[name].rows:
            wrong = "row count differs from the manifest"
        if wrong:
            problems[name] = wrong
        else:
            frames[name] = df
    return LoadedArtifacts(run_id, frames, problems)
