"""Reporting operators (G1-G3, G7): small result frames -> finding rows.
Inputs are one-row / few-row aggregates, so everything here is tiny."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def _one(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of the one-row frame ``b`` on every row of ``a`` (scalar subqueries)."""
    from tokenflow.functions.frames import attach_scalars
    return attach_scalars(a, b)


def _cap(c) -> F.Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(F.col(c) if isinstance(c, str) else c, F.lit(2))))


def _pct1(x) -> F.Column:
    """Python ``{x:.1%}``."""
    return F.concat(F.format_string("%.1f", x * 100.0), F.lit("%"))


def conclusions(activity: DataFrame, holder_metrics: DataFrame, chain_metrics: DataFrame,
                confidence: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """G1: up to five findings (finding_rank, finding, value, confidence,
    explanation). Ties: dominant usage -> Store of Value, holder pattern ->
    Active Transactors, chains -> first in fixed order."""
    level = confidence.select(F.col("level").alias("conf"))
    a = activity.agg(F.sum(F.when(F.col("activity_type") == "transaction", F.col("tx_count"))).alias("t"),
                     F.sum(F.when(F.col("activity_type") == "store_of_value", F.col("tx_count"))).alias("s"))
    a = a.select(F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("s", F.lit(0)).alias("s"))
    tot = F.col("t") + F.col("s")
    tr, sr = F.col("t") / tot, F.col("s") / tot
    f1 = _one(a.where(tot > 0), level).select(
        F.lit(1).alias("finding_rank"), F.lit("Dominant Usage Pattern").alias("finding"),
        F.when(tr > sr, "Transaction").otherwise("Store of Value").alias("value"), "conf",
        F.concat(F.lit("Based on activity type distribution: "),
                 F.when(tr > sr, F.concat(_pct1(tr), F.lit(" transactions vs "), _pct1(sr), F.lit(" store-of-value")))
                  .otherwise(F.concat(_pct1(sr), F.lit(" store-of-value vs "), _pct1(tr), F.lit(" transactions"))))
        .alias("explanation"))
    sp = F.col("sov_percentage")
    ap = F.lit(100.0) - sp
    f2 = _one(holder_metrics.where(F.col("total_holders") > 0), level).select(
        F.lit(2).alias("finding_rank"), F.lit("Holder Behavior Pattern").alias("finding"),
        F.when(sp > ap, "Store of Value").otherwise("Active Transactors").alias("value"), "conf",
        F.when(sp > ap, F.concat(F.format_string("%.1f", sp), F.lit("% holders are store-of-value")))
         .otherwise(F.concat(F.format_string("%.1f", ap), F.lit("% holders are active transactors")))
        .alias("explanation"))
    top = (chain_metrics.agg(F.max_by(F.struct("chain", "transaction_count"),
                                      F.struct(F.col("transaction_count"), -F.col("chain_rank"))).alias("m"))
           .select("m.*").where(F.col("transaction_count") > 0))
    f3 = _one(top, level).select(
        F.lit(3).alias("finding_rank"), F.lit("Most Active Chain").alias("finding"), _cap(F.col("chain")).alias("value"),
        "conf", F.concat(_cap(F.col("chain")), F.lit(" has "), F.format_number("transaction_count", 0),
                         F.lit(" transactions")).alias("explanation"))
    sov = (chain_metrics.where(F.col("sov_ratio") > 0)
           .agg(F.max_by(F.struct("chain", "sov_ratio"), F.struct(F.col("sov_ratio"), -F.col("chain_rank"))).alias("m"))
           .select("m.*").where(F.col("chain").isNotNull()))
    f4 = _one(sov, level).select(
        F.lit(4).alias("finding_rank"), F.lit("Highest Store-of-Value Ratio").alias("finding"),
        _cap(F.col("chain")).alias("value"), "conf",
        F.concat(_cap(F.col("chain")), F.lit(" has "), _pct1(F.col("sov_ratio")), F.lit(" store-of-value ratio"))
        .alias("explanation"))
    parts = [f1, f2, f3, f4]
    if errors is not None:
        e = errors.agg(F.count("*").alias("n")).where(F.col("n") > 0)
        parts.append(e.select(
            F.lit(5).alias("finding_rank"), F.lit("Data Quality Warning").alias("finding"),
            F.concat(F.col("n").cast("string"), F.lit(" error(s) detected")).alias("value"),
            F.lit("low").alias("conf"),
            F.lit("Data collection encountered errors that may affect the accuracy of conclusions. "
                  "Review the errors list for details.").alias("explanation")))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("conf", "confidence")


def quality_warnings(confidence: DataFrame, errors: DataFrame | None = None,
                     n_chains: int = 3) -> DataFrame:
    """Warning messages (warning_rank, message). ``errors`` has one
    ``error`` string per row with an ``ord`` column giving its order."""
    parts = []
    if errors is not None:
        n = errors.agg(F.count("*").alias("n"))
        parts.append(n.where(F.col("n") > 0).select(F.lit(0).alias("warning_rank"), F.concat(
            F.lit("Data collection reported "), F.col("n").cast("string"),
            F.lit(" error(s). Results may be incomplete.")).alias("message")))
        first3 = (errors.orderBy("ord").limit(3)  # the first three errors are the feature
                  .select(F.lit(1).alias("warning_rank"),
                          F.concat(F.lit("Collection error: "), F.col("error")).alias("message")))
        parts.append(first3)
        parts.append(n.where(F.col("n") > 3).select(F.lit(2).alias("warning_rank"), F.concat(
            F.lit("... and "), (F.col("n") - 3).cast("string"), F.lit(" more error(s)")).alias("message")))
    c = confidence
    chains_with_data = F.round(F.col("chain_coverage") * n_chains).cast("int")
    checks = F.array(
        F.when(F.col("level") == "low", F.concat(F.lit("Low confidence score ("), F.format_string("%.2f", F.col("score")),
                                                 F.lit("). Consider collecting more data for reliable conclusions."))),
        F.when(chains_with_data < n_chains, F.concat(F.lit("Data from "), (F.lit(n_chains) - chains_with_data).cast("string"),
                                                     F.lit(" chain(s) is missing. Cross-chain analysis may be incomplete."))),
        F.when(F.col("data_completeness") < 0.9, F.concat(F.lit("Field completeness is "),
                                                          F.format_string("%.1f", F.col("data_completeness") * 100.0),
                                                          F.lit("%. Some records have missing required fields."))),
        F.when(F.col("sample_size") < 100, F.concat(F.lit("Small sample size ("), F.col("sample_size").cast("string"),
                                                    F.lit(" transactions). Statistical conclusions may not be representative."))))
    parts.append(c.select(F.posexplode(checks).alias("p", "message")).where(F.col("message").isNotNull())
                 .select((F.col("p") + 3).alias("warning_rank"), "message"))
    return reduce(DataFrame.unionByName, parts)


def bundle_findings(activity: DataFrame, holder_metrics: DataFrame) -> DataFrame:
    """Dominant activity by count % (first in enum order on ties) and the
    SoV holder share."""
    dom = activity.agg(F.max_by(F.struct("activity_type", "count_pct"),
                                F.struct(F.col("count_pct"), -F.col("activity_rank"))).alias("m")).select("m.*")
    f1 = dom.select(F.lit("dominant_activity").alias("type"), F.col("activity_type").alias("value"),
                    F.col("count_pct").alias("percentage"),
                    F.concat(F.lit("Primary usage pattern: "), F.col("activity_type"), F.lit(" ("),
                             F.format_string("%.1f", F.col("count_pct")), F.lit("%)")).alias("description"))
    f2 = holder_metrics.select(F.lit("sov_ratio").alias("type"), F.format_string("%.1f", F.col("sov_percentage")).alias("value"),
                               F.col("sov_percentage").alias("percentage"),
                               F.concat(F.lit("Store of Value holders: "), F.format_string("%.1f", F.col("sov_percentage")),
                                        F.lit("%")).alias("description"))
    return f1.unionByName(f2)
