"""Descriptive analytics over TX / HOLDER.

Pattern used throughout: one ``groupBy`` with conditional aggregates (the
reference re-scans the frame once per enum value), then completion against a
literal enum table. Enum tables and aggregated results have a handful of rows,
so the windows without partitioning below run over those few rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tokenflow import dims
from tokenflow.functions import scalar as S
from tokenflow.operators.rank import median
from tokenflow.functions.frames import attach_scalars


def _all():
    """Window over all rows -- used only on frames of a few aggregated rows."""
    return Window.partitionBy()


def require_columns(df: DataFrame, cols, what: str = "DataFrame") -> None:
    """Plan-time column check."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"{what} missing required columns: {set(missing)}")


def enum_gate(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """V18 strict: values outside ``allowed`` fail the job when the rows are
    evaluated (lazy, no extra action): ``raise_error`` inside a filter."""
    bad = F.col(column).isNotNull() & ~F.col(column).isin(*allowed)
    return df.where(F.coalesce(
        F.when(bad, F.raise_error(F.concat(F.lit(f"invalid {column}: "), F.col(column)))),
        F.lit(True)))


def _pct(num, den) -> F.Column:
    return F.when(den > 0, num.cast("double") / den.cast("double") * 100.0).otherwise(0.0)


def _ratio(num, den) -> F.Column:
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(0.0)


# A1 -------------------------------------------------------------------------
def _stack(one_row: DataFrame, labels: list[str], label_col: str, fields: list[str]) -> DataFrame:
    """One wide row -> one row per label: ``<field>__<label>`` -> ``<field>``."""
    parts = ", ".join(f"'{lab}', {i}, " + ", ".join(f"`{f}__{lab}`" for f in fields)
                      for i, lab in enumerate(labels))
    cols = ", ".join([label_col, f"{label_col}_rank", *fields])
    keep = [c for c in one_row.columns if "__" not in c]
    return one_row.selectExpr(*[f"`{c}`" for c in keep],
                              f"stack({len(labels)}, {parts}) AS ({cols})")


def activity_breakdown(tx: DataFrame, strict: bool = True) -> DataFrame:
    """Per activity (enum order, zero-filled): count, count % of *all* rows,
    volume (nulls skipped), volume % of the enum total.

    One global aggregation with a conditional count / sum per enum value
    (partial aggregates per task, a single small final row), then ``stack``
    into rows: no join, nothing broadcast, no per-value re-scan."""
    require_columns(tx, {"activity_type", "amount"})
    src = enum_gate(tx, "activity_type", dims.ACTIVITY_TYPES) if strict else tx
    a = F.col("activity_type")
    aggs = [F.count("*").alias("_total_rows")]
    for v in dims.ACTIVITY_TYPES:
        aggs += [F.count_if(a == v).alias(f"n__{v}"),
                 F.coalesce(F.sum(F.when(a == v, F.col("amount"))), F.lit(0).cast("decimal(38,18)"))
                 .alias(f"vol__{v}")]
    one = src.agg(*aggs)
    one = one.withColumn("_total_vol", sum((F.col(f"vol__{v}") for v in dims.ACTIVITY_TYPES[1:]),
                                           F.col(f"vol__{dims.ACTIVITY_TYPES[0]}")))
    r = _stack(one, dims.ACTIVITY_TYPES, "activity_type", ["n", "vol"])
    return r.select(
        "activity_type", "activity_type_rank",
        F.col("n").cast("bigint").alias("tx_count"),
        _pct(F.col("n"), F.col("_total_rows")).alias("count_pct"),
        F.col("vol").alias("volume"),
        _pct(F.col("vol").cast("double"), F.col("_total_vol").cast("double")).alias("volume_pct")
    ).withColumnRenamed("activity_type_rank", "activity_rank")


# A2 -------------------------------------------------------------------------
def check_sov_flag_type(holders: DataFrame) -> None:
    """The SoV flag must be boolean or numeric (plan-time schema check)."""
    from pyspark.sql import types as T
    t = holders.schema["is_store_of_value"].dataType
    if not isinstance(t, (T.BooleanType, T.NumericType)):
        raise ValueError(f"Column 'is_store_of_value' must be boolean or numeric, got {t.simpleString()}")


def _holder_sov_by(holders: DataFrame | None, dim: str, values: list[str]) -> DataFrame | None:
    """SoV holder counts per enum value (at most len(values) rows). A boolean
    flag counts true rows; a numeric flag is summed, as the reference does."""
    if holders is None or "is_store_of_value" not in holders.columns or dim not in holders.columns:
        return None
    check_sov_flag_type(holders)
    flag = F.col("is_store_of_value")
    if holders.schema["is_store_of_value"].dataType.simpleString() == "boolean":
        flag = flag.cast("int")
    return holders.where(F.col(dim).isin(*values)).groupBy(dim).agg(
        F.count("*").alias("_hn"), F.sum(F.coalesce(flag, F.lit(0))).alias("_hsov"))


def _per_dim(tx: DataFrame, holders: DataFrame | None, dim: str, values: list[str],
             gas: bool = False) -> DataFrame:
    """Per enum value of ``dim``. Rows are filtered to the enum before the
    groupBy, so the aggregated side has at most len(enum) rows: a proven
    bound for the broadcast join against the enum table."""
    enum_df = tx.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)],
                                              f"{dim} string, {dim}_rank int")
    aggs = [F.count("*").alias("_n"), F.sum("amount").alias("_vol")]
    for a in dims.ACTIVITY_TYPES:
        aggs.append(F.count_if(F.col("activity_type") == a).alias(f"_n_{a}"))
    if gas:
        wei = S.gas_wei_product("gas_used", "gas_price")
        unit = F.lit("1" + "0" * 19).cast("decimal(20,0)")
        low = wei % unit  # high part and rest: neither sum can overflow below 1e10 rows
        aggs += [F.count(wei).alias("_gas_n"), F.try_sum(wei).alias("_gas_wei"), F.sum(low).alias("_gas_low"),
                 F.sum(((wei - low) / unit).cast("decimal(11,0)")).alias("_gas_high")]
    g = tx.where(F.col(dim).isin(*values)).groupBy(dim).agg(*aggs)
    j = enum_df.join(F.broadcast(g), dim, "left")
    hs = _holder_sov_by(holders, dim, values)
    if hs is not None:
        j = j.join(F.broadcast(hs), dim, "left")
    else:
        j = j.withColumn("_hn", F.lit(None).cast("bigint")).withColumn("_hsov", F.lit(None).cast("bigint"))
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    vol = F.coalesce("_vol", F.lit(0).cast("decimal(38,18)"))
    cols = [F.col(dim), n.alias("transaction_count"), vol.alias("total_volume"),
            F.when(n > 0, vol.cast("double") / n.cast("double")).otherwise(0.0)
            .alias("avg_transaction_size")]
    for a in dims.ACTIVITY_TYPES:
        cols.append(_pct(F.coalesce(f"_n_{a}", F.lit(0)), n).alias(f"pct_{a}"))
    cols.append(_ratio(F.coalesce("_hsov", F.lit(0)), F.coalesce("_hn", F.lit(0)))
                .alias("sov_ratio"))
    if gas:
        gn = F.coalesce("_gas_n", F.lit(0)).cast("bigint")
        # a total of 1e29 wei or more has no decimal with 9 digits: whole wei from its two parts, beyond 1e38 as double
        high = F.col("_gas_high")
        whole = F.try_add(F.concat(high.cast("string"), F.lit("0" * 19)).try_cast("decimal(38,0)"), F.floor("_gas_low"))
        total = F.coalesce(F.col("_gas_wei").cast("double"), whole.cast("double"),
                           high.cast("double") * F.lit(1e19) + F.col("_gas_low").cast("double"))
        cols += [F.when(gn > 0, total / gn.cast("double") / F.lit(1e18))
                 .alias("avg_gas_cost"),
                 (n - gn).alias("excluded_gas_count")]
    return j.select(*cols, *[c for c in enum_df.columns if c.endswith("_rank")])


def by_stablecoin(tx: DataFrame, holders: DataFrame | None = None) -> DataFrame:
    """A2: one row per coin (USDC, USDT), plus global totals as columns."""
    require_columns(tx, {"stablecoin", "amount", "activity_type"})
    r = _per_dim(tx, holders, "stablecoin", dims.STABLECOINS).withColumnRenamed("stablecoin_rank", "coin_rank")
    tot = tx.agg(F.count("*").cast("bigint").alias("all_transactions"),
                 F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(38,18)")).alias("all_volume"))
    return _attach_one_row(r, tot)


def _attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a one-row aggregate on every row (scalar subqueries)."""
    return attach_scalars(df, one_row)


# A3 -------------------------------------------------------------------------
def volume_by_dim(tx: DataFrame, dim: str) -> DataFrame:
    """sum(amount) per value of ``dim``; null keys dropped (pandas groupby)."""
    require_columns(tx, {dim, "amount"})
    return (tx.where(F.col(dim).isNotNull()).groupBy(dim)
              .agg(F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(38,18)")).alias("volume")))


# A4 -------------------------------------------------------------------------
def avg_tx_size(tx: DataFrame, group_by: str | None = None) -> DataFrame:
    """sum / non-null count (0 when no amounts); without ``group_by`` one row
    keyed 'total'."""
    require_columns(tx, {"amount"})
    avg = F.when(F.count("amount") > 0,
                 F.sum("amount").cast("double") / F.count("amount").cast("double")).otherwise(0.0)
    if group_by is None:
        return tx.agg(F.lit("total").alias("group"), avg.alias("avg_transaction_size"))
    require_columns(tx, {group_by})
    return (tx.where(F.col(group_by).isNotNull()).groupBy(group_by)
              .agg(avg.alias("avg_transaction_size")))


# A5 -------------------------------------------------------------------------
def holder_metrics(holders: DataFrame, period_col: str = "holding_period_days") -> DataFrame:
    """One row: totals, SoV share, average balances (sum / row count), mean and
    exact median holding period of SoV holders (``rank.median``). Null SoV flag -> false."""
    require_columns(holders, {"is_store_of_value", "balance"})
    sov = F.coalesce(F.col("is_store_of_value"), F.lit(False))
    n = F.count("*")
    n_sov = F.count_if(sov)
    n_act = F.count_if(~sov)
    known = period_col in holders.columns
    hp = F.col(period_col) if known else F.lit(None).cast("double")
    middle = F.lit(None).cast("double")
    if known:
        middle = median(holders.where(sov).select(hp.cast("double").alias("_period")), "_period").scalar()
    totals = holders.agg(
        n.cast("bigint").alias("total_holders"),
        n_sov.cast("bigint").alias("sov_count"),
        _pct(n_sov, n).alias("sov_percentage"),
        F.when(n_sov > 0, F.coalesce(F.sum(F.when(sov, F.col("balance"))), F.lit(0))
               .cast("double") / n_sov.cast("double")).otherwise(0.0).alias("avg_balance_sov"),
        F.when(n_act > 0, F.coalesce(F.sum(F.when(~sov, F.col("balance"))), F.lit(0))
               .cast("double") / n_act.cast("double")).otherwise(0.0).alias("avg_balance_active"),
        F.coalesce(F.avg(F.when(sov, hp.cast("double"))), F.lit(0.0)).alias("avg_holding_period_days"))
    return totals.withColumn("median_holding_period_days", F.coalesce(middle, F.lit(0.0)))


# A10 ------------------------------------------------------------------------
def by_chain(tx: DataFrame, holders: DataFrame | None = None) -> DataFrame:
    """Per chain (3 fixed): count, volume, avg (row count), avg gas cost in
    native units (null if no gas data), rows excluded for null or
    unpayable gas (1e29 wei or more), SoV ratio, activity %. Gas cost is summed exactly in wei; without gas columns
    every row is excluded and the cost is null."""
    require_columns(tx, {"chain", "amount", "activity_type"})
    for c in ("gas_used", "gas_price"):
        if c not in tx.columns:
            tx = tx.withColumn(c, F.lit(None).cast("decimal(38,9)"))
    return _per_dim(tx, holders, "chain", dims.CHAINS, gas=True)


# A11 ------------------------------------------------------------------------
def chain_activity_dist(tx: DataFrame) -> DataFrame:
    """(chain, activity) count and % within chain, rounded half-even to 2;
    complete 3x3 grid. The denominator counts every row of the chain with a
    non-null activity, including activities outside the enum.

    groupBy(chain) over the enum chains with one conditional count per
    activity (<= 3 aggregated rows), then ``stack`` into the grid."""
    c, a = F.col("chain"), F.col("activity_type")
    g = (tx.where(c.isin(*dims.CHAINS) & a.isNotNull()).groupBy("chain")
           .agg(F.count("*").alias("_chain_total"),
                *[F.count_if(a == v).alias(f"n__{v}") for v in dims.ACTIVITY_TYPES]))
    grid = dims.chains(tx.sparkSession).select("chain", "chain_rank").join(F.broadcast(g), "chain", "left")
    st = _stack(grid.drop("explorer"), dims.ACTIVITY_TYPES, "activity_type", ["n"])
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return st.select("chain", "activity_type", "chain_rank", F.col("activity_type_rank").alias("activity_rank"),
                     n.alias("count"),
                     F.when(F.col("_chain_total") > 0,
                            S.round2_half_even(n.cast("double") / F.col("_chain_total").cast("double") * 100.0))
                     .otherwise(0.0).alias("percentage"))


# A12-A14 --------------------------------------------------------------------
def summary_by_stablecoin(tx: DataFrame, holders: DataFrame | None = None) -> DataFrame:
    """Per coin seen in TX: tx count, volume, distinct lower-cased addresses
    over senders, receivers and holders of that coin (holders only count for
    coins present in TX): one scan of TX, no join."""
    ends = tx.select("stablecoin", F.explode(F.array(
        F.struct(F.lower("from_address").alias("a"), F.lit(1).alias("n"), F.col("amount").alias("v")),
        F.struct(F.lower("to_address").alias("a"), F.lit(0).alias("n"), F.lit(None).cast(tx.schema["amount"].dataType).alias("v")))).alias("e"))
    ends = ends.select("stablecoin", "e.a", "e.n", "e.v", F.lit(True).alias("moved"))
    if holders is not None:
        ends = ends.unionByName(holders.select("stablecoin", F.lower("address").alias("a"), F.lit(0).alias("n"),
                                               F.lit(None).cast(tx.schema["amount"].dataType).alias("v"), F.lit(False).alias("moved")))
    # one row per (coin, address): a hot address is one partial row per task
    per = ends.groupBy("stablecoin", "a").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.bool_or("moved").alias("moved"))
    g = per.groupBy("stablecoin").agg(F.sum("n").cast("bigint").alias("total_transactions"), F.sum("v").alias("total_volume"),
                                      F.count("*").cast("bigint").alias("unique_addresses"), F.bool_or("moved").alias("moved"))
    return g.where("moved").drop("moved")


def summary_by_activity(tx: DataFrame, holders: DataFrame | None = None) -> DataFrame:
    """tx per activity, SoV holders added into ``store_of_value``."""
    t = tx.select("activity_type")
    if holders is not None:
        t = t.unionByName(holders.where(F.col("is_store_of_value"))
                          .select(F.lit("store_of_value").alias("activity_type")))
    return t.groupBy("activity_type").agg(F.count("*").cast("bigint").alias("count"))


def summary_by_chain(tx: DataFrame, holders: DataFrame | None = None) -> DataFrame:
    """records (tx + holders) per chain."""
    t = tx.select("chain")
    if holders is not None:
        t = t.unionByName(holders.select("chain"))
    return t.groupBy("chain").agg(F.count("*").cast("bigint").alias("records"))


# A15 ------------------------------------------------------------------------
def aggregate_metrics(tx: DataFrame, holders: DataFrame) -> DataFrame:
    """One row: totals, SoV holder count, tx per activity over the four
    collect-time activity values (zero-filled)."""
    aggs = [F.count("*").cast("bigint").alias("total_transactions")]
    for a in dims.ACTIVITY_TYPES_COLLECT:
        aggs.append(F.count_if(F.col("activity_type") == a).cast("bigint").alias(f"tx_{a}"))
    t = tx.agg(*aggs)
    h = holders.agg(F.count("*").cast("bigint").alias("total_holders"),
                    F.count_if(F.col("is_store_of_value")).cast("bigint").alias("sov_holders"))
    return _attach_one_row(t, h)


# A16 / A17 ------------------------------------------------------------------
REQUIRED_QUALITY_FIELDS = ["transaction_hash", "timestamp", "from_address",
                           "to_address", "amount", "stablecoin"]


def field_completeness(tx: DataFrame, fields=REQUIRED_QUALITY_FIELDS) -> DataFrame:
    """non-null cells / (rows x fields); a missing column counts as all null."""
    present = [f for f in fields if f in tx.columns]
    nn = sum((F.count(F.col(f)) for f in present), F.lit(0))
    n = F.count("*")
    return tx.agg(n.cast("bigint").alias("rows"),
                  F.when(n > 0, nn.cast("double") / (n * len(fields)).cast("double"))
                  .otherwise(0.0).alias("field_completeness"))


def confidence(tx: DataFrame, n_chains: int = 3) -> DataFrame:
    """sample size, completeness, chain coverage, 0.7/0.3 quality mix,
    score = 0.6*min(n/1000,1) + 0.4*mix, level."""
    present = [f for f in REQUIRED_QUALITY_FIELDS if f in tx.columns]
    nn = sum((F.count(F.col(f)) for f in present), F.lit(0))
    n = F.count("*")
    one = tx.agg(n.cast("bigint").alias("sample_size"),
                 F.when(n > 0, nn.cast("double") / (n * len(REQUIRED_QUALITY_FIELDS)).cast("double"))
                 .otherwise(0.0).alias("data_completeness"),
                 (F.count_distinct(F.when(F.col("chain").isin(*dims.CHAINS), F.col("chain")))
                  .cast("double") / F.lit(float(n_chains))).alias("chain_coverage"))
    mix = F.col("data_completeness") * 0.7 + F.col("chain_coverage") * 0.3
    score = F.least(F.col("sample_size").cast("double") / 1000.0, F.lit(1.0)) * 0.6 + mix * 0.4
    return (one.withColumn("quality_mix", mix).withColumn("score", score)
               .withColumn("level", S.confidence_level("score")))


# A19 / A20 ------------------------------------------------------------------
def balance_histogram(holders: DataFrame, bins: int = 30) -> DataFrame:
    """Positive balances in ``bins`` equal-width bins between min and max,
    split by SoV label."""
    pos = holders.where(F.col("balance") > 0).select(
        F.col("balance").cast("double").alias("b"),
        S.sov_status_label(F.coalesce("is_store_of_value", F.lit(False))).alias("label"))
    rng = pos.agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    j = _attach_one_row(pos, rng)
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    idx = F.when(F.col("hi") == F.col("lo"), 0).otherwise(
        F.least(F.floor((F.col("b") - F.col("lo")) / width), F.lit(bins - 1)))
    return (j.withColumn("bin", idx.cast("bigint"))
             .groupBy("label", "bin").agg(F.count("*").cast("bigint").alias("count"),
                                          F.min("lo").alias("lo"), F.min("hi").alias("hi")))


def sov_prob_histogram(predictions: DataFrame, bins: int = 20) -> DataFrame:
    """Probabilities in ``bins`` bins of [0,1] by the p >= 0.5 label."""
    p = F.col("sov_probability")
    return (predictions.where(p.isNotNull())
            .select(S.sov_probability_label(p).alias("label"),
                    F.least(F.floor(p * bins), F.lit(bins - 1)).cast("bigint").alias("bin"))
            .groupBy("label", "bin").agg(F.count("*").cast("bigint").alias("count")))


# A21 ------------------------------------------------------------------------
def sov_pred_summary(predictions: DataFrame) -> DataFrame:
    p = F.col("sov_probability")
    n = F.count("*")
    hi = F.count_if(p >= 0.5)
    lo = F.count_if(p < 0.5)
    return predictions.agg(n.cast("bigint").alias("total"),
                           hi.cast("bigint").alias("likely_sov"), _pct(hi, n).alias("likely_sov_pct"),
                           lo.cast("bigint").alias("likely_active"), _pct(lo, n).alias("likely_active_pct"),
                           F.coalesce(F.avg(p), F.lit(0.0)).alias("mean_probability"))


# A22 / A23 ------------------------------------------------------------------
def class_breakdown(classified: DataFrame) -> DataFrame:
    """count and % per behaviour class (fixed order, zero-filled), total of all
    rows: one aggregation, no join."""
    c = F.col("behavior_class")
    one = classified.agg(F.count("*").cast("bigint").alias("total"),
                         *[F.count_if(c == v).cast("bigint").alias(f"count__{v}") for v in dims.BEHAVIOR_CLASSES])
    st = _stack(one, dims.BEHAVIOR_CLASSES, "behavior_class", ["count"])
    return st.select("behavior_class", F.col("behavior_class_rank").alias("class_rank"), "count",
                     _pct(F.col("count"), F.col("total")).alias("percentage"), "total")


def class_confidence(classified: DataFrame, low: float = 0.6) -> DataFrame:
    n = F.count("*")
    lowc = F.count_if(F.col("confidence") < low)
    return classified.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
                          lowc.cast("bigint").alias("low_confidence_count"),
                          _pct(lowc, n).alias("low_confidence_pct"),
                          F.min("confidence").alias("min_confidence"),
                          F.max("confidence").alias("max_confidence"))


# A25 / A26 ------------------------------------------------------------------
def chart_long(metrics: DataFrame, key: str, value_cols: list[str]) -> DataFrame:
    """Long rows behind a chart: (key, metric, value) via ``unpivot``."""
    m = metrics.select(key, *[F.col(c).cast("double").alias(c) for c in value_cols])
    return m.unpivot([key], value_cols, "metric", "value")


def chart_frames(tx: DataFrame, holders: DataFrame) -> dict[str, DataFrame]:
    """The frames behind the charts: ``coin_activity`` (stablecoin, activity_type,
    percentage) for coins and activities in full, ``chain`` (chain, metric, value),
    ``gas`` (chain, avg_gas_cost, excluded_count) for chains with gas data only, and
    ``holders`` (status, count). Each has at most a dozen rows."""
    coins = by_stablecoin(tx, holders)
    chains = by_chain(tx, holders)
    acts = coins.select("stablecoin", *[F.col(f"pct_{a}").alias(a) for a in dims.ACTIVITY_TYPES])
    sov = F.coalesce(F.col("is_store_of_value").cast("boolean"), F.lit(False))
    counts = holders.agg(F.count_if(sov).cast("bigint").alias("sov"), F.count_if(~sov).cast("bigint").alias("active"))
    status = F.explode(F.array(*[F.struct(S.sov_status_label(F.lit(flag)).alias("status"), F.col(c).alias("count"))
                                 for flag, c in ((True, "sov"), (False, "active"))]))
    return {"coin_activity": acts.unpivot(["stablecoin"], dims.ACTIVITY_TYPES, "activity_type", "percentage"),
            "chain": chart_long(chains, "chain", ["total_volume", "avg_transaction_size", "sov_ratio"]),
            "gas": chains.where(F.col("avg_gas_cost").isNotNull()).select(
                "chain", "avg_gas_cost", F.col("excluded_gas_count").alias("excluded_count")),
            "holders": counts.select(status.alias("s")).select("s.*")}


def activity_pivot(tx: DataFrame, dim: str, values: list[str]) -> DataFrame:
    """activity x dim percentage cross-table with fixed rows and columns;
    percentage of the dim value's rows; absent = 0. One global aggregation
    of conditional counts (len(values) x (1 + activities) cells), then
    ``stack`` into one row per activity."""
    d, a = F.col(dim), F.col("activity_type")
    aggs = []
    for v in values:
        aggs.append(F.count_if(d == v).alias(f"_t_{v}"))
        for act in dims.ACTIVITY_TYPES:
            aggs.append(F.count_if((d == v) & (a == act)).alias(f"_n_{v}_{act}"))
    one = tx.agg(*aggs)
    cells = {}
    for v in values:
        for act in dims.ACTIVITY_TYPES:
            cells[f"{v}__{act}"] = F.when(F.col(f"_t_{v}") > 0, F.col(f"_n_{v}_{act}").cast("double")
                                          / F.col(f"_t_{v}").cast("double") * 100.0).otherwise(0.0)
    wide = one.select(*[c.alias(k) for k, c in cells.items()])
    parts = ", ".join(f"'{act}', {i}, " + ", ".join(f"`{v}__{act}`" for v in values)
                      for i, act in enumerate(dims.ACTIVITY_TYPES))
    return wide.selectExpr(f"stack({len(dims.ACTIVITY_TYPES)}, {parts}) AS (activity_type, activity_rank, "
                           + ", ".join(f"`{v}`" for v in values) + ")")


# T1 / P19 -------------------------------------------------------------------
def top_holders(holders: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` by balance (null -> 0); ties broken by address, coin, chain.
    ``orderBy + limit`` plans as TakeOrderedAndProject (per-partition top-n,
    then a merge of n rows per partition)."""
    require_columns(holders, {"address", "balance", "stablecoin", "chain", "is_store_of_value"})
    if n <= 0:
        return holders.limit(0).select("address", F.col("balance"), "stablecoin", "chain",
                                       "is_store_of_value")
    b = F.coalesce("balance", F.lit(0).cast("decimal(38,18)"))
    return (holders.select("address", b.alias("balance"), "stablecoin", "chain",
                           F.coalesce("is_store_of_value", F.lit(False)).alias("is_store_of_value"))
            .orderBy(F.col("balance").desc(), "address", "stablecoin", "chain").limit(n))


def top_holders_table(holders: DataFrame, n: int = 10) -> DataFrame:
    """T1 with rank and masked address (P19); rank over the n rows only."""
    t = top_holders(holders, n)
    w = Window.orderBy(F.col("balance").desc(), "address", "stablecoin", "chain")
    return t.select(F.row_number().over(w).alias("rank"), S.mask_address("address")
                    .alias("address_masked"), "address", "balance", "stablecoin", "chain",
                    "is_store_of_value")


# T5 / T6 --------------------------------------------------------------------
def most_active_chain(chain_metrics: DataFrame) -> DataFrame:
    """argmax transaction_count among > 0, first in fixed chain order on ties."""
    return (chain_metrics.where(F.col("transaction_count") > 0)
            .orderBy(F.col("transaction_count").desc(), F.col("chain_rank")).limit(1)
            .select("chain", "transaction_count"))


def top_sov_chain(chain_metrics: DataFrame) -> DataFrame:
    return (chain_metrics.where(F.col("sov_ratio") > 0)
            .orderBy(F.col("sov_ratio").desc(), F.col("chain_rank")).limit(1)
            .select("chain", "sov_ratio"))
