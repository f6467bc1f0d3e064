"""The registered queries (one per SURVEY §2 operator where the derived
tables can express it). Each reads the whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenflow import dims
from tokenflow.operators import analytics as A
from tokenflow.plans import oracle_ctes as C
from tokenflow.plans.catalog import register
from tokenflow.sources import testdata as TD


def _tx(spark, sf):
    """Canonical TX, read from the table written once per application."""
    return TD.tx_table(spark, sf)


# --------------------------------------------------------------------- A1
@register("activity_breakdown", C.with_ctes("TX", extra="""
g AS (SELECT activity_type, count(*) AS n, sum(amount) AS vol FROM tx GROUP BY activity_type),
e AS (SELECT * FROM (VALUES ('transaction', 0), ('store_of_value', 1), ('other', 2)) t(activity_type, r)),
j AS (SELECT e.activity_type AS ea, g.* FROM e FULL JOIN g ON e.activity_type = g.activity_type),
t AS (SELECT sum(coalesce(n, 0)) AS total_rows,
             sum(CASE WHEN ea IS NOT NULL THEN coalesce(vol, 0) END) AS total_vol FROM j)""") + """
SELECT j.ea AS activity_type, CAST(coalesce(j.n, 0) AS BIGINT) AS tx_count,
  CASE WHEN t.total_rows > 0 THEN CAST(coalesce(j.n, 0) AS DOUBLE) / CAST(t.total_rows AS DOUBLE) * 100.0 ELSE 0.0 END AS count_pct,
  CAST(coalesce(j.vol, 0) AS DOUBLE) AS volume,
  CASE WHEN t.total_vol > 0 THEN CAST(coalesce(j.vol, 0) AS DOUBLE) / CAST(t.total_vol AS DOUBLE) * 100.0 ELSE 0.0 END AS volume_pct
FROM j, t WHERE j.ea IS NOT NULL""")
def q_activity_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return A.activity_breakdown(_tx(spark, sf)).drop("activity_rank")


def _holders(spark, sf):
    """Base HOLDER (customers, first/last activity from TX), written once."""
    return TD.holders_base_table(spark, sf)


def _hsov(spark, sf, tx=None):
    """Holders with SoV flags, read from the table written once."""
    return TD.holders_table(spark, sf)


_ACTS = dims.ACTIVITY_TYPES


def _pct_sql(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 100.0 ELSE 0.0 END"


def _per_dim_sql(dim: str, values: list[str], gas: bool, extra_select: str = "",
                 extra_cte: str = "") -> str:
    acts = ", ".join(f"count_if(activity_type = '{a}') AS n_{a}" for a in _ACTS)
    gas_agg = (", count_if(gas_used IS NOT NULL AND gas_price IS NOT NULL) AS gn, "
               "sum(CASE WHEN gas_used IS NOT NULL AND gas_price IS NOT NULL THEN "
               "CAST(gas_used AS DECIMAL(38,0)) * CAST(gas_price AS DECIMAL(38,0)) END) AS gwei"
               if gas else "")
    vals = ", ".join(f"('{v}')" for v in values)
    cte = f"""
g AS (SELECT {dim}, count(*) AS n, sum(amount) AS vol, {acts}{gas_agg} FROM tx GROUP BY {dim}),
hs AS (SELECT {dim}, count(*) AS hn, sum(CAST(coalesce(is_store_of_value, false) AS INT)) AS hsov
       FROM holders_typed GROUP BY {dim}),
e AS (SELECT * FROM (VALUES {vals}) t({dim})){extra_cte}"""
    n = "coalesce(g.n, 0)"
    pcts = ", ".join(f"{_pct_sql(f'coalesce(g.n_{a}, 0)', n)} AS pct_{a}" for a in _ACTS)
    gas_sel = (f", CASE WHEN coalesce(g.gn, 0) > 0 THEN CAST(g.gwei AS DOUBLE) / CAST(g.gn AS DOUBLE) / 1e18 END AS avg_gas_cost,"
               f" CAST({n} - coalesce(g.gn, 0) AS BIGINT) AS excluded_gas_count" if gas else "")
    sel = f"""
SELECT e.{dim}, CAST({n} AS BIGINT) AS transaction_count,
  CAST(coalesce(g.vol, 0) AS DOUBLE) AS total_volume,
  CASE WHEN {n} > 0 THEN CAST(coalesce(g.vol, 0) AS DOUBLE) / CAST({n} AS DOUBLE) ELSE 0.0 END AS avg_transaction_size,
  {pcts},
  CASE WHEN coalesce(hs.hn, 0) > 0 THEN CAST(coalesce(hs.hsov, 0) AS DOUBLE) / CAST(hs.hn AS DOUBLE) ELSE 0.0 END AS sov_ratio
  {gas_sel}{extra_select}
FROM e LEFT JOIN g ON g.{dim} = e.{dim} LEFT JOIN hs ON hs.{dim} = e.{dim}"""
    return cte, sel


# --------------------------------------------------------------------- A2
_c, _s = _per_dim_sql("stablecoin", dims.STABLECOINS, False,
                      extra_select=", t.all_transactions, t.all_volume",
                      extra_cte=",\nt AS (SELECT CAST(count(*) AS BIGINT) AS all_transactions, "
                                "CAST(coalesce(sum(amount), 0) AS DOUBLE) AS all_volume FROM tx)")


@register("by_stablecoin", C.with_ctes("TX", "HOLDERS_TYPED", extra=_c.strip()) + _s + ", t")
def q_by_stablecoin(spark, sf):
    tx = _tx(spark, sf)
    return A.by_stablecoin(tx, _hsov(spark, sf, tx)).drop("coin_rank")


# --------------------------------------------------------------------- A10
_c, _s = _per_dim_sql("chain", dims.CHAINS, True)


@register("by_chain", C.with_ctes("TX", "HOLDERS_TYPED", extra=_c.strip()) + _s)
def q_by_chain(spark, sf):
    tx = _tx(spark, sf)
    return A.by_chain(tx, _hsov(spark, sf, tx)).drop("chain_rank")


# --------------------------------------------------------------------- T5 / T6
@register("most_active_chain", C.with_ctes("TX", "HOLDERS_TYPED", extra=_c.strip()) + f"""
, bc AS ({_s.strip()})
SELECT chain, transaction_count FROM bc WHERE transaction_count > 0
ORDER BY transaction_count DESC, CASE chain WHEN 'ethereum' THEN 1 WHEN 'bsc' THEN 2 ELSE 3 END LIMIT 1""")
def q_most_active_chain(spark, sf):
    tx = _tx(spark, sf)
    return A.most_active_chain(A.by_chain(tx, _hsov(spark, sf, tx)))


@register("top_sov_chain", C.with_ctes("TX", "HOLDERS_TYPED", extra=_c.strip()) + f"""
, bc AS ({_s.strip()})
SELECT chain, sov_ratio FROM bc WHERE sov_ratio > 0
ORDER BY sov_ratio DESC, CASE chain WHEN 'ethereum' THEN 1 WHEN 'bsc' THEN 2 ELSE 3 END LIMIT 1""")
def q_top_sov_chain(spark, sf):
    tx = _tx(spark, sf)
    return A.top_sov_chain(A.by_chain(tx, _hsov(spark, sf, tx)))


# --------------------------------------------------------------------- A25
@register("chart_long", C.with_ctes("TX", "HOLDERS_TYPED", extra=_c.strip()) + f"""
, bc AS ({_s.strip()})
SELECT chain, metric, value FROM (
  SELECT chain, 'total_volume' AS metric, total_volume AS value FROM bc
  UNION ALL SELECT chain, 'avg_transaction_size', avg_transaction_size FROM bc
  UNION ALL SELECT chain, 'sov_ratio', sov_ratio FROM bc
  UNION ALL SELECT chain, 'avg_gas_cost', avg_gas_cost FROM bc)""")
def q_chart_long(spark, sf):
    tx = _tx(spark, sf)
    bc = A.by_chain(tx, _hsov(spark, sf, tx))
    return A.chart_long(bc, "chain", ["total_volume", "avg_transaction_size", "sov_ratio",
                                      "avg_gas_cost"])


# --------------------------------------------------------------------- A3
@register("volume_by_dim", C.with_ctes("TX", extra="""
v AS (SELECT chain, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS volume FROM tx
      WHERE chain IS NOT NULL GROUP BY chain)""") + "SELECT * FROM v")
def q_volume_by_dim(spark, sf):
    return A.volume_by_dim(_tx(spark, sf), "chain")


# --------------------------------------------------------------------- A4
@register("avg_tx_size", C.with_ctes("TX") + """
SELECT 'total' AS "group", CASE WHEN count(amount) > 0 THEN CAST(sum(amount) AS DOUBLE) / CAST(count(amount) AS DOUBLE) ELSE 0.0 END AS avg_transaction_size FROM tx""")
def q_avg_tx_size(spark, sf):
    return A.avg_tx_size(_tx(spark, sf))


@register("avg_tx_size_by_coin", C.with_ctes("TX") + """
SELECT stablecoin, CASE WHEN count(amount) > 0 THEN CAST(sum(amount) AS DOUBLE) / CAST(count(amount) AS DOUBLE) ELSE 0.0 END AS avg_transaction_size
FROM tx WHERE stablecoin IS NOT NULL GROUP BY stablecoin""")
def q_avg_tx_size_by_coin(spark, sf):
    return A.avg_tx_size(_tx(spark, sf), "stablecoin")


# --------------------------------------------------------------------- A5
@register("holder_metrics", C.with_ctes("HOLDERS_TYPED", extra="""
h AS (SELECT *, coalesce(is_store_of_value, false) AS sov FROM holders_typed)""") + """
SELECT CAST(count(*) AS BIGINT) AS total_holders, CAST(count_if(sov) AS BIGINT) AS sov_count,
  CASE WHEN count(*) > 0 THEN CAST(count_if(sov) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 ELSE 0.0 END AS sov_percentage,
  CASE WHEN count_if(sov) > 0 THEN CAST(coalesce(sum(CASE WHEN sov THEN balance END), 0) AS DOUBLE) / CAST(count_if(sov) AS DOUBLE) ELSE 0.0 END AS avg_balance_sov,
  CASE WHEN count_if(NOT sov) > 0 THEN CAST(coalesce(sum(CASE WHEN NOT sov THEN balance END), 0) AS DOUBLE) / CAST(count_if(NOT sov) AS DOUBLE) ELSE 0.0 END AS avg_balance_active,
  coalesce(avg(CASE WHEN sov THEN CAST(holding_period_days AS DOUBLE) END), 0.0) AS avg_holding_period_days,
  coalesce(quantile_cont(CASE WHEN sov THEN CAST(holding_period_days AS DOUBLE) END, 0.5), 0.0) AS median_holding_period_days
FROM h""")
def q_holder_metrics(spark, sf):
    return A.holder_metrics(_hsov(spark, sf))


# --------------------------------------------------------------------- A11
@register("chain_activity_dist", C.with_ctes("TX", extra="""
g AS (SELECT chain, activity_type, count(*) AS n FROM tx
      WHERE chain IS NOT NULL AND activity_type IS NOT NULL GROUP BY chain, activity_type),
g2 AS (SELECT *, sum(n) OVER (PARTITION BY chain) AS ct FROM g),
grid AS (SELECT * FROM (VALUES ('ethereum'), ('bsc'), ('polygon')) c(chain),
                       (VALUES ('transaction'), ('store_of_value'), ('other')) a(activity_type))""") + """
SELECT grid.chain, grid.activity_type, CAST(coalesce(g2.n, 0) AS BIGINT) AS count,
  CASE WHEN g2.ct > 0 THEN round_even(CAST(coalesce(g2.n, 0) AS DOUBLE) / CAST(g2.ct AS DOUBLE) * 100.0 * 100.0, 0) / 100.0 ELSE 0.0 END AS percentage
FROM grid LEFT JOIN g2 ON g2.chain = grid.chain AND g2.activity_type = grid.activity_type""")
def q_chain_activity_dist(spark, sf):
    return A.chain_activity_dist(_tx(spark, sf)).drop("chain_rank", "activity_rank")


# --------------------------------------------------------------------- A26
def _pivot_sql(dim, values):
    cols = ", ".join(f"coalesce(max(CASE WHEN {dim} = '{v}' THEN pct END), 0.0) AS {v}" for v in values)
    return C.with_ctes("TX", extra=f"""
g AS (SELECT {dim}, activity_type, count(*) AS n FROM tx GROUP BY {dim}, activity_type),
g2 AS (SELECT *, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY {dim}) AS DOUBLE) * 100.0 AS pct FROM g),
e AS (SELECT * FROM (VALUES ('transaction'), ('store_of_value'), ('other')) t(activity_type)),
p AS (SELECT activity_type, {cols} FROM g2 GROUP BY activity_type)""") + f"""
SELECT e.activity_type, {", ".join(f"coalesce(p.{v}, 0.0) AS {v}" for v in values)}
FROM e LEFT JOIN p ON p.activity_type = e.activity_type"""


@register("activity_pivot_coin", _pivot_sql("stablecoin", dims.STABLECOINS))
def q_activity_pivot_coin(spark, sf):
    return A.activity_pivot(_tx(spark, sf), "stablecoin", dims.STABLECOINS).drop("activity_rank")


@register("activity_pivot_chain", _pivot_sql("chain", dims.CHAINS))
def q_activity_pivot_chain(spark, sf):
    return A.activity_pivot(_tx(spark, sf), "chain", dims.CHAINS).drop("activity_rank")


# --------------------------------------------------------------------- A6-A9, A18
from tokenflow.operators import timeseries as TS  # noqa: E402


def _ts_sql(aggregation: str, keys: list[str], totals: bool = False) -> str:
    per = C.period_sql('"timestamp"', aggregation)
    nn = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    ks = ", ".join(keys)
    body = f"""
s AS (SELECT {per} AS period, {ks}, CAST(count("timestamp") AS BIGINT) AS transaction_count,
        CAST(coalesce(sum(amount), 0) AS DOUBLE) AS volume
      FROM tx WHERE "timestamp" IS NOT NULL AND {nn} GROUP BY {per}, {ks})"""
    if totals:
        body += """,
t AS (SELECT CAST(count(*) AS BIGINT) AS total_count, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_volume FROM tx)"""
        return C.with_ctes("TX", extra=body.strip()) + f"SELECT {C.ymd('period')} AS period, {ks}, transaction_count, volume, total_count, total_volume FROM s, t"
    return C.with_ctes("TX", extra=body.strip()) + f"SELECT {C.ymd('period')} AS period, {ks}, transaction_count, volume FROM s"


for _agg in TS.PERIODS:
    def _mk(agg):
        @register(f"time_series_{agg}", _ts_sql(agg, ["activity_type", "stablecoin"]))
        def q(spark, sf):
            return TS.time_series(_tx(spark, sf), agg)
        return q
    _mk(_agg)


@register("time_series_totals", _ts_sql("monthly", ["activity_type", "stablecoin"], totals=True))
def q_ts_totals(spark, sf):
    return TS.time_series_totals(_tx(spark, sf), "monthly")


@register("ts_by_activity", _ts_sql("weekly", ["activity_type"]))
def q_ts_by_activity(spark, sf):
    return TS.ts_by_activity(_tx(spark, sf), "weekly")


@register("ts_by_stablecoin", _ts_sql("weekly", ["stablecoin"]))
def q_ts_by_stablecoin(spark, sf):
    return TS.ts_by_stablecoin(_tx(spark, sf), "weekly")


@register("ts_summary", C.with_ctes("TX", extra=f"""
s AS (SELECT {C.week_tue('"timestamp"')} AS period, activity_type, count("timestamp") AS transaction_count,
        coalesce(sum(amount), 0) AS volume
      FROM tx WHERE "timestamp" IS NOT NULL AND activity_type IS NOT NULL GROUP BY ALL),
per AS (SELECT period, sum(transaction_count) AS cnt FROM s GROUP BY period),
pk AS (SELECT period, cnt FROM per ORDER BY cnt DESC, period ASC LIMIT 1)""") + f"""
SELECT CAST((SELECT count(*) FROM per) AS BIGINT) AS total_periods, {C.ymd('pk.period')} AS peak_period,
  CAST(pk.cnt AS BIGINT) AS peak_count,
  CAST((SELECT sum(transaction_count) FROM s) AS BIGINT) AS total_transactions,
  CAST((SELECT sum(volume) FROM s) AS DOUBLE) AS total_volume
FROM pk""")
def q_ts_summary(spark, sf):
    return TS.ts_summary(TS.ts_by_activity(_tx(spark, sf), "weekly"))


@register("ts_all_levels", C.with_ctes("TX", extra=f"""
b AS (SELECT {C.week_tue('"timestamp"')} AS period, activity_type, stablecoin, "timestamp", amount FROM tx
      WHERE "timestamp" IS NOT NULL)""") + f"""
SELECT level, {C.ymd('period')} AS period, activity_type, stablecoin, transaction_count, volume FROM (
  SELECT 'activity_coin' AS level, period, activity_type, stablecoin, CAST(count("timestamp") AS BIGINT) AS transaction_count, CAST(coalesce(sum(amount),0) AS DOUBLE) AS volume
    FROM b WHERE activity_type IS NOT NULL AND stablecoin IS NOT NULL GROUP BY period, activity_type, stablecoin
  UNION ALL
  SELECT 'activity', period, activity_type, NULL, CAST(count("timestamp") AS BIGINT), CAST(coalesce(sum(amount),0) AS DOUBLE)
    FROM b WHERE activity_type IS NOT NULL GROUP BY period, activity_type
  UNION ALL
  SELECT 'coin', period, NULL, stablecoin, CAST(count("timestamp") AS BIGINT), CAST(coalesce(sum(amount),0) AS DOUBLE)
    FROM b WHERE stablecoin IS NOT NULL GROUP BY period, stablecoin)""")
def q_ts_all_levels(spark, sf):
    return TS.ts_all_levels(_tx(spark, sf), "weekly")


# --------------------------------------------------------------------- T1 + P19
@register("top_holders", C.with_ctes("HOLDERS_TYPED", extra="""
t AS (SELECT address, coalesce(balance, 0) AS balance, stablecoin, chain,
             coalesce(is_store_of_value, false) AS is_store_of_value FROM holders_typed
      ORDER BY balance DESC, address, stablecoin, chain LIMIT 10)""") + """
SELECT CAST(row_number() OVER (ORDER BY balance DESC, address, stablecoin, chain) AS BIGINT) AS rank,
  CASE WHEN length(address) > 10 THEN substring(address, 1, 6) || '...' || right(address, 4) ELSE address END AS address_masked,
  address, CAST(balance AS DOUBLE) AS balance, stablecoin, chain, is_store_of_value FROM t""")
def q_top_holders(spark, sf):
    return A.top_holders_table(_hsov(spark, sf), 10)


# --------------------------------------------------------------------- A12-A14
@register("summary_by_stablecoin", C.with_ctes("TX", "HOLDERS", extra="""
g AS (SELECT stablecoin, count(*) AS n, sum(amount) AS vol FROM tx GROUP BY stablecoin),
ends AS (SELECT stablecoin, lower(from_address) AS a FROM tx
         UNION SELECT stablecoin, lower(to_address) FROM tx
         UNION SELECT stablecoin, lower(address) FROM holders WHERE stablecoin IN (SELECT stablecoin FROM g)),
u AS (SELECT stablecoin, count(*) AS ua FROM ends GROUP BY stablecoin)""") + """
SELECT g.stablecoin, CAST(g.n AS BIGINT) AS total_transactions, CAST(g.vol AS DOUBLE) AS total_volume,
  CAST(u.ua AS BIGINT) AS unique_addresses FROM g LEFT JOIN u ON u.stablecoin = g.stablecoin""")
def q_summary_by_stablecoin(spark, sf):
    tx = _tx(spark, sf)
    return A.summary_by_stablecoin(tx, _holders(spark, sf))


@register("summary_by_activity", C.with_ctes("TX", "HOLDERS_TYPED") + """
SELECT activity_type, CAST(count(*) AS BIGINT) AS count FROM (
  SELECT activity_type FROM tx
  UNION ALL SELECT 'store_of_value' FROM holders_typed WHERE is_store_of_value) GROUP BY activity_type""")
def q_summary_by_activity(spark, sf):
    tx = _tx(spark, sf)
    return A.summary_by_activity(tx, _hsov(spark, sf, tx))


@register("summary_by_chain", C.with_ctes("TX", "HOLDERS") + """
SELECT chain, CAST(count(*) AS BIGINT) AS records FROM (
  SELECT chain FROM tx UNION ALL SELECT chain FROM holders) GROUP BY chain""")
def q_summary_by_chain(spark, sf):
    tx = _tx(spark, sf)
    return A.summary_by_chain(tx, _holders(spark, sf))


# --------------------------------------------------------------------- A15
@register("aggregate_metrics", C.with_ctes("TXC", "HOLDERS_TYPED") + f"""
SELECT * FROM (SELECT CAST(count(*) AS BIGINT) AS total_transactions,
  {", ".join(f"CAST(count_if(activity_type = '{a}') AS BIGINT) AS tx_{a}" for a in dims.ACTIVITY_TYPES_COLLECT)}
  FROM txc),
 (SELECT CAST(count(*) AS BIGINT) AS total_holders, CAST(count_if(is_store_of_value) AS BIGINT) AS sov_holders
  FROM holders_typed)""")
def q_aggregate_metrics(spark, sf):
    tx = _tx(spark, sf)
    return A.aggregate_metrics(TD.collected_tx_table(spark, sf), _hsov(spark, sf, tx))


# --------------------------------------------------------------------- A16 / A17
_FIELDS = A.REQUIRED_QUALITY_FIELDS
_NN = " + ".join(f'count("{f}")' for f in _FIELDS)


@register("field_completeness", C.with_ctes("TX") + f"""
SELECT CAST(count(*) AS BIGINT) AS rows,
  CASE WHEN count(*) > 0 THEN CAST({_NN} AS DOUBLE) / CAST(count(*) * {len(_FIELDS)} AS DOUBLE) ELSE 0.0 END AS field_completeness
FROM tx""")
def q_field_completeness(spark, sf):
    return A.field_completeness(_tx(spark, sf))


@register("confidence", C.with_ctes("TX", extra=f"""
o AS (SELECT CAST(count(*) AS BIGINT) AS sample_size,
  CASE WHEN count(*) > 0 THEN CAST({_NN} AS DOUBLE) / CAST(count(*) * {len(_FIELDS)} AS DOUBLE) ELSE 0.0 END AS data_completeness,
  CAST(count(DISTINCT CASE WHEN chain IN ('ethereum', 'bsc', 'polygon') THEN chain END) AS DOUBLE) / 3.0 AS chain_coverage
  FROM tx),
m AS (SELECT *, data_completeness * 0.7 + chain_coverage * 0.3 AS quality_mix FROM o),
s AS (SELECT *, least(CAST(sample_size AS DOUBLE) / 1000.0, 1.0) * 0.6 + quality_mix * 0.4 AS score FROM m)""") + """
SELECT *, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM s""")
def q_confidence(spark, sf):
    return A.confidence(_tx(spark, sf))


# --------------------------------------------------------------------- A19
@register("balance_histogram", C.with_ctes("HOLDERS_TYPED", extra="""
p AS (SELECT CAST(balance AS DOUBLE) AS b,
             CASE WHEN coalesce(is_store_of_value, false) THEN 'Store of Value' ELSE 'Active Transactor' END AS label
      FROM holders_typed WHERE balance > 0),
r AS (SELECT min(b) AS lo, max(b) AS hi FROM p)""") + """
SELECT label, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((b - lo) / ((hi - lo) / 30.0)), 29) END AS BIGINT) AS bin,
  CAST(count(*) AS BIGINT) AS count, min(lo) AS lo, min(hi) AS hi
FROM p, r GROUP BY 1, 2""")
def q_balance_histogram(spark, sf):
    return A.balance_histogram(_hsov(spark, sf), 30)


# --------------------------------------------------------------------- E1 / E2 / S4
from tokenflow.operators import classify as CL  # noqa: E402
from tokenflow.operators import merge as MG  # noqa: E402
from tokenflow.operators import quality as QL  # noqa: E402
from tokenflow.functions import rules as RU  # noqa: E402
from tokenflow.functions import scalar as SC  # noqa: E402
from tokenflow.schemas import TX_STRING  # noqa: E402
from tokenflow.sources import pages as PG  # noqa: E402
from tokenflow.sources import response_rules as RR  # noqa: E402


@register("holding_period", C.with_ctes("HOLDERS_HP") + """
SELECT address, stablecoin, chain, holding_period FROM holders_hp""")
def q_holding_period(spark, sf):
    tx = _tx(spark, sf)
    return CL.holding_period(_holders(spark, sf), tx, TD.REFERENCE_TIME).select(
        "address", "stablecoin", "chain", "holding_period")


@register("sov_heuristic", C.with_ctes("HOLDERS_SOV") + """
SELECT address, is_store_of_value, is_sov_heuristic FROM holders_sov""")
def q_sov_heuristic(spark, sf):
    tx = _tx(spark, sf)
    return CL.sov_heuristic(_holders(spark, sf), tx, TD.REFERENCE_TIME).select(
        "address", "is_store_of_value", "is_sov_heuristic")


@register("typed_holders", C.with_ctes("HOLDERS_TYPED") + f"""
SELECT address, CAST(balance AS DOUBLE) AS balance, stablecoin, chain, {C.ymdhms('first_seen')} AS first_seen,
  {C.ymdhms('last_activity')} AS last_activity, holding_period_days FROM holders_typed""")
def q_typed_holders(spark, sf):
    return _hsov(spark, sf).select("address", "balance", "stablecoin", "chain", "first_seen",
                                   "last_activity", "holding_period_days")


# --------------------------------------------------------------------- D2 / P5 / P6
_TX_OUT = f"""transaction_hash, block_number, {C.ymdhms('"timestamp"')} AS "timestamp", from_address, to_address,
  CAST(amount AS DOUBLE) AS amount, stablecoin, chain, activity_type, source_explorer, gas_used,
  CAST(gas_price AS DOUBLE) AS gas_price"""


@register("dedup_tx", C.with_ctes("TX") + f"SELECT {_TX_OUT} FROM tx")
def q_dedup_tx(spark, sf):
    """D2 itself: join + first-per-(hash, chain), computed (not read)."""
    return TD.canonical_tx(spark, sf)


@register("dedup_report", C.with_ctes("TX_RAW", extra="""
k AS (SELECT transaction_hash, chain, count(*) AS n FROM tx_raw GROUP BY 1, 2)""") + """
SELECT CAST(sum(n) AS BIGINT) AS input_rows, CAST(count(*) AS BIGINT) AS unique_rows,
  CAST(sum(n) - count(*) AS BIGINT) AS duplicates_removed FROM k""")
def q_dedup_report(spark, sf):
    return MG.duplicates_removed(TD.raw_transfers(spark, sf))


@register("classify_tx", C.with_ctes("TX_CLS") + """
SELECT chain, activity_type, CAST(count(*) AS BIGINT) AS n FROM tx_cls GROUP BY 1, 2""")
def q_classify_tx(spark, sf):
    return (CL.classify_transactions(TD.raw_transfers(spark, sf))
            .groupBy("chain", "activity_type").agg(F.count("*").cast("bigint").alias("n")))


@register("classify_collect", C.with_ctes("TX_COLLECT") + """
SELECT chain, activity_type, CAST(count(*) AS BIGINT) AS n FROM tx_collect GROUP BY 1, 2""")
def q_classify_collect(spark, sf):
    return (TD.raw_transfers(spark, sf)
            .groupBy("chain", "activity_type").agg(F.count("*").cast("bigint").alias("n")))


# --------------------------------------------------------------------- D1 / D3
def _holder_batches(spark, sf):
    tx = _tx(spark, sf)
    return [b.withColumn("ingest_key", F.struct("address", "stablecoin", "chain"))
            for b in (_holders(spark, sf), TD.supplier_holders(spark, sf))]


@register("union_sources", C.with_ctes("HOLDERS", "SUPP_HOLDERS") + """
SELECT source_explorer, CAST(src_rank AS BIGINT) AS source_rank, CAST(count(*) AS BIGINT) AS rows FROM (
  SELECT source_explorer, 0 AS src_rank FROM holders UNION ALL
  SELECT source_explorer, 1 FROM supp_holders) GROUP BY 1, 2""")
def q_union_sources(spark, sf):
    u = MG.union_sources(_holder_batches(spark, sf))
    return u.groupBy("source_explorer", F.col("ingest_key.source_rank").alias("source_rank")).agg(
        F.count("*").cast("bigint").alias("rows"))


@register("union_mixed_orders", C.with_ctes("HOLDERS", "SUPP_HOLDERS") + """
SELECT stablecoin, chain, 0 AS source_rank, first(address ORDER BY CAST(balance * 100 AS BIGINT), address) AS first_address,
  CAST(count(*) AS BIGINT) AS rows FROM holders GROUP BY 1, 2
UNION ALL SELECT stablecoin, chain, 1, min(address), CAST(count(*) AS BIGINT) FROM supp_holders GROUP BY 1, 2""")
def q_union_mixed_orders(spark, sf):
    """D1 with batches that order by a number and by text: each keeps its own order."""
    h = _holders(spark, sf)
    batches = [h.withColumn("ingest_key", F.struct((F.col("balance") * 100).cast("bigint").alias("cents"), "address")),
               TD.supplier_holders(spark, sf).withColumn("ingest_key", F.col("address"))]
    u = MG.union_sources(batches)
    return u.groupBy("stablecoin", "chain", F.col("ingest_key.source_rank").alias("source_rank")).agg(
        F.min_by("address", "ingest_key").alias("first_address"), F.count("*").cast("bigint").alias("rows"))


@register("merge_holders", C.with_ctes("HOLDERS", "SUPP_HOLDERS", extra="""
src AS (SELECT *, 0 AS r FROM holders UNION ALL SELECT *, 1 FROM supp_holders),
ps AS (SELECT lower(address) AS ak, stablecoin, chain, source_explorer, min(r) AS sf,
         max(balance) AS balance, min(first_seen) AS first_seen, max(last_activity) AS last_activity,
         bool_or(coalesce(is_store_of_value, false)) AS sov, bool_or(coalesce(is_sov_heuristic, false)) AS sovh,
         min(address) AS address
       FROM src GROUP BY 1, 2, 3, 4)""") + f"""
SELECT arg_min(address, sf) AS address, CAST(max(balance) AS DOUBLE) AS balance, stablecoin, chain,
  {C.ymdhms('min(first_seen)')} AS first_seen, {C.ymdhms('max(last_activity)')} AS last_activity,
  bool_or(sov) AS is_store_of_value, string_agg(source_explorer, ',' ORDER BY sf) AS source_explorer,
  bool_or(sovh) AS is_sov_heuristic
FROM ps GROUP BY ak, stablecoin, chain""")
def q_merge_holders(spark, sf):
    return MG.merge_holders(MG.union_sources(_holder_batches(spark, sf)))


# --------------------------------------------------------------------- D4 / D5
_SRC_RUN = C.with_ctes("TX", extra="""
cnt AS (SELECT source_explorer, count(*) AS n FROM tx WHERE source_explorer <> 'polygonscan' GROUP BY 1),
sr AS (SELECT s.source_explorer, coalesce(cnt.n, 0) > 0 AS success,
              CASE WHEN coalesce(cnt.n, 0) > 0 THEN 0 ELSE 1 END AS error_count
       FROM (VALUES ('etherscan'), ('bscscan'), ('polygonscan')) s(source_explorer)
       LEFT JOIN cnt ON cnt.source_explorer = s.source_explorer)""")


def _partial_runs(spark, sf):
    """Source runs of a collection in which one source delivered nothing."""
    return TD.source_runs(spark, _tx(spark, sf).where(F.col("source_explorer") != "polygonscan"))


@register("completeness_gate", _SRC_RUN + """
SELECT CAST(count_if(success) AS BIGINT) AS successful_sources, CAST(3 AS BIGINT) AS expected_sources,
  CAST(count_if(success) AS DOUBLE) / 3.0 AS completeness_ratio,
  coalesce(string_agg(CASE WHEN success THEN source_explorer END, ',' ORDER BY source_explorer), '') AS successful,
  coalesce(string_agg(CASE WHEN NOT success THEN source_explorer END, ',' ORDER BY source_explorer), '') AS failed
FROM sr""")
def q_completeness_gate(spark, sf):
    c = MG.completeness(_partial_runs(spark, sf))
    return c.select("successful_sources", "expected_sources", "completeness_ratio",
                    F.array_join("successful", ",").alias("successful"),
                    F.array_join("failed", ",").alias("failed"))


@register("gated_rows", _SRC_RUN + """
SELECT source_explorer, CAST(count(*) AS BIGINT) AS rows FROM tx
WHERE source_explorer IN (SELECT source_explorer FROM sr WHERE success) GROUP BY 1""")
def q_gated_rows(spark, sf):
    tx = _tx(spark, sf)
    g = MG.completeness_gate(_partial_runs(spark, sf), tx, min_sources=2)
    return g.groupBy("source_explorer").agg(F.count("*").cast("bigint").alias("rows"))


@register("collection_report", C.with_ctes("TX", "HOLDERS", extra="""
cnt AS (SELECT source_explorer, count(*) AS n FROM tx GROUP BY 1),
sr AS (SELECT s.source_explorer, CASE WHEN coalesce(cnt.n, 0) > 0 THEN 0 ELSE 1 END AS error_count
       FROM (VALUES ('etherscan'), ('bscscan'), ('polygonscan')) s(source_explorer)
       LEFT JOIN cnt ON cnt.source_explorer = s.source_explorer),
recs AS (SELECT source_explorer, count(*) AS records FROM (
           SELECT source_explorer FROM tx UNION ALL SELECT source_explorer FROM holders) GROUP BY 1),
r AS (SELECT coalesce(sr.source_explorer, recs.source_explorer) AS source_explorer,
             CAST(coalesce(recs.records, 0) AS BIGINT) AS records,
             CAST(coalesce(sr.error_count, 0) AS BIGINT) AS error_count, CAST(0.0 AS DOUBLE) AS seconds
      FROM sr FULL JOIN recs ON recs.source_explorer = sr.source_explorer)""") + """
SELECT *, error_count > 0 AND records = 0 AS failed, CAST(sum(records) OVER () AS BIGINT) AS total_records,
  sum(records) OVER () > 0 AS success FROM r""")
def q_collection_report(spark, sf):
    tx = _tx(spark, sf)
    return MG.collection_report(tx, _holders(spark, sf), TD.source_runs(spark, tx))


# --------------------------------------------------------------------- V1-V6, V8
def _amt_sql(e: str) -> str:
    """DuckDB form of V3 for a text expression ``e``."""
    ip = f"ltrim(regexp_extract({e}, '^([0-9]+)', 1), '0')"
    fr = f"regexp_extract({e}, '\\.([0-9]+)$', 1)"
    mx = f"'{RU.MAX_UINT256}'"
    return (f"coalesce(regexp_matches({e}, '^[0-9]+(\\.[0-9]{{1,18}})?$') AND ("
            f"length({ip}) < 78 OR (length({ip}) = 78 AND ({ip} < {mx} OR "
            f"({ip} = {mx} AND ({fr} = '' OR regexp_matches({fr}, '^0+$')))))), false)")


@register("dq_holder_record", C.with_ctes("HOLDERS", extra="""
r AS (SELECT address, CAST(balance AS VARCHAR) AS bal FROM holders)""") + f"""
SELECT address, bal AS balance_text,
  coalesce(regexp_matches(address, '^0x[a-fA-F0-9]{{40}}$'), false) AS address_ok,
  {_amt_sql('bal')} AS amount_ok,
  array_to_string(list_filter([CASE WHEN NOT coalesce(regexp_matches(address, '^0x[a-fA-F0-9]{{40}}$'), false) THEN 'address' END,
                               CASE WHEN NOT {_amt_sql('bal')} THEN 'balance' END], lambda x: x IS NOT NULL), ',') AS errors
FROM r""")
def q_dq_holder_record(spark, sf):
    h = _holders(spark, sf).select("address", F.col("balance").cast("decimal(18,2)").cast("string").alias("balance"))
    e = QL.holder_record_errors(h)
    return e.select("address", F.col("balance").alias("balance_text"),
                    RU.address_ok("address").alias("address_ok"), RU.amount_ok("balance").alias("amount_ok"),
                    F.array_join("errors", ",").alias("errors"))


@register("dq_tx_record", C.with_ctes("TX_RAW", extra="""
mk AS (SELECT chain, max(block_number) AS mx FROM tx_raw GROUP BY chain),
r AS (SELECT CASE WHEN t.block_number % 13 = 0 THEN left(t.transaction_hash, 60) ELSE t.transaction_hash END AS transaction_hash,
             t.chain, CASE WHEN t.block_number % 17 = 0 THEN 'x' || t.from_address ELSE t.from_address END AS from_address,
             CASE WHEN t.block_number % 19 = 0 THEN NULL ELSE t.to_address END AS to_address,
             CASE WHEN t.block_number % 23 = 0 THEN '-' ELSE '' END || CAST(t.amount AS VARCHAR) AS amt,
             CASE WHEN t.block_number % 29 = 0 THEN t.block_number + 1000000000 ELSE t.block_number END AS block_number,
             mk.mx FROM tx_raw t JOIN mk ON mk.chain = t.chain)""") + f"""
SELECT CAST(count(*) AS BIGINT) AS records,
  CAST(count_if(NOT coalesce(regexp_matches(transaction_hash, '^0x[a-fA-F0-9]{{64}}$'), false)) AS BIGINT) AS bad_hash,
  CAST(count_if(NOT coalesce(regexp_matches(from_address, '^0x[a-fA-F0-9]{{40}}$'), false)) AS BIGINT) AS bad_from,
  CAST(count_if(NOT coalesce(regexp_matches(to_address, '^0x[a-fA-F0-9]{{40}}$'), false)) AS BIGINT) AS bad_to,
  CAST(count_if(NOT {_amt_sql('amt')}) AS BIGINT) AS bad_amount,
  CAST(count_if(NOT coalesce(block_number >= 0 AND (mx IS NULL OR block_number <= mx + 1000), false)) AS BIGINT) AS bad_block
FROM r""")
def q_dq_tx_record(spark, sf):
    raw = TD.raw_transfers(spark, sf)
    mk = raw.groupBy("chain").agg(F.max("block_number").alias("_mx"))
    b = F.col("block_number")
    text = F.col("amount").cast("decimal(18,2)").cast("string")
    # records damaged by key, so that every rule fires
    r = raw.join(F.broadcast(mk), "chain").select(
        F.when(b % 13 == 0, F.substring("transaction_hash", 1, 60)).otherwise(F.col("transaction_hash")).alias("transaction_hash"),
        "chain", F.when(b % 17 == 0, F.concat(F.lit("x"), "from_address")).otherwise(F.col("from_address")).alias("from_address"),
        F.when(b % 19 != 0, F.col("to_address")).alias("to_address"),
        F.when(b % 23 == 0, F.concat(F.lit("-"), text)).otherwise(text).alias("amount"),
        F.when(b % 29 == 0, b + 1000000000).otherwise(b).alias("block_number"), "_mx")
    e = QL.tx_record_errors(r, max_known="_mx")
    has = lambda f: F.count_if(F.array_contains("errors", f)).cast("bigint")
    return e.agg(F.count("*").cast("bigint").alias("records"), has("transaction_hash").alias("bad_hash"),
                 has("from_address").alias("bad_from"), has("to_address").alias("bad_to"),
                 has("amount").alias("bad_amount"), has("block_number").alias("bad_block"))


@register("dq_timestamp", f"""
SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'ethereum' WHEN 1 THEN 'bsc' ELSE 'polygon' END AS chain,
  coalesce(epoch(CAST(ts AS TIMESTAMP)) >= CASE user_id % 3 WHEN 0 THEN {dims.GENESIS['ethereum']} WHEN 1 THEN {dims.GENESIS['bsc']} ELSE {dims.GENESIS['polygon']} END
       AND CAST(floor(epoch(CAST(ts AS TIMESTAMP))) AS BIGINT) <= epoch(TIMESTAMP '2024-01-15 00:00:00') + 300, false) AS timestamp_ok
FROM events""")
def q_dq_timestamp(spark, sf):
    ev = TD.table(spark, sf, "events").select("event_id", "user_id", SC.ensure_utc("ts").alias("ts"))
    chain = TD._chain_of_key("user_id")
    return ev.select("event_id", chain.alias("chain"),
                     RU.timestamp_ok(F.unix_seconds("ts"), chain, "2024-01-15 00:00:00").alias("timestamp_ok"))


@register("invariants_holder", C.with_ctes("HOLDERS") + """
SELECT address, array_to_string(list_filter([
   CASE WHEN NOT coalesce(balance >= 0, false) THEN 'balance' END,
   CASE WHEN NOT (first_seen IS NULL OR last_activity IS NULL OR first_seen <= last_activity) THEN 'last_activity' END],
   lambda x: x IS NOT NULL), ',') AS errors
FROM holders WHERE NOT coalesce(balance >= 0, false)
   OR NOT (first_seen IS NULL OR last_activity IS NULL OR first_seen <= last_activity)""")
def q_invariants_holder(spark, sf):
    e = QL.holder_invariant_errors(_holders(spark, sf))
    _, quarantine, _ = QL.split_valid(e)
    return quarantine.select("address", F.array_join("errors", ",").alias("errors"))


@register("invariants_tx", C.with_ctes("TX") + """
SELECT CAST(count(*) AS BIGINT) AS records,
  CAST(count_if(NOT (block_number >= 0 AND amount >= 0 AND (gas_used IS NULL OR gas_used >= 0)
        AND (gas_price IS NULL OR gas_price >= 0))) AS BIGINT) AS rejected FROM tx""")
def q_invariants_tx(spark, sf):
    e = QL.tx_invariant_errors(_tx(spark, sf))
    return e.agg(F.count("*").cast("bigint").alias("records"),
                 F.count_if(F.size("errors") > 0).cast("bigint").alias("rejected"))


#: (field, its damaged value in SQL, in export text or None: no such damage); the place is the key of the damaged rows
_BAD_TX = [("transaction_hash", "''", ""), ("from_address", "NULL", None), ("to_address", "' '", " "), ("block_number", "-1", "-1"),
           ("amount", "CAST(-0.5 AS DECIMAL(38,18))", "1e"), ("gas_used", "-1", "-1"), ("gas_price", "CAST(-2 AS DECIMAL(38,9))", "x"),
           ("stablecoin", "'DAI'", "DAI"), ("chain", "'tron'", ""), ("activity_type", "'mint'", "mint"), ("timestamp", "", "2024-13-01"),
           ("source_explorer", "", "")]


def _damaged_tx(tx, key, values):
    """Rows whose key is a place in ``values`` get that field's bad value."""
    for place, (field, value) in enumerate(values):
        if value is not None:
            own = F.expr(value[1:]) if value.startswith("=") else F.lit(value)
            tx = tx.withColumn(field, F.when(key == place, own.cast(tx.schema[field].dataType)).otherwise(F.col(field)))
    return tx


@register("invariants_tx_damaged", C.with_ctes("TX") + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, CAST(count(*) AS BIGINT) AS rejected FROM tx WHERE block_number % 31 = {i}" for i, (f, v, _) in enumerate(_BAD_TX) if v)
    + ") WHERE rejected > 0 UNION ALL SELECT 'valid', CAST(count(*) AS BIGINT) FROM tx WHERE block_number % 31 NOT IN ("
    + ", ".join(str(i) for i, (_, v, _) in enumerate(_BAD_TX) if v) + ")")
def q_invariants_tx_damaged(spark, sf):
    """V8: every constructor rule rejects its own damaged rows."""
    bad = _damaged_tx(_tx(spark, sf), F.col("block_number") % 31, [(f, f"={v}" if v else None) for f, v, _ in _BAD_TX])
    valid, _, counts = QL.split_valid(QL.tx_invariant_errors(bad))
    return counts.unionByName(valid.agg(F.lit("valid").alias("field"), F.count("*").cast("bigint").alias("rejected")))


@register("validate_export_tx", C.with_ctes("TX", extra="""
p AS (SELECT block_number % 37 AS k, row_number() OVER (ORDER BY transaction_hash || '|' || chain) - 1 AS pos FROM tx)""") + " UNION ALL ".join(
    f"SELECT 'transactions[' || CAST(pos AS VARCHAR) || '].{f}: invalid' AS error FROM p WHERE k = {i}"
    for i, (f, _, v) in enumerate(_BAD_TX) if v is not None))
def q_validate_export_tx(spark, sf):
    """V9 record rules over the export form of the transfers, damaged by key, with the index of each record."""
    tx = _tx(spark, sf).withColumn("_key", F.concat_ws("|", "transaction_hash", "chain"))
    from tokenflow.operators.rank import value_ranks
    ranks = value_ranks(tx, "_key").select(F.col("_key").alias("_a"), F.col("_below").alias("pos"))
    text = tx.select("_key", (F.col("block_number") % 37).alias("_place"), *[F.col(c).cast("string").alias(c) for c in TX_STRING.fieldNames()])
    text = text.withColumn("timestamp", F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    bad = _damaged_tx(text, F.col("_place"), [(f, v) for f, _, v in _BAD_TX])
    placed = bad.join(ranks, F.col("_key") == F.col("_a"))
    return QL.export_tx_errors(placed).select(F.explode("errors").alias("error"))


_META_ERRORS = {0: "run_id", 1: "collection_timestamp", 2: "agent_version", 3: "explorers_queried", 4: "total_records"}


@register("validate_export_parts", C.with_ctes("TX") + "SELECT 'metadata ' || CAST(event_id AS VARCHAR) AS part, CASE event_id % 6 " + " ".join(
    f"WHEN {k} THEN 'metadata.{f}: missing or invalid'" for k, f in _META_ERRORS.items()) + """ END AS error FROM events WHERE event_id % 6 < 5
UNION ALL SELECT 'summary', 'summary.by_chain: missing'
UNION ALL SELECT 'summary', 'summary.by_stablecoin.' || stablecoin || '.count: invalid' FROM (SELECT DISTINCT stablecoin FROM tx)
UNION ALL SELECT 'summary', 'summary.by_activity_type.other.volume: invalid'""")
def q_validate_export_parts(spark, sf):
    """V9 rules of metadata (one document per event) and summary, damaged by key."""
    i, k = F.col("event_id"), F.col("event_id") % 6
    keep = lambda n, good, bad: F.when(k == n, F.lit(bad).cast("string") if n != 3 else F.lit(None).cast("array<string>")).otherwise(good)
    meta = TD.table(spark, sf, "events").select(
        "event_id", keep(0, i.cast("string"), " ").alias("run_id"), keep(1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "today").alias("collection_timestamp"),
        keep(2, F.lit("1.0.0"), None).alias("agent_version"), keep(3, F.array(F.lit("etherscan")), None).alias("explorers_queried"),
        keep(4, F.lit("7"), "7.5").alias("total_records"))
    meta = QL.export_metadata_errors(meta).select(F.concat_ws(" ", F.lit("metadata"), F.col("event_id").cast("string")).alias("part"), F.explode("errors").alias("error"))
    summary = SM.sample_summary(_tx(spark, sf)).where("kind <> 'chain'").withColumns({
        "count": F.when(F.col("kind") == "stablecoin", -F.col("count") - 1).otherwise(F.col("count")),
        "volume": F.when(F.col("key") == "other", F.lit(None)).otherwise(F.col("volume"))})
    return meta.unionByName(QL.export_summary_errors(summary).select(F.lit("summary").alias("part"), "error"))


@register("required_tx", C.with_ctes("TX") + """
SELECT CAST(count(*) AS BIGINT) AS kept FROM tx
WHERE block_number % 13 <> 0 AND block_number % 17 <> 0 AND block_number % 19 <> 0 AND block_number % 23 <> 0""")
def q_required_tx(spark, sf):
    b = F.col("block_number")
    tx = _tx(spark, sf).withColumns({  # required fields blanked by key
        "transaction_hash": F.when(b % 13 != 0, F.col("transaction_hash")),
        "timestamp": F.when(b % 17 != 0, F.col("timestamp")),
        "chain": F.when(b % 19 == 0, F.lit(" ")).otherwise(F.col("chain")),
        "to_address": F.when(b % 23 == 0, F.lit("")).otherwise(F.col("to_address"))})
    return QL.required_tx(tx).agg(F.count("*").cast("bigint").alias("kept"))


@register("required_holder", C.with_ctes("HOLDERS") + """
SELECT CAST(count(*) AS BIGINT) AS kept FROM holders
WHERE CAST(balance * 100 AS BIGINT) % 7 <> 0 AND CAST(balance * 100 AS BIGINT) % 11 <> 0""")
def q_required_holder(spark, sf):
    c = (F.col("balance") * 100).cast("bigint")
    h = _holders(spark, sf).withColumns({"stablecoin": F.when(c % 11 == 0, F.lit("")).otherwise(F.col("stablecoin")),
                                         "balance": F.when(c % 7 != 0, F.col("balance"))})
    return QL.required_holder(h).agg(F.count("*").cast("bigint").alias("kept"))


@register("enum_check", C.with_ctes("TXC") + """
SELECT activity_type, CAST(count(*) AS BIGINT) AS rows FROM txc
WHERE activity_type IS NOT NULL AND activity_type NOT IN ('transaction', 'store_of_value', 'other')
GROUP BY 1""")
def q_enum_check(spark, sf):
    bad = QL.invalid_enum_rows(TD.collected_tx_table(spark, sf), "activity_type", dims.ACTIVITY_TYPES)
    return bad.groupBy("activity_type").agg(F.count("*").cast("bigint").alias("rows"))


@register("run_filters", C.with_ctes("TX") + f"""
SELECT {_TX_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY source_explorer, stablecoin
    ORDER BY block_number DESC, "timestamp" DESC, transaction_hash) AS rn FROM tx
  WHERE source_explorer IN ('etherscan', 'polygonscan') AND stablecoin IN ('USDC', 'USDT')) WHERE rn <= 1000""")
def q_run_filters(spark, sf):
    return QL.run_filters(_tx(spark, sf), ["etherscan", "polygonscan"], ["USDC", "USDT"], 1000)


# --------------------------------------------------------------------- S5 / P1-P3 / S6 / P4
_P5 = f"""CASE WHEN lower(from_address) = {C.ZERO} THEN 'other' WHEN lower(to_address) = {C.ZERO} THEN 'other'
  WHEN amount > 0 AND length(from_address) > 0 AND length(to_address) > 0 THEN 'transaction' ELSE 'unknown' END"""


def _transfer_pages(spark, sf):
    """Landed transfer pages (the input of S5), written once."""
    return TD.written(spark, sf, "transfer_pages", lambda: PG.landed_transfer_pages(_tx(spark, sf)))


def _holder_pages(spark, sf):
    return TD.written(spark, sf, "holder_pages", lambda: PG.landed_holder_pages(_holders(spark, sf)))


@register("read_api_transfers", C.with_ctes("TX") + f"""
SELECT transaction_hash, block_number, {C.ymdhms('"timestamp"')} AS "timestamp", lower(from_address) AS from_address,
  lower(to_address) AS to_address, CAST(amount AS DOUBLE) AS amount, stablecoin, chain, {_P5} AS activity_type,
  source_explorer, gas_used, CAST(gas_price AS DOUBLE) AS gas_price
FROM tx""")
def q_read_api_transfers(spark, sf):
    pages = _transfer_pages(spark, sf)
    valid, _, _ = QL.split_valid(PG.read_api_transfers(pages, limit=None))  # whole landed data
    return valid.drop("ingest_key")


_FIRST = 2500
_NEWEST_DAY = "2001-12-31"


@register("read_api_transfers_first", C.with_ctes("TX") + f"""
SELECT transaction_hash, block_number, lower(from_address) AS from_address, CAST(amount AS DOUBLE) AS amount, stablecoin, chain, source_explorer
FROM (SELECT *, row_number() OVER (PARTITION BY source_explorer, stablecoin, chain
  ORDER BY date_diff('day', CAST("timestamp" AS DATE), DATE '{_NEWEST_DAY}'), block_number DESC, transaction_hash DESC) AS rn FROM tx)
WHERE rn <= {_FIRST}""")
def q_read_api_transfers_first(spark, sf):
    """S5 with a fetch limit: one page file per day, numbered from the newest day on, so page_10 follows page_9."""
    day = F.datediff(F.lit(_NEWEST_DAY).cast("date"), F.to_date(F.timestamp_seconds(F.col("rec.timeStamp").cast("bigint"))))
    pages = TD.written(spark, sf, "day_pages", lambda: PG.landed_transfer_pages(_tx(spark, sf), page=day), shares=("page", 4))  # landed once, as S5's other pages
    pages = pages.withColumn("file", F.concat_ws("/", F.lit("landing"), "source_explorer", F.concat(F.lit("page_"), F.col("page"), F.lit(".json"))))
    valid, _, _ = QL.split_valid(PG.read_api_transfers(pages.drop("page"), limit=_FIRST))
    return valid.select("transaction_hash", "block_number", "from_address", "amount", "stablecoin", "chain", "source_explorer")


_LONG_NUMBERS = [("timeStamp", 13, "99999999999999999"), ("blockNumber", 17, "9" * 30), ("gasUsed", 19, "1" * 25),
                 ("gasPrice", 23, "1" + "0" * 40), ("value", 29, "9" * 60)]


@register("api_transfer_rejects", C.with_ctes("TX") + " UNION ALL ".join(
    f"SELECT '{f}' AS field, CAST(count(*) AS BIGINT) AS rejected FROM tx WHERE block_number % {m} = 0 HAVING count(*) > 0" for f, m, _ in _LONG_NUMBERS))
def q_api_transfer_rejects(spark, sf):
    """Numbers too long for their type reject their record and stop nothing."""
    def damage(r):
        rec = F.col("rec")
        for f, m, bad in _LONG_NUMBERS:
            rec = rec.withField(f, F.when(F.col("block_number") % m == 0, F.lit(bad)).otherwise(F.col(f"rec.{f}")))
        return r.withColumn("rec", rec)

    _, _, counts = QL.split_valid(PG.read_api_transfers(PG.landed_transfer_pages(_tx(spark, sf), change=damage)))
    return counts


@register("read_api_holders", C.with_ctes("HOLDERS") + """
SELECT lower(address) AS address, CAST(balance AS DOUBLE) AS balance, stablecoin, chain,
  CAST(NULL AS VARCHAR) AS first_seen, CAST(NULL AS VARCHAR) AS last_activity, false AS is_store_of_value,
  source_explorer, false AS is_sov_heuristic
FROM holders WHERE balance >= 0""")
def q_read_api_holders(spark, sf):
    pages = _holder_pages(spark, sf)
    valid, _, _ = QL.split_valid(PG.read_api_holders(pages, cap=None))
    return valid


@register("api_holder_rejects", C.with_ctes("HOLDERS") + """
SELECT 'TokenHolderQuantity' AS field, CAST(count(*) AS BIGINT) AS rejected FROM holders WHERE balance < 0""")
def q_api_holder_rejects(spark, sf):
    pages = _holder_pages(spark, sf)
    _, _, counts = QL.split_valid(PG.read_api_holders(pages, cap=None))
    return counts


# --------------------------------------------------------------------- V11 / V12 / V16
@register("response_status", C.with_ctes("TX") + """
SELECT event_id, event_id % 5 IN (0, 1) AS response_ok, event_id % 5 = 1 AS is_empty, event_id % 5 = 2 AS rate_limited,
  event_id % 5 = 3 AS pro_only, event_id % 5 IN (0, 1) AS result_is_array FROM events""")
def q_response_status(spark, sf):
    """One response per event, of every form that an explorer gives."""
    forms = [("1", "OK", "[]"), ("0", "No transactions found", "[]"), ("0", "NOTOK", "Max rate limit reached"),
             ("0", "NOTOK", "This endpoint needs API Pro"), (None, None, None)]
    k = F.col("event_id") % 5
    cols = []
    for i, name in enumerate(("status", "message", "result")):
        c = F.lit(None).cast("string")
        for j, form in enumerate(forms):
            c = F.when(k == j, F.lit(form[i])).otherwise(c)
        cols.append(c.alias(name))
    pages = TD.table(spark, sf, "events").select("event_id", *cols)
    return PG.response_status(pages).select("event_id", "response_ok", "is_empty", "rate_limited", "pro_only", "result_is_array")


_B = "block_number % 61"
#: (field, JSON of its damaged value or None: left out, problem, explorers whose rules object); the place is the key of the damaged rows
_TX_DAMAGE = [(f, None, "is required", "all") for f in ("blockNumber", "timeStamp", "hash", "from", "to", "value", "contractAddress")] + [
    (f, '"1x"', "does not match pattern", "all") for f in (
        "blockNumber", "timeStamp", "hash", "nonce", "blockHash", "from", "contractAddress", "to", "value", "tokenDecimal",
        "transactionIndex", "gas", "gasPrice", "gasUsed", "cumulativeGasUsed", "confirmations")] + [
    ("input", '"zz"', "does not match pattern", "etherscan bscscan"), ("tokenName", '""', "is too short", "bscscan"),
    ("tokenSymbol", '""', "is too short", "bscscan"), ("value", "7", "is not text", "all"), ("tokenName", "{}", "is not text", "all"),
    ("nonce", "null", "is not text", "all")]
_MORE_FIELDS = {"nonce": "7", "tokenName": "Coin", "tokenSymbol": "C", "tokenDecimal": "6", "transactionIndex": "0", "gas": "21000",
                "cumulativeGasUsed": "5", "input": "0x", "confirmations": "9", "blockHash": "0x" + "ab" * 32, "other": "?"}


def _damaged(records, key, damage):
    """JSON text of ``rec``, the field of the damage that its key names left out or replaced."""
    own = records.schema["rec"].dataType.names
    parts = []
    for field in dict.fromkeys([*own, *(f for f, *_ in damage)]):
        whole = F.col(f"rec.{field}") if field in own else F.lit(_MORE_FIELDS[field])
        value = F.concat(F.lit(f'"{field}":"'), whole, F.lit('"'))  # digits, addresses and names: nothing to escape
        for place, (f, bad, *_) in enumerate(damage):
            if f == field:
                value = F.when(key == place, F.lit(None) if bad is None else F.lit(f'"{field}":{bad}')).otherwise(value)
        parts.append(value)
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _damage_sql(table, key, damage, prefix="result[*]."):
    return " UNION ALL ".join(
        f"SELECT source_explorer, stablecoin, chain, '{prefix}{f} {problem}' AS error FROM {table} WHERE {key} = {place}"
        + ("" if who == "all" else " AND source_explorer IN (" + ", ".join(f"'{x}'" for x in who.split()) + ")")
        for place, (f, _, problem, who) in enumerate(damage))


def _counted_errors(pages, endpoint):
    pages = RR.check_responses(pages.select("source_explorer", "stablecoin", "chain", F.lit(endpoint).alias("endpoint"),
                                            RR.answer_text().alias("body")), max_depth=None)
    # outer: the plain form adds a filter on the array, which evaluates all rules of a page once more for each of its conditions
    e = pages.select("source_explorer", "stablecoin", "chain", F.explode_outer("schema_errors").alias("e")).where(F.col("e").isNotNull())
    return e.groupBy("source_explorer", "stablecoin", "chain", F.regexp_replace("e", r"\[[0-9]+\]", "[*]").alias("error")).agg(
        F.count("*").cast("bigint").alias("n"))


@register("response_schema", C.with_ctes("TX") + f"""
SELECT source_explorer, stablecoin, chain, error, CAST(count(*) AS BIGINT) AS n FROM (
{_damage_sql("tx", _B, _TX_DAMAGE)}) GROUP BY 1, 2, 3, 4""")
def q_response_schema(spark, sf):
    """Problems per group and field of transfer pages whose records are damaged by key, under each explorer's rules."""
    def damage(r):
        return r.withColumn("rec", _damaged(r, F.col("block_number") % 61, _TX_DAMAGE))

    return _counted_errors(PG.landed_transfer_pages(_tx(spark, sf), change=damage), "tokentx")


_HOLDER_DAMAGE = [("TokenHolderAddress", None, "is required", "all"), ("TokenHolderAddress", '"0x12"', "does not match pattern", "all"),
                  ("TokenHolderQuantity", None, "is required", "all"), ("TokenHolderQuantity", '"1.5"', "does not match pattern", "all"),
                  ("TokenHolderQuantity", "[]", "is not text", "all")]
_CENTS = "((CAST(balance * 100 AS BIGINT) % 31) + 31) % 31"


@register("holder_response_schema", C.with_ctes("HOLDERS") + f"""
SELECT source_explorer, stablecoin, chain, error, CAST(count(*) AS BIGINT) AS n FROM (
{_damage_sql("holders", _CENTS, _HOLDER_DAMAGE)}
UNION ALL SELECT source_explorer, stablecoin, chain, 'result[*].TokenHolderQuantity does not match pattern' FROM holders
  WHERE balance < 0 AND {_CENTS} NOT IN (2, 3, 4)) GROUP BY 1, 2, 3, 4""")
def q_holder_response_schema(spark, sf):
    """The same on holder pages; negative balances are no digits."""
    h = _holders(spark, sf)

    def damage(r):
        cents = F.col("rec.TokenHolderQuantity")
        return r.withColumn("rec", _damaged(r, F.col("k"), _HOLDER_DAMAGE)).drop("k")

    keyed = h.select("address", "stablecoin", "chain", "source_explorer", F.pmod((F.col("balance") * 100).cast("bigint"), F.lit(31)).alias("k"))
    pages = PG.landed_holder_pages(h, change=lambda r: damage(r.join(keyed, ["address", "stablecoin", "chain", "source_explorer"])))
    return _counted_errors(pages, "tokenholderlist")


_NOTICE = "CASE WHEN event_id % 3 = 1 AND event_id % 2 = 1 THEN '{}' ELSE '' END"
#: (answer, problems) of every form; the last ones depend on the explorer and the endpoint
_ANSWERS = [
    ('{"status":"1","message":"OK","result":[]}', "''"),
    ('{"status":"2","message":"OK","result":[]}', "'status is not an allowed value'"),
    ('{"status":1,"message":"OK","result":[]}', "'status is not text'"),
    ('{"status":"1","result":[]}', "'message is required'"),
    ('{"status":"1","message":null}', "'message is not text,result is required'"),
    ('{"status":"1","message":"OK","result":[],"trace":"x"}', "'trace is not expected'"),
    ('{"status":"1","message":"OK","result":5}', "'result matches no allowed form'"),
    ('{"status":"1","message":"OK","result":[3]}', "'result[0] is not an object'"),
    ('<html>busy</html>', "'answer is not JSON'"), ('[]', "'answer is not an object'"), (None, "'answer is not JSON'"),
    ('{"status":"0","message":"NOTOK","result":"Max rate limit reached"}', _NOTICE.format("result does not match pattern")),
    ('{"status":"0","message":"NOTOK","result":""}', _NOTICE.format("result is too short,result does not match pattern")),
    ('{"status":"0","message":"NOTOK","result":"Error: ' + "x" * 500 + '"}', _NOTICE.format("result is too long")),
    ('{"status":"0","message":"NOTOK","result":"No token holder found"}', "''"),
    ('{"status":"1","message":"OK","result":[[[[[[[[[[[[]]]]]]]]]]]]}', "'answer is nested too deeply'")]


@register("response_envelope", f"""
SELECT event_id, CASE event_id % {len(_ANSWERS) + 1} {' '.join(f"WHEN {i} THEN {e}" for i, (_, e) in enumerate(_ANSWERS))}
  ELSE 'no rules for this explorer and endpoint' END AS errors,
  CASE WHEN event_id % {len(_ANSWERS) + 1} < {len(_ANSWERS)} THEN '1.0.0' END AS schema_version FROM events""")
def q_response_envelope(spark, sf):
    """One answer per event, of every form, under the rules of all explorers and endpoints; the last form has no rules."""
    i = F.col("event_id")
    form = i % (len(_ANSWERS) + 1)
    body = F.lit(None).cast("string")
    for k, (text, _) in enumerate(_ANSWERS):
        body = F.when(form == k, F.lit(text)).otherwise(body)
    explorer = F.when(form == len(_ANSWERS), "unknownscan").when(i % 3 == 0, "etherscan").when(i % 3 == 1, "BscScan").otherwise("polygonscan")
    ev = TD.table(spark, sf, "events").select(
        "event_id", body.alias("body"), explorer.alias("source_explorer"), F.when(i % 2 == 0, "tokentx").otherwise("tokenholderlist").alias("endpoint"))
    return RR.check_responses(ev).select("event_id", F.array_join("schema_errors", ",").alias("errors"), "schema_version")


@register("schema_version_class", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'minor' WHEN event_id % 3 <> 1 THEN 'major'
  WHEN event_id % 5 <> 2 THEN 'minor' WHEN event_id % 4 <> 3 THEN 'patch' ELSE 'none' END AS change FROM events""")
def q_schema_version_class(spark, sf):
    """Versions from the header, or from the body where it has none."""
    i = F.col("event_id")
    v = F.concat_ws(".", *[(i % m).cast("string") for m in (3, 5, 4)])
    head = F.when(i % 7 == 0, F.lit("v1")).when(i % 2 == 0, v)
    body = F.concat(F.lit('{"meta": {"schemaVersion": "'), v, F.lit('"}}'))
    ev = TD.table(spark, sf, "events").select("event_id", PG.detect_version(head, body).alias("detected"))
    return ev.select("event_id", PG.schema_version_class("detected", F.lit("1.2.3")).alias("change"))


# --------------------------------------------------------------------- S8 / P12 / P13
@register("source_select", C.with_ctes("TX", extra="""
con AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k}', '{c}', '{a}')" for k, c, a in dims.CONTRACTS) + """) t(stablecoin, chain, contract))""") + """
SELECT tx.source_explorer, tx.stablecoin, con.contract, CAST(count(*) AS BIGINT) AS rows
FROM tx JOIN con ON con.stablecoin = tx.stablecoin AND con.chain = tx.chain
WHERE tx.source_explorer IN ('etherscan', 'bscscan') GROUP BY 1, 2, 3""")
def q_source_select(spark, sf):
    from tokenflow.plans.pipeline import select_sources
    s = select_sources(spark, ["etherscan", "bscscan"])
    tx = _tx(spark, sf).join(F.broadcast(s), ["source_explorer", "stablecoin", "chain"])
    return tx.groupBy("source_explorer", "stablecoin", "contract").agg(F.count("*").cast("bigint").alias("rows"))


@register("gas_cost_native", C.with_ctes("TX") + """
SELECT transaction_hash, chain, CAST(CAST(gas_used AS DECIMAL(38,0)) * CAST(gas_price AS DECIMAL(38,0)) AS DOUBLE) / 1e18 AS gas_cost
FROM tx WHERE gas_used IS NOT NULL AND gas_price IS NOT NULL""")
def q_gas_cost_native(spark, sf):
    return (_tx(spark, sf).where(F.col("gas_used").isNotNull() & F.col("gas_price").isNotNull())
            .select("transaction_hash", "chain", SC.gas_cost_native("gas_used", "gas_price").alias("gas_cost")))


@register("gas_cost_extremes", C.with_ctes("TX") + """
SELECT chain, CAST(count(*) AS BIGINT) AS transaction_count, CAST(count(*) - count(wei) AS BIGINT) AS excluded_gas_count,
  CASE WHEN count(wei) > 0 THEN CAST(sum(wei) AS DOUBLE) / CAST(count(wei) AS DOUBLE) / 1e18 END AS avg_gas_cost
FROM (SELECT chain, CASE block_number % 5 WHEN 0 THEN CAST(gas_used AS HUGEINT) * 100000000000000000000
    WHEN 1 THEN NULL ELSE CAST(gas_used AS HUGEINT) * CAST(gas_price AS HUGEINT) END AS wei FROM tx) GROUP BY chain""")
def q_gas_cost_extremes(spark, sf):
    """P13 and A10 with prices of 1e20 wei (paid) and 1e28 wei (excluded) among the rows."""
    b, price = F.col("block_number") % 5, F.col("gas_price")
    tx = _tx(spark, sf).withColumn("gas_price", F.when(price.isNull(), price).when(b == 0, F.lit("1" + "0" * 20).cast("decimal(38,9)"))
                                   .when(b == 1, F.lit("1" + "0" * 28).cast("decimal(38,9)")).otherwise(price))
    return A.by_chain(tx).where("transaction_count > 0").select("chain", "transaction_count", "excluded_gas_count", "avg_gas_cost")


@register("period_bucket", C.with_ctes("TX") + f"""
SELECT {C.ymd('CAST("timestamp" AS DATE)')} AS day, {C.ymd(C.week_tue('"timestamp"'))} AS week,
  {C.ymd(C.period_sql('"timestamp"', 'monthly'))} AS month, CAST(count(*) AS BIGINT) AS n
FROM tx GROUP BY 1, 2, 3""")
def q_period_bucket(spark, sf):
    t = _tx(spark, sf)
    return (t.select(SC.period_bucket("timestamp", "daily").alias("day"),
                     SC.period_bucket("timestamp", "weekly").alias("week"),
                     SC.period_bucket("timestamp", "monthly").alias("month"))
            .groupBy("day", "week", "month").agg(F.count("*").cast("bigint").alias("n")))


@register("explorer_for_chain", """
SELECT CASE o_custkey % 4 WHEN 0 THEN 'ethereum' WHEN 1 THEN 'bsc' WHEN 2 THEN 'polygon' ELSE 'avalanche' END AS chain,
  CASE o_custkey % 4 WHEN 0 THEN 'etherscan' WHEN 1 THEN 'bscscan' WHEN 2 THEN 'polygonscan' ELSE 'etherscan' END AS explorer,
  CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2""")
def q_explorer_for_chain(spark, sf):
    o = TD.table(spark, sf, "orders").select("o_custkey")
    k = F.col("o_custkey") % 4
    chain = F.when(k == 0, "ethereum").when(k == 1, "bsc").when(k == 2, "polygon").otherwise("avalanche")
    return (o.select(chain.alias("chain")).select("chain", SC.explorer_for_chain(F.col("chain")).alias("explorer"))
            .groupBy("chain", "explorer").agg(F.count("*").cast("bigint").alias("n")))


@register("normalize_address", C.with_ctes("HOLDERS", "SUPP_HOLDERS") + """
SELECT lower(a) AS normalized, CASE WHEN regexp_matches(a, '^0x[a-fA-F0-9]{40}$') THEN lower(a) END AS validated
FROM (SELECT upper(substring(address, 3)) AS a FROM holders UNION ALL SELECT '0x' || upper(substring(address, 3)) FROM supp_holders)""")
def q_normalize_address(spark, sf):
    h = _holders(spark, sf).select(F.upper(F.substr("address", F.lit(3))).alias("a"))
    s = TD.supplier_holders(spark, sf).select(F.concat(F.lit("0x"), F.upper(F.substr("address", F.lit(3)))).alias("a"))
    u = h.unionByName(s)
    return u.select(SC.normalize_address("a").alias("normalized"),
                    SC.validate_and_normalize_address("a").alias("validated"))


@register("safe_parse", C.with_ctes("TX_RAW") + f"""
SELECT transaction_hash, CAST(TRY_CAST(amt AS DECIMAL(38,18)) AS DOUBLE) AS amount,
  {C.ymdhms('TRY_CAST(ts AS TIMESTAMP)')} AS "timestamp" FROM (
  SELECT transaction_hash,
    CASE WHEN gas_used IS NULL THEN 'n/a' ELSE CAST(amount AS VARCHAR) END AS amt,
    CASE WHEN gas_used IS NULL THEN '' ELSE strftime("timestamp", '%Y-%m-%dT%H:%M:%SZ') END AS ts
  FROM tx_raw)""")
def q_safe_parse(spark, sf):
    raw = TD.raw_transfers(spark, sf)
    s = raw.select("transaction_hash",
                   F.when(F.col("gas_used").isNull(), F.lit("n/a"))
                   .otherwise(F.col("amount").cast("decimal(18,2)").cast("string")).alias("amt"),
                   F.when(F.col("gas_used").isNull(), F.lit(""))
                   .otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ts"))
    return s.select("transaction_hash", SC.safe_decimal("amt").alias("amount"),
                    SC.safe_timestamp("ts").alias("timestamp"))


# --------------------------------------------------------------------- M1 / W1 / M3 / M4 / A24
from tokenflow.operators import features as FE  # noqa: E402

_FEATS = C.with_ctes("TX", "HOLDERS", extra=f"""
ends AS (SELECT lower(from_address) AS a, true AS o, amount AS amt, chain AS ch FROM tx
         UNION ALL SELECT lower(to_address), false, amount, chain FROM tx),
st AS (SELECT a, count_if(o) AS n_from, count_if(NOT o) AS n_to,
         sum(CASE WHEN o THEN amt END) AS sum_from, count(CASE WHEN o THEN amt END) AS c_from,
         sum(CASE WHEN NOT o THEN amt END) AS sum_to, count(CASE WHEN NOT o THEN amt END) AS c_to,
         stddev_samp(CASE WHEN o THEN CAST(amt AS DOUBLE) END) AS std_from,
         stddev_samp(CASE WHEN NOT o THEN CAST(amt AS DOUBLE) END) AS std_to,
         count(DISTINCT CASE WHEN o THEN ch END) AS chains_from, count(DISTINCT CASE WHEN NOT o THEN ch END) AS chains_to
       FROM ends GROUP BY a),
pr AS (SELECT address,
         CASE WHEN balance IS NULL THEN NULL ELSE
           (CAST(rank() OVER (ORDER BY balance) - 1 AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY balance) AS DOUBLE) + 1.0) / 2.0)
           / CAST(count(balance) OVER () AS DOUBLE) * 100.0 END AS balance_percentile,
         greatest(coalesce(CAST(epoch_us({C.REF}) - epoch_us(first_seen) AS DOUBLE) / 86400000000.0, 0.0), 0.0) AS holding_period_days,
         greatest(coalesce(CAST(epoch_us({C.REF}) - epoch_us(last_activity) AS DOUBLE) / 86400000000.0, 0.0), 0.0) AS activity_recency_days
       FROM holders),
f0 AS (SELECT pr.*, CAST(coalesce(n_from, 0) + coalesce(n_to, 0) AS BIGINT) AS transaction_count,
         coalesce(CAST(sum_from AS DOUBLE) / CAST(c_from AS DOUBLE), 0.0) AS mf,
         coalesce(CAST(sum_to AS DOUBLE) / CAST(c_to AS DOUBLE), 0.0) AS mt,
         (coalesce(std_from, 0.0) + coalesce(std_to, 0.0)) / 2.0 AS balance_volatility,
         CAST(coalesce(chains_from, 0) > 1 OR coalesce(chains_to, 0) > 1 AS INTEGER) AS cross_chain_flag
       FROM pr LEFT JOIN st ON st.a = lower(pr.address)),
feats AS (SELECT address, transaction_count,
         CASE WHEN mf > 0 AND mt > 0 THEN (mf + mt) / 2.0 ELSE greatest(mf, mt) END AS avg_transaction_size,
         balance_percentile, holding_period_days, activity_recency_days,
         CAST(transaction_count AS DOUBLE) / greatest(holding_period_days, 1.0) AS transaction_frequency,
         balance_volatility, cross_chain_flag FROM f0)""")


def _features(spark, sf):
    """The features of M1, written once like the canonical TX."""
    return TD.written(spark, sf, "features", lambda: FE.holder_features(
        _holders(spark, sf), _tx(spark, sf), TD.REFERENCE_TIME))


@register("holder_features", _FEATS + """
SELECT address, transaction_count, avg_transaction_size, balance_percentile, holding_period_days,
  activity_recency_days, transaction_frequency, round(balance_volatility, 6) AS balance_volatility,
  CAST(cross_chain_flag AS BIGINT) AS cross_chain_flag FROM feats""")
def q_holder_features(spark, sf):
    f = FE.holder_features(_holders(spark, sf), _tx(spark, sf), TD.REFERENCE_TIME)
    return f.withColumn("balance_volatility", F.round("balance_volatility", 6))


@register("balance_percentile", _FEATS + "SELECT address, balance_percentile FROM feats")
def q_balance_percentile(spark, sf):
    h = _holders(spark, sf)
    from tokenflow.operators.rank import average_percentile
    return average_percentile(h.select("address", "balance"), "balance", "balance_percentile").drop("balance")


_LABEL = """CASE WHEN balance_percentile >= 99.0 THEN 'whale'
  WHEN transaction_frequency > 1.0 AND holding_period_days < 7.0 THEN 'trader'
  WHEN transaction_frequency < 0.1 AND holding_period_days > 30.0 THEN 'holder' ELSE 'retail' END"""


@register("label_wallets", _FEATS + f"SELECT address, {_LABEL} AS behavior_class FROM feats")
def q_label_wallets(spark, sf):
    return FE.label_wallets(_features(spark, sf)).select("address", "behavior_class")


@register("class_weights", _FEATS + f""", lab AS (SELECT {_LABEL} AS behavior_class FROM feats),
g AS (SELECT behavior_class, count(*) AS n FROM lab GROUP BY 1)
SELECT behavior_class, CAST(n AS BIGINT) AS count,
  CAST(sum(n) OVER () AS DOUBLE) / CAST(count(*) OVER () * n AS DOUBLE) AS weight FROM g""")
def q_class_weights(spark, sf):
    return FE.class_weights(FE.label_wallets(_features(spark, sf)))


@register("class_breakdown", _FEATS + f""", lab AS (SELECT {_LABEL} AS behavior_class FROM feats),
g AS (SELECT behavior_class, count(*) AS n FROM lab GROUP BY 1),
e AS (SELECT * FROM (VALUES ('trader'), ('holder'), ('whale'), ('retail')) t(behavior_class)),
j AS (SELECT e.behavior_class AS eb, g.n FROM e FULL JOIN g ON g.behavior_class = e.behavior_class),
t AS (SELECT sum(coalesce(n, 0)) AS total FROM j)
SELECT eb AS behavior_class, CAST(coalesce(n, 0) AS BIGINT) AS count,
  CASE WHEN total > 0 THEN CAST(coalesce(n, 0) AS DOUBLE) / CAST(total AS DOUBLE) * 100.0 ELSE 0.0 END AS percentage,
  CAST(total AS BIGINT) AS total FROM j, t WHERE eb IS NOT NULL""")
def q_class_breakdown(spark, sf):
    return A.class_breakdown(FE.label_wallets(_features(spark, sf))).drop("class_rank")


from tokenflow.schemas import FEATURES as _FCOLS  # noqa: E402


@register("feature_stats", _FEATS + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, "
    f"round(min(CAST({c} AS DOUBLE)), 6) AS min, round(max(CAST({c} AS DOUBLE)), 6) AS max FROM feats" for c in _FCOLS) + ")")
def q_feature_stats(spark, sf):
    s = FE.feature_stats(_features(spark, sf))
    return s.select("feature", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


@register("stratified_split", _FEATS + f"""
SELECT address, behavior_class, is_test FROM (
  SELECT address, behavior_class, row_number() OVER (PARTITION BY behavior_class ORDER BY md5(address || '|42'))
      <= round(0.2 * count(*) OVER (PARTITION BY behavior_class)) AS is_test
  FROM (SELECT address, {_LABEL} AS behavior_class FROM feats))""")
def q_stratified_split(spark, sf):
    lab = FE.label_wallets(_features(spark, sf))
    return FE.split(lab, label="behavior_class").select("address", "behavior_class", "is_test")


# --------------------------------------------------------------------- R1 / T2-T4 / E6 / W3 / W4 / S22
import uuid  # noqa: E402

from tokenflow.operators import history as HI  # noqa: E402
from tokenflow.session import CODEC, app_id, scratch_path, tidy_shuffles  # noqa: E402

_RE = """re AS (SELECT 'run-' || CAST(user_id AS VARCHAR) || '-' || strftime(CAST(ts AS TIMESTAMP), '%Y%m%d') AS run_id,
  CAST(user_id AS VARCHAR) AS user_id,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed'
                  WHEN 'error' THEN 'failed' END AS status,
  CASE WHEN event_type = 'view' THEN value END AS progress,
  CASE WHEN event_type = 'error' THEN props END AS error, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq FROM events),
rs AS (SELECT run_id, min(user_id) AS user_id, min(ts) AS created_at,
  arg_max(status, {'t': ts, 's': seq}) FILTER (WHERE status IS NOT NULL) AS status,
  arg_max(progress, {'t': ts, 's': seq}) FILTER (WHERE progress IS NOT NULL) AS progress,
  max(ts) FILTER (WHERE status IN ('completed', 'failed', 'partial')) AS completed_at,
  arg_max(error, {'t': ts, 's': seq}) FILTER (WHERE error IS NOT NULL) AS error_message,
  CAST(count(*) AS BIGINT) AS events FROM re GROUP BY run_id)"""


def _runs(spark, sf):
    return HI.run_state(TD.run_events(spark, sf))


@register("run_state", "WITH " + _RE + f"""
SELECT run_id, user_id, {C.ymdhms('created_at')} AS created_at, status, progress,
  {C.ymdhms('completed_at')} AS completed_at, error_message, events FROM rs""")
def q_run_state(spark, sf):
    return _runs(spark, sf)


@register("user_runs", "WITH " + _RE + f"""
SELECT run_id, user_id, {C.ymdhms('created_at')} AS created_at, status, CAST(row_num AS BIGINT) AS row_num FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, run_id DESC) AS row_num FROM rs)
WHERE row_num > 0 AND row_num <= 20""")
def q_user_runs(spark, sf):
    return HI.user_runs(_runs(spark, sf), limit=20).select("run_id", "user_id", "created_at", "status", "row_num")


_AUD = """aud AS (SELECT event_id AS log_id, CAST(user_id AS VARCHAR) AS user_id, event_type AS action,
  'run' AS resource_type, 'run-' || CAST(user_id AS VARCHAR) || '-' || strftime(CAST(ts AS TIMESTAMP), '%Y%m%d') AS resource_id,
  CAST(ts AS TIMESTAMP) AS "timestamp", props AS details FROM events)"""


@register("user_audit", "WITH " + _AUD + f"""
SELECT log_id, user_id, action, {C.ymdhms('"timestamp"')} AS "timestamp", CAST(row_num AS BIGINT) AS row_num FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, log_id DESC) AS row_num FROM aud)
WHERE row_num > 10 AND row_num <= 60""")
def q_user_audit(spark, sf):
    return HI.user_audit(TD.audit_log(spark, sf), limit=50, offset=10).select(
        "log_id", "user_id", "action", "timestamp", "row_num")


@register("resource_audit", "WITH " + _AUD + f"""
SELECT log_id, resource_type, resource_id, action, CAST(row_num AS BIGINT) AS row_num FROM (
  SELECT *, row_number() OVER (PARTITION BY resource_type, resource_id ORDER BY "timestamp" DESC, log_id DESC) AS row_num FROM aud)
WHERE row_num > 0 AND row_num <= 5""")
def q_resource_audit(spark, sf):
    return HI.resource_audit(TD.audit_log(spark, sf), limit=5).select(
        "log_id", "resource_type", "resource_id", "action", "row_num")


@register("run_with_result", "WITH " + _RE + """,
res AS (SELECT run_id, 'res-' || run_id AS result_id, events AS total_records,
               '/exports/' || run_id || '.json' AS output_file_path FROM rs WHERE status = 'completed')
SELECT rs.run_id, rs.status, res.result_id, res.total_records, res.output_file_path
FROM rs LEFT JOIN res ON res.run_id = rs.run_id""")
def q_run_with_result(spark, sf):
    runs = _runs(spark, sf)
    res = runs.where(F.col("status") == "completed").select(
        "run_id", F.concat(F.lit("res-"), F.col("run_id")).alias("result_id"),
        F.col("events").alias("total_records"),
        F.concat(F.lit("/exports/"), F.col("run_id"), F.lit(".json")).alias("output_file_path"))
    return HI.run_with_result(runs.select("run_id", "status"), res)


@register("latest_run", f"""
SELECT event_type AS pipeline, arg_max(event_id, {{'t': CAST(ts AS TIMESTAMP), 'r': event_id}}) AS latest_run_id,
  {C.ymdhms('max(CAST(ts AS TIMESTAMP))')} AS latest_created_at, CAST(count(*) AS BIGINT) AS run_count
FROM events GROUP BY event_type""")
def q_latest_run(spark, sf):
    return HI.latest_run(TD.pipeline_runs(spark, sf))


@register("latest_artifacts", """
WITH l AS (SELECT event_type AS pipeline, arg_max(event_id, {'t': CAST(ts AS TIMESTAMP), 'r': event_id}) AS run_id
           FROM events WHERE event_type <> 'error' GROUP BY event_type)
SELECT pipeline, run_id, a.artifact, CAST(run_id AS VARCHAR) || '/' || a.artifact AS path FROM l,
  (VALUES """ + ", ".join(f"('{a}')" for a in HI.ARTIFACTS) + """) a(artifact)""")
def q_latest_artifacts(spark, sf):
    return HI.latest_artifacts(TD.pipeline_runs(spark, sf))


@register("request_rate", """
WITH e AS (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, epoch_us(CAST(ts AS TIMESTAMP)) AS us FROM events),
w AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window,
             min(us) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS oldest FROM e)
SELECT event_id, user_id, CAST(in_window AS BIGINT) AS in_window, in_window - 1 < 5 AS allowed,
  CAST(CASE WHEN in_window - 1 < 5 THEN 5 - in_window ELSE 0 END AS BIGINT) AS remaining,
  CAST(CASE WHEN in_window - 1 < 5 THEN 0 ELSE greatest(1, floor((oldest + 86400000000 - us) / 1000000) + 1) END AS BIGINT) AS retry_after
FROM w""")
def q_request_rate(spark, sf):
    ev = TD.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return HI.request_rate(ev, "user_id", "ts", window_seconds=86400, limit=5).select(
        "event_id", "user_id", "in_window", "allowed", "remaining", "retry_after")


# --------------------------------------------------------------------- M7 / M10 / M12 / A20 / A21 / N1-N3 / P17
from tokenflow.operators import ml as ML  # noqa: E402
from tokenflow.operators import monitor as MO  # noqa: E402


def _rule_preds(spark, sf, scorer: str = "percentile"):
    feats = _features(spark, sf)
    lab = _hsov(spark, sf).select("address", F.col("is_store_of_value").cast("int").alias("label"))
    score = (F.col("balance_percentile") / 100.0 if scorer == "percentile"
             else F.least(F.col("holding_period_days") / 60.0, F.lit(1.0)))
    p = feats.join(lab, "address").select("address", "label", score.alias("score"))
    return p.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


def _preds_sql(name: str, scorer: str) -> str:
    score = ("f.balance_percentile / 100.0" if scorer == "percentile"
             else "least(f.holding_period_days / 60.0, 1.0)")
    return f"""{name} AS (SELECT f.address, CAST(h.is_store_of_value AS BIGINT) AS label, {score} AS score,
  CAST({score} >= 0.5 AS INTEGER) AS prediction FROM feats f JOIN holders_typed h ON h.address = f.address)"""


def _eval_sql(p: str, out: str) -> str:
    return f"""{out}_r AS (SELECT *, CAST(rank() OVER (ORDER BY score) - 1 AS DOUBLE) AS below,
                            CAST(count(*) OVER (PARTITION BY score) AS DOUBLE) AS cnt FROM {p}),
{out}_c AS (SELECT CAST(count_if(label = 1 AND prediction = 1) AS DOUBLE) AS tp,
                   CAST(count_if(label = 0 AND prediction = 1) AS DOUBLE) AS fp,
                   CAST(count_if(label = 1 AND prediction = 0) AS DOUBLE) AS fn,
                   CAST(count_if(label = 1) AS DOUBLE) AS p, CAST(count_if(label = 0) AS DOUBLE) AS n,
                   sum(CASE WHEN label = 1 THEN below + (cnt + 1.0) / 2.0 END) AS rs FROM {out}_r),
{out} AS (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
                 CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
                 CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1.0) / 2.0) / (p * n) ELSE 0.5 END AS auc,
                 CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives FROM {out}_c),
{out}_m AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM {out})"""


def _ml_ctes(*extra: str) -> str:
    # features CTEs + typed holders (labels) + the given extra CTEs
    base = C.with_ctes("TX", "HOLDERS", "HOLDERS_TYPED")
    body = _FEATS[len(C.with_ctes("TX", "HOLDERS")):]
    return base.rstrip() + ",\n" + body.strip() + (",\n" + ",\n".join(extra) if extra else "") + "\n"


@register("eval_binary", _ml_ctes(_preds_sql("pr1", "percentile"), _eval_sql("pr1", "ev1")) + """
SELECT precision, recall, f1, auc, positives, negatives FROM ev1_m""")
def q_eval_binary(spark, sf):
    return ML.eval_binary(_rule_preds(spark, sf, "percentile"))


def _metrics_long_sql():
    parts = []
    for ver, ev in (("rule-percentile", "ev1_m"), ("rule-holding", "ev2_m")):
        for m in MO.METRICS:
            parts.append(f"SELECT 'sov_predictor' AS model_name, '{ver}' AS version, '{m}' AS metric, {m} AS value FROM {ev}")
    return "ml AS (" + " UNION ALL ".join(parts) + ")"


@register("metrics_long", _ml_ctes(_preds_sql("pr1", "percentile"), _eval_sql("pr1", "ev1"),
                                   _preds_sql("pr2", "holding"), _eval_sql("pr2", "ev2"), _metrics_long_sql()) + """
SELECT * FROM ml""")
def q_metrics_long(spark, sf):
    return _metrics_long(spark, sf)


def _metrics_long(spark, sf):
    e1 = ML.eval_binary(_rule_preds(spark, sf, "percentile")).select(
        F.lit("sov_predictor").alias("model_name"), F.lit("rule-percentile").alias("version"), *MO.METRICS)
    e2 = ML.eval_binary(_rule_preds(spark, sf, "holding")).select(
        F.lit("sov_predictor").alias("model_name"), F.lit("rule-holding").alias("version"), *MO.METRICS)
    return MO.to_long(e1.unionByName(e2)).checkpoint(eager=True)  # eight rows that the checks read many times


_CHECK_SQL = _ml_ctes(_preds_sql("pr1", "percentile"), _eval_sql("pr1", "ev1"),
                      _preds_sql("pr2", "holding"), _eval_sql("pr2", "ev2"), _metrics_long_sql(), """
thr AS (SELECT * FROM (VALUES ('precision', 0, 0.70), ('recall', 1, 0.65), ('f1', 2, 0.67), ('auc', 3, 0.75)) t(metric, mr, mn)),
abs_v AS (SELECT ml.model_name, ml.version, ml.metric, thr.mr, 0 AS kind,
                 CASE WHEN ml.value < thr.mn * 0.9 THEN 2 ELSE 1 END AS sev
          FROM ml JOIN thr ON thr.metric = ml.metric WHERE ml.value < thr.mn),
prod AS (SELECT metric, value AS pv FROM ml WHERE version = 'rule-holding'),
rel_v AS (SELECT ml.model_name, ml.version, ml.metric, thr.mr, 1 AS kind, 1 AS sev
          FROM ml JOIN prod ON prod.metric = ml.metric JOIN thr ON thr.metric = ml.metric
          WHERE ml.version = 'rule-percentile' AND prod.pv > 0 AND (prod.pv - ml.value) / prod.pv > 0.10),
v AS (SELECT * FROM abs_v UNION ALL SELECT * FROM rel_v),
agg AS (SELECT model_name, version, max(sev) AS r, string_agg(metric, ', ' ORDER BY kind * 10 + mr) AS violated,
               count(*) AS vc FROM v GROUP BY 1, 2),
mv AS (SELECT DISTINCT model_name, version FROM ml WHERE version = 'rule-percentile')""")


@register("model_check", _CHECK_SQL + """
SELECT mv.model_name, mv.version,
  CASE coalesce(agg.r, 0) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'none' END AS severity,
  coalesce(agg.r, 0) > 0 AS is_degraded, CAST(coalesce(agg.vc, 0) AS BIGINT) AS violation_count,
  coalesce(agg.violated, '') AS violated_metrics,
  CASE WHEN coalesce(agg.r, 0) = 0 THEN 'Model meets all performance thresholds. Safe to promote.'
       WHEN agg.r = 2 THEN 'CRITICAL: Model shows significant performance degradation. Do not promote. Review training data and model configuration.'
       ELSE 'WARNING: Model shows degradation in: ' || agg.violated || '. Manual review required before promotion.' END AS recommendation
FROM mv LEFT JOIN agg ON agg.model_name = mv.model_name AND agg.version = mv.version""")
def q_model_check(spark, sf):
    ml = _metrics_long(spark, sf)
    cand = ml.where(F.col("version") == "rule-percentile")
    prod = ml.where(F.col("version") == "rule-holding")
    return MO.check_models(cand, MO.thresholds_frame(spark), prod)


@register("threshold_violations", _CHECK_SQL + """
SELECT abs_v.model_name, abs_v.version, abs_v.metric, CASE abs_v.sev WHEN 2 THEN 'critical' ELSE 'warning' END AS severity
FROM abs_v""")
def q_threshold_violations(spark, sf):
    ml = _metrics_long(spark, sf)
    return MO.threshold_violations(ml, MO.thresholds_frame(spark)).select("model_name", "version", "metric", "severity")


@register("sov_pred_summary", _ml_ctes(_preds_sql("pr1", "percentile")) + """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(score >= 0.5) AS BIGINT) AS likely_sov,
  CASE WHEN count(*) > 0 THEN CAST(count_if(score >= 0.5) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 ELSE 0.0 END AS likely_sov_pct,
  CAST(count_if(score < 0.5) AS BIGINT) AS likely_active,
  CASE WHEN count(*) > 0 THEN CAST(count_if(score < 0.5) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 ELSE 0.0 END AS likely_active_pct,
  round(coalesce(avg(score), 0.0), 9) AS mean_probability FROM pr1""")
def q_sov_pred_summary(spark, sf):
    p = _rule_preds(spark, sf).withColumnRenamed("score", "sov_probability")
    return A.sov_pred_summary(p).withColumn("mean_probability", F.round("mean_probability", 9))


@register("pred_metadata", _ml_ctes(_preds_sql("pr1", "percentile")) + """
SELECT CAST(count(*) AS BIGINT) AS prediction_count, CAST(count_if(prediction = 1) AS BIGINT) AS predicted_sov,
  CASE WHEN count(*) > 0 THEN CAST(count_if(prediction = 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) ELSE 0.0 END AS sov_ratio,
  round(coalesce(avg(score), 0.0), 9) AS mean_probability FROM pr1""")
def q_pred_metadata(spark, sf):
    p = _rule_preds(spark, sf).select("address", F.col("score").alias("sov_probability"),
                                      (F.col("prediction") == 1).alias("predicted_class"))
    return ML.pred_metadata(p).withColumn("mean_probability", F.round("mean_probability", 9))


@register("sov_prob_histogram", _ml_ctes(_preds_sql("pr1", "percentile")) + """
SELECT CASE WHEN score >= 0.5 THEN 'Likely SoV' ELSE 'Likely Active' END AS label,
  CAST(least(floor(score * 20), 19) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS count
FROM pr1 WHERE score IS NOT NULL GROUP BY 1, 2""")
def q_sov_prob_histogram(spark, sf):
    p = _rule_preds(spark, sf).withColumnRenamed("score", "sov_probability")
    return A.sov_prob_histogram(p)


_ALT = """CASE WHEN balance_percentile >= 95.0 THEN 'whale'
  WHEN transaction_frequency > 0.5 AND holding_period_days < 7.0 THEN 'trader'
  WHEN transaction_frequency < 0.1 AND holding_period_days > 30.0 THEN 'holder' ELSE 'retail' END"""


@register("eval_multiclass", _FEATS + f""",
lp AS (SELECT {_LABEL} AS y, {_ALT} AS yhat FROM feats),
cm AS (SELECT y, yhat, count(*) AS n FROM lp GROUP BY 1, 2),
pt AS (SELECT y, sum(n) AS support, sum(CASE WHEN y = yhat THEN n END) AS tp FROM cm GROUP BY y),
pp AS (SELECT yhat AS y, sum(n) AS predicted FROM cm GROUP BY yhat),
pc AS (SELECT coalesce(pt.y, pp.y) AS class, coalesce(pt.tp, 0) AS tp, coalesce(pt.support, 0) AS support,
              coalesce(pp.predicted, 0) AS predicted FROM pt FULL JOIN pp ON pp.y = pt.y),
m AS (SELECT class, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / CAST(predicted AS DOUBLE) ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / CAST(support AS DOUBLE) ELSE 0.0 END AS recall,
             CAST(tp AS BIGINT) AS tp, CAST(support AS BIGINT) AS support FROM pc),
m2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)
SELECT class, precision, recall, tp, support, f1,
  CAST(sum(tp) OVER () AS DOUBLE) / CAST(sum(support) OVER () AS DOUBLE) AS accuracy,
  round(avg(precision) OVER (), 9) AS macro_precision, round(avg(recall) OVER (), 9) AS macro_recall,
  round(avg(f1) OVER (), 9) AS macro_f1 FROM m2""")
def q_eval_multiclass(spark, sf):
    both = FE.label_wallets(_features(spark, sf)).withColumnRenamed("behavior_class", "label")
    both = FE.label_wallets(both, FE.Thresholds(whale_percentile=95.0, trader_frequency=0.5))
    r = ML.eval_multiclass(both.select("label", F.col("behavior_class").alias("prediction")))
    return r.select("class", "precision", "recall", F.col("tp").cast("bigint").alias("tp"),
                    F.col("support").cast("bigint").alias("support"), "f1", "accuracy",
                    *[F.round(c, 9).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1")])


# --------------------------------------------------------------------- G1 / G2 / G3
from tokenflow.operators import report as RP  # noqa: E402

_G_CTES = C.with_ctes("TX", "HOLDERS_TYPED", extra=_per_dim_sql("chain", dims.CHAINS, True)[0].strip()) + f""",
bc AS ({_per_dim_sql("chain", dims.CHAINS, True)[1].strip()}),
actc AS (SELECT count_if(activity_type = 'transaction') AS t, count_if(activity_type = 'store_of_value') AS s FROM tx),
hm AS (SELECT count(*) AS total_holders,
         CASE WHEN count(*) > 0 THEN CAST(count_if(coalesce(is_store_of_value, false)) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 ELSE 0.0 END AS sp
       FROM holders_typed),
cf0 AS (SELECT CAST(count(*) AS BIGINT) AS sample_size,
  CASE WHEN count(*) > 0 THEN CAST({_NN} AS DOUBLE) / CAST(count(*) * {len(_FIELDS)} AS DOUBLE) ELSE 0.0 END AS data_completeness,
  CAST(count(DISTINCT CASE WHEN chain IN ('ethereum', 'bsc', 'polygon') THEN chain END) AS DOUBLE) / 3.0 AS chain_coverage FROM tx),
cf AS (SELECT *, least(CAST(sample_size AS DOUBLE) / 1000.0, 1.0) * 0.6 + (data_completeness * 0.7 + chain_coverage * 0.3) * 0.4 AS score FROM cf0),
lv AS (SELECT *, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM cf),
errs AS (SELECT 'holder ' || address || ' failed: balance' AS error, address AS ord FROM holders_typed WHERE balance < 0)
"""


def _cap_sql(c):
    return f"(upper(substring({c}, 1, 1)) || lower(substring({c}, 2)))"


def _pct1_sql(x):
    return f"(printf('%.1f', ({x}) * 100.0) || '%')"


def _collection_errors(spark, sf):
    """Collection errors of the run: holders that fail the record
    invariants (one message per holder, ordered by address)."""
    from tokenflow.operators import quality as Q
    _, bad, _ = Q.split_valid(Q.holder_invariant_errors(_hsov(spark, sf)))
    return bad.select(F.concat(F.lit("holder "), F.col("address"), F.lit(" failed: "),
                               F.array_join("errors", ",")).alias("error"), F.col("address").alias("ord"))


@register("conclusions", _G_CTES + f"""
SELECT * REPLACE (CAST(finding_rank AS BIGINT) AS finding_rank) FROM (
SELECT 1 AS finding_rank, 'Dominant Usage Pattern' AS finding,
  CASE WHEN CAST(t AS DOUBLE) / (t + s) > CAST(s AS DOUBLE) / (t + s) THEN 'Transaction' ELSE 'Store of Value' END AS value,
  lv.level AS confidence,
  'Based on activity type distribution: ' || CASE WHEN CAST(t AS DOUBLE) / (t + s) > CAST(s AS DOUBLE) / (t + s)
     THEN {_pct1_sql('CAST(t AS DOUBLE) / (t + s)')} || ' transactions vs ' || {_pct1_sql('CAST(s AS DOUBLE) / (t + s)')} || ' store-of-value'
     ELSE {_pct1_sql('CAST(s AS DOUBLE) / (t + s)')} || ' store-of-value vs ' || {_pct1_sql('CAST(t AS DOUBLE) / (t + s)')} || ' transactions' END AS explanation
FROM actc, lv WHERE t + s > 0
UNION ALL
SELECT 2, 'Holder Behavior Pattern', CASE WHEN sp > 100.0 - sp THEN 'Store of Value' ELSE 'Active Transactors' END, lv.level,
  CASE WHEN sp > 100.0 - sp THEN printf('%.1f', sp) || '% holders are store-of-value'
       ELSE printf('%.1f', 100.0 - sp) || '% holders are active transactors' END
FROM hm, lv WHERE total_holders > 0
UNION ALL
SELECT 3, 'Most Active Chain', {_cap_sql('chain')}, lv.level,
  {_cap_sql('chain')} || ' has ' || format('{{:,}}', transaction_count) || ' transactions'
FROM (SELECT * FROM bc ORDER BY transaction_count DESC, CASE chain WHEN 'ethereum' THEN 1 WHEN 'bsc' THEN 2 ELSE 3 END LIMIT 1) x, lv
WHERE transaction_count > 0
UNION ALL
SELECT 4, 'Highest Store-of-Value Ratio', {_cap_sql('chain')}, lv.level,
  {_cap_sql('chain')} || ' has ' || {_pct1_sql('sov_ratio')} || ' store-of-value ratio'
FROM (SELECT * FROM bc WHERE sov_ratio > 0 ORDER BY sov_ratio DESC, CASE chain WHEN 'ethereum' THEN 1 WHEN 'bsc' THEN 2 ELSE 3 END LIMIT 1) y, lv
UNION ALL
SELECT 5, 'Data Quality Warning', CAST(count(*) AS VARCHAR) || ' error(s) detected', 'low',
  'Data collection encountered errors that may affect the accuracy of conclusions. Review the errors list for details.'
FROM errs HAVING count(*) > 0)""")
def q_conclusions(spark, sf):
    tx = _tx(spark, sf)
    h = _hsov(spark, sf, tx)
    return RP.conclusions(A.activity_breakdown(tx), A.holder_metrics(h), A.by_chain(tx, h), A.confidence(tx),
                          _collection_errors(spark, sf)).withColumn("finding_rank", F.col("finding_rank").cast("bigint"))


@register("quality_warnings", _G_CTES + """
SELECT * REPLACE (CAST(warning_rank AS BIGINT) AS warning_rank) FROM (
  SELECT 3 AS warning_rank, 'Low confidence score (' || printf('%.2f', score) || '). Consider collecting more data for reliable conclusions.' AS message FROM lv WHERE level = 'low'
  UNION ALL SELECT 4, 'Data from ' || CAST(3 - CAST(round(chain_coverage * 3) AS INTEGER) AS VARCHAR) || ' chain(s) is missing. Cross-chain analysis may be incomplete.' FROM lv WHERE CAST(round(chain_coverage * 3) AS INTEGER) < 3
  UNION ALL SELECT 5, 'Field completeness is ' || printf('%.1f', data_completeness * 100.0) || '%. Some records have missing required fields.' FROM lv WHERE data_completeness < 0.9
  UNION ALL SELECT 6, 'Small sample size (' || CAST(sample_size AS VARCHAR) || ' transactions). Statistical conclusions may not be representative.' FROM lv WHERE sample_size < 100
  UNION ALL SELECT 0, 'Data collection reported ' || CAST(count(*) AS VARCHAR) || ' error(s). Results may be incomplete.' FROM errs HAVING count(*) > 0
  UNION ALL SELECT 1, 'Collection error: ' || error FROM (SELECT * FROM errs ORDER BY ord LIMIT 3)
  UNION ALL SELECT 2, '... and ' || CAST(count(*) - 3 AS VARCHAR) || ' more error(s)' FROM errs HAVING count(*) > 3)""")
def q_quality_warnings(spark, sf):
    tx = _tx(spark, sf)
    return RP.quality_warnings(A.confidence(tx), _collection_errors(spark, sf)).withColumn(
        "warning_rank", F.col("warning_rank").cast("bigint"))


@register("bundle_findings", C.with_ctes("TX", "HOLDERS_TYPED", extra="""
g AS (SELECT activity_type, count(*) AS n FROM tx GROUP BY 1),
tot AS (SELECT sum(n) AS total FROM g),
e AS (SELECT * FROM (VALUES ('transaction', 0), ('store_of_value', 1), ('other', 2)) t(activity_type, r)),
a AS (SELECT e.activity_type, e.r, CASE WHEN total > 0 THEN CAST(coalesce(n, 0) AS DOUBLE) / CAST(total AS DOUBLE) * 100.0 ELSE 0.0 END AS pct
      FROM e LEFT JOIN g ON g.activity_type = e.activity_type, tot),
d AS (SELECT * FROM a ORDER BY pct DESC, r ASC LIMIT 1),
hm AS (SELECT CASE WHEN count(*) > 0 THEN CAST(count_if(coalesce(is_store_of_value, false)) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 ELSE 0.0 END AS sp FROM holders_typed)""") + """
SELECT 'dominant_activity' AS type, activity_type AS value, pct AS percentage,
  'Primary usage pattern: ' || activity_type || ' (' || printf('%.1f', pct) || '%)' AS description FROM d
UNION ALL SELECT 'sov_ratio', printf('%.1f', sp), sp, 'Store of Value holders: ' || printf('%.1f', sp) || '%' FROM hm""")
def q_bundle_findings(spark, sf):
    tx = _tx(spark, sf)
    return RP.bundle_findings(A.activity_breakdown(tx), A.holder_metrics(_hsov(spark, sf, tx)))


# --------------------------------------------------------------------- S1 / S9 / S11 / S16 / S18 / S17
from tokenflow.plans import steps as SP  # noqa: E402
from tokenflow.sources import export as EX  # noqa: E402
from tokenflow.sources import sample as SM  # noqa: E402


@register("export_roundtrip", C.with_ctes("TX") + f"SELECT {_TX_OUT} FROM tx")
def q_export_roundtrip(spark, sf):
    """S9 write -> S1 read -> S3 typing gives back the canonical TX."""
    tx = _tx(spark, sf)
    out = EX.write_export(spark, scratch_path(spark, f"exports/{uuid.uuid4().hex}"), "run-1", tx,
                          _holders(spark, sf), ["etherscan", "bscscan", "polygonscan"])
    return EX.read_export(spark, out)[0]


@register("export_parts", C.with_ctes("TX", "HOLDERS") + """
SELECT 'holders' AS part, CAST(count(*) AS BIGINT) AS n, CAST(sum(balance) AS DOUBLE) AS v FROM holders
UNION ALL SELECT 'metadata', (SELECT count(*) FROM tx) + (SELECT count(*) FROM holders), 3.0
UNION ALL SELECT 'summary ' || stablecoin, count(*), CAST(sum(amount) AS DOUBLE) FROM tx GROUP BY stablecoin
UNION ALL SELECT 'summary ' || chain, count(*), CAST(sum(amount) AS DOUBLE) FROM tx GROUP BY chain
UNION ALL SELECT 'errors', 2, NULL UNION ALL SELECT 'invalid', 0, NULL""")
def q_export_parts(spark, sf):
    """S9 -> S1 for everything but the transfers: holders, metadata, summary,
    errors, and the section checks of V9 on what was written."""
    out = EX.write_export(spark, scratch_path(spark, f"exports/{uuid.uuid4().hex}"), "run-1", _tx(spark, sf),
                          _holders(spark, sf), ["etherscan", "bscscan", "polygonscan"], errors=["timeout", "no key"])
    _, h, meta, summary, errors = EX.read_export(spark, out)
    n = F.count("*").cast("bigint").alias("n")
    none = F.lit(None).cast("double").alias("v")
    bad = QL.export_summary_errors(summary).unionByName(
        QL.export_metadata_errors(meta).select(F.explode("errors").alias("error")))
    parts = [h.agg(F.lit("holders").alias("part"), n, F.sum("balance").cast("double").alias("v")),
             meta.select(F.lit("metadata").alias("part"), F.col("total_records").cast("bigint").alias("n"),
                         F.size("explorers_queried").cast("double").alias("v")),
             summary.where("kind in ('stablecoin', 'chain') and count > 0").select(
                 F.concat(F.lit("summary "), "key").alias("part"), F.col("count").alias("n"),
                 F.col("volume").cast("double").alias("v")),
             errors.agg(F.lit("errors").alias("part"), n, none), bad.agg(F.lit("invalid").alias("part"), n, none)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("tx_to_json", C.with_ctes("TX") + f"""
SELECT transaction_hash, CAST(CAST(amount AS DECIMAL(38,18)) AS VARCHAR) AS amount, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS "timestamp",
  CAST(CAST(gas_price AS DECIMAL(38,0)) AS VARCHAR) AS gas_price_wei FROM tx""")
def q_tx_to_json(spark, sf):
    j = EX.tx_to_json(_tx(spark, sf))
    return j.select("transaction_hash", "amount",
                    F.regexp_replace("timestamp", r"Z$", "+00:00").alias("timestamp"),
                    F.regexp_replace("gas_price", r"\.0+$", "").alias("gas_price_wei"))


@register("sample_summary", C.with_ctes("TX", extra="""
e AS (SELECT * FROM (VALUES ('stablecoin', 'USDC'), ('stablecoin', 'USDT'), ('activity_type', 'transaction'),
        ('activity_type', 'store_of_value'), ('activity_type', 'other'), ('chain', 'ethereum'), ('chain', 'bsc'),
        ('chain', 'polygon')) t(kind, "key")),
g AS (SELECT 'stablecoin' AS kind, stablecoin AS "key", count(*) AS n, sum(amount) AS v FROM tx GROUP BY 2
      UNION ALL SELECT 'activity_type', activity_type, count(*), sum(amount) FROM tx GROUP BY 2
      UNION ALL SELECT 'chain', chain, count(*), sum(amount) FROM tx GROUP BY 2)""") + """
SELECT coalesce(e.kind, g.kind) AS kind, coalesce(e."key", g."key") AS "key", CAST(coalesce(n, 0) AS BIGINT) AS count,
  CAST(coalesce(v, 0) AS DOUBLE) AS volume FROM e FULL JOIN g ON g.kind = e.kind AND g."key" = e."key\"""")
def q_sample_summary(spark, sf):
    return SM.sample_summary(_tx(spark, sf))


@register("sample_data")
def q_sample_data(spark, sf):
    ids = TD.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    s = SM.sample_transactions(ids, "id")
    return s.groupBy("chain", "activity_type").agg(F.count("*").cast("bigint").alias("n"))


# --------------------------------------------------------------------- E3 / E5
@register("sov_ml_override", _ml_ctes(_preds_sql("pr1", "percentile")) + """
SELECT h.address, coalesce(CAST(p.prediction AS BOOLEAN), h.is_store_of_value) AS is_store_of_value
FROM holders_typed h LEFT JOIN pr1 p ON p.address = h.address""")
def q_sov_ml_override(spark, sf):
    p = _rule_preds(spark, sf).select("address", "prediction")
    return CL.sov_ml_override(_hsov(spark, sf), p).select("address", "is_store_of_value")


@register("label_join", _FEATS.rstrip() + ",\n" + C.SIDES + ",\n" + C.HOLDERS_HP + ",\n" + C.HOLDERS_SOV + """
SELECT f.address, CAST(h.is_store_of_value AS BIGINT) AS label, CAST(f.transaction_count AS BIGINT) AS transaction_count
FROM feats f JOIN (SELECT DISTINCT lower(address) AS a, is_store_of_value FROM holders_sov) h ON h.a = lower(f.address)""")
def q_label_join(spark, sf):
    f = _features(spark, sf)
    return ML.label_join(f, _hsov(spark, sf)).select("address", "label", "transaction_count")


# --------------------------------------------------------------------- M6 / M8 / M11 / M9 / M13-M16 / S20 (rows-only)
_FITTED: dict[tuple, tuple] = {}


def _fitted(spark, sf, name, train):
    """One fit per application and input state: the queries share the model."""
    key = (app_id(spark), sf, name, TD.input_state(spark, sf))
    if key not in _FITTED:
        _FITTED[key] = train()
    return _FITTED[key]


def _trained_sov(spark, sf):
    f = _features(spark, sf)
    return f, _fitted(spark, sf, "sov", lambda: ML.train_sov(
        ML.label_join(f, _hsov(spark, sf), one_row_per_address=True)))


def _trained_wallets(spark, sf):
    f = _features(spark, sf)
    return f, _fitted(spark, sf, "wallets", lambda: ML.train_wallets(FE.label_wallets(f)))


@register("predict_sov")
def q_predict_sov(spark, sf):
    f, (model, _, _) = _trained_sov(spark, sf)
    return ML.predict_sov(f, model)


@register("feature_importance")
def q_feature_importance(spark, sf):
    _, (model, _, _) = _trained_sov(spark, sf)
    return ML.feature_importance(spark, model)


@register("training_metadata")
def q_training_metadata(spark, sf):
    _, (_, _, s) = _trained_sov(spark, sf)
    return ML.training_metadata(s)


@register("classify_wallets")
def q_classify_wallets(spark, sf):
    f, (model, _, _) = _trained_wallets(spark, sf)
    return ML.classify_wallets(f, model)


@register("class_summary")
def q_class_summary(spark, sf):
    f, (model, _, _) = _trained_wallets(spark, sf)
    return ML.class_summary(ML.classify_wallets(f, model))


def _rule_classes(spark, sf):
    """Wallet classes by rule with a confidence: a prediction table that SQL has too."""
    f = FE.label_wallets(_features(spark, sf))
    return f.select("address", "behavior_class", (F.col("balance_percentile") / 100.0).alias("confidence"))


_RULE_CLASSES = _FEATS.rstrip() + f""",
cls AS (SELECT address, {_LABEL} AS behavior_class, balance_percentile / 100.0 AS confidence FROM feats)"""


@register("class_summary_rules", _RULE_CLASSES + """
SELECT behavior_class, CAST(count(*) AS BIGINT) AS count,
  CAST((SELECT count_if(confidence < 0.6) FROM cls) AS BIGINT) AS low_confidence,
  round((SELECT avg(confidence) FROM cls), 9) AS avg_confidence, (SELECT min(confidence) FROM cls) AS min_confidence,
  (SELECT max(confidence) FROM cls) AS max_confidence FROM cls GROUP BY behavior_class""")
def q_class_summary_rules(spark, sf):
    s = ML.class_summary(_rule_classes(spark, sf))
    return s.withColumn("avg_confidence", F.round("avg_confidence", 9))


@register("class_confidence_rules", _RULE_CLASSES + """
SELECT round(avg(confidence), 9) AS mean_confidence, CAST(count_if(confidence < 0.6) AS BIGINT) AS low_confidence_count,
  CAST(count_if(confidence < 0.6) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS low_confidence_pct,
  min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM cls""")
def q_class_confidence_rules(spark, sf):
    c = A.class_confidence(_rule_classes(spark, sf))
    return c.withColumn("mean_confidence", F.round("mean_confidence", 9))


@register("training_metadata_rules", _RULE_CLASSES + """,
lab AS (SELECT address, CASE WHEN behavior_class = 'holder' THEN 1 ELSE 0 END AS label FROM cls),
sp AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5(address || '|42'))
         <= round(0.2 * count(*) OVER (PARTITION BY label)) AS is_test FROM lab)
SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS part, CAST(count(*) AS BIGINT) AS samples,
  avg(CAST(label AS DOUBLE)) AS positive_ratio, '1.0' AS taxonomy_version FROM sp GROUP BY 1""")
def q_training_metadata_rules(spark, sf):
    lab = _rule_classes(spark, sf).select("address", (F.col("behavior_class") == "holder").cast("int").alias("label"))
    return ML.training_metadata(FE.split(lab, label="label"), taxonomy_version=FE.Thresholds().taxonomy_version)


@register("class_confidence")
def q_class_confidence(spark, sf):
    f, (model, _, _) = _trained_wallets(spark, sf)
    return A.class_confidence(ML.classify_wallets(f, model))


@register("predict_sov_bounds", C.with_ctes("HOLDERS") + """
SELECT address, true AS in_bounds, true AS class_follows FROM holders""")
def q_predict_sov_bounds(spark, sf):
    """One row per wallet, a probability in [0, 1] and the class that it stands for."""
    f, (model, _, _) = _trained_sov(spark, sf)
    p = F.col("sov_probability")
    return ML.predict_sov(f, model).select("address", p.between(0, 1).alias("in_bounds"), (F.col("predicted_class") == (p > 0.5)).alias("class_follows"))


@register("model_registry", """
WITH v AS (SELECT event_type AS model_name, CAST(event_id AS VARCHAR) AS version, CAST(ts AS TIMESTAMP) AS t, event_id FROM events),
p AS (SELECT model_name, arg_max(version, {'t': t, 'e': event_id}) AS prod FROM v WHERE event_id % 3 = 0 GROUP BY 1)
SELECT v.model_name, v.version, coalesce(v.version = p.prod, false) AS is_production, coalesce(v.version <> p.prod, true) AS promotable,
  CAST(event_id % 100 AS DOUBLE) / 100 AS auc FROM v LEFT JOIN p ON p.model_name = v.model_name""")
def q_model_registry(spark, sf):
    """A registry of one version per event; every third one was promoted, the latest of them is in production."""
    base = scratch_path(spark, f"registry/{uuid.uuid4().hex}")
    ev = TD.table(spark, sf, "events").select(
        F.col("event_type").alias("model_name"), F.col("event_id").cast("string").alias("version"), "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1).alias("us"))
    ev.select("model_name", "version", F.lit("").alias("path"), F.timestamp_micros("us").alias("created"),
              F.create_map(F.lit("auc"), (F.col("event_id") % 100) / 100.0).alias("metrics"), F.lit(False).alias("is_production")).write.parquet(f"{base}/_versions")
    ev.where("event_id % 3 = 0").select("model_name", "version", F.timestamp_micros("us").alias("promoted"), "event_id").write.parquet(f"{base}/_promotions")
    names = [r[0] for r in ev.select("model_name").distinct().collect()]  # the fixed set of event types
    parts = [ML.model_versions(spark, base, n) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("model_name", "version", "is_production", "promotable", F.element_at("metrics", F.lit("auc")).alias("auc"))


@register("model_store", """
SELECT 'sov_predictor' AS model_name, 'v1' AS version, true AS is_production, false AS promotable, CAST(2 AS BIGINT) AS stages""")
def q_model_store(spark, sf):
    _, (model, preds, _) = _trained_sov(spark, sf)
    base = scratch_path(spark, f"models/{uuid.uuid4().hex}")
    m = ML.eval_binary(preds.withColumn("score", vector_to_array_1("probability")))
    row = m.first()
    v = ML.save_model(spark, model, base, "sov_predictor", {k: float(row[k]) for k in MO.METRICS}, "v1")
    ML.promote_model(spark, base, "sov_predictor", v)
    loaded = ML.load_model(spark, base, "sov_predictor")
    out = ML.model_versions(spark, base, "sov_predictor").select("model_name", "version", "is_production", "promotable")
    return out.withColumn("stages", F.lit(len(loaded.stages)).cast("bigint"))


def vector_to_array_1(c):
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(c)[1]


def _landed_documents(spark, sf) -> str:
    """One export document per explorer and year, records in order of their hash. A document is written line by
    line by the task that owns its file, so no document is ever a row."""
    tx = _tx(spark, sf)
    doc = F.concat_ws("-", "source_explorer", F.year("timestamp").cast("string"))
    tx = tx.withColumn("doc", doc)
    # one row per document, of which an explorer has one a year: few
    first = tx.groupBy("doc").agg(F.min(F.struct("transaction_hash", "chain")).alias("first"))
    names = [c for c in tx.columns if c != "doc"]
    lines = tx.join(F.broadcast(first), "doc").select("doc", F.lit(1).alias("part"), *names, "first")
    ends = first.select("doc", F.explode(F.array(F.lit(0), F.lit(2))).alias("part"))
    rows = EX.tx_to_json(tx).schema.names
    head = F.concat(F.lit('{"metadata": {"run_id": "'), "doc", F.lit('"}, "transactions": ['))
    comma = F.when(F.struct("transaction_hash", "chain") == F.col("first"), F.lit("")).otherwise(F.lit(","))
    path = scratch_path(spark, f"documents/{uuid.uuid4().hex}")
    # dealt by a hash of the name: a union of parts that are dealt by the name passes for dealt already, and is
    # not once their partitions have been merged. The text is built behind the exchange
    dealt = (lines.unionByName(ends, allowMissingColumns=True).repartition(F.xxhash64("doc"))
             .sortWithinPartitions("doc", "part", "transaction_hash", "chain"))
    record = EX.tx_to_json(dealt, "doc", "part", "first")
    text = (F.when(F.col("part") == 0, head).when(F.col("part") == 1, F.concat(comma, F.to_json(F.struct(*rows))))
            .otherwise(F.lit('], "holders": [], "errors": ["none } of \\"many\\""]}')))
    with tidy_shuffles(spark):
        # bzip2: the compression that byte ranges can be read from
        record.select("doc", text.alias("value")).write.option("compression", "bzip2").partitionBy("doc").text(path)
    return path


@register("classify_wallets_boosted", C.with_ctes("HOLDERS") + """
SELECT address, true AS in_bounds, true AS sums_to_one, true AS class_is_likeliest FROM holders""")
def q_classify_wallets_boosted(spark, sf):
    """One multinomial boosted model; one row per wallet whose probabilities are a distribution."""
    f = _features(spark, sf)
    model, _, _ = _fitted(spark, sf, "boosted", lambda: ML.train_wallets(FE.label_wallets(f), trees=4, depth=3, model="boosted"))
    out = ML.classify_wallets(f, model)
    probs = [F.col(f"prob_{c}") for c in dims.BEHAVIOR_CLASSES]
    own = F.coalesce(*[F.when(F.col("behavior_class") == c, p) for c, p in zip(dims.BEHAVIOR_CLASSES, probs)])
    return out.select("address", (F.least(*probs) >= 0) & (F.greatest(*probs) <= 1) & (F.col("confidence") == F.greatest(*probs)),
                      F.abs(sum(probs[1:], probs[0]) - 1) < 1e-9, own == F.greatest(*probs)).toDF(
        "address", "in_bounds", "sums_to_one", "class_is_likeliest")


@register("export_documents", C.with_ctes("TX") + """
SELECT doc, transaction_hash, chain, block_number, CAST(row_number() OVER (PARTITION BY doc ORDER BY transaction_hash, chain) - 1 AS BIGINT) AS pos,
  'none } of "many"' AS error
FROM (SELECT *, source_explorer || '-' || CAST(year("timestamp") AS VARCHAR) AS doc FROM tx)""")
def q_export_documents(spark, sf):
    """Documents written from all transfers, each read back by byte ranges with the positions of its records."""
    tx, _, meta, errors = EX.read_large_documents(spark, _landed_documents(spark, sf))
    files = meta.select("file", F.col("run_id").alias("doc")).join(errors.select("file", "error"), "file")
    return tx.join(F.broadcast(files), "file").select("doc", "transaction_hash", "chain", F.col("block_number").cast("bigint").alias("block_number"),
                                         F.col("pos").cast("bigint").alias("pos"), "error")


# --------------------------------------------------------------------- X1 / X2 (rows-only; batch-equality tested)
from tokenflow.streaming import ingest as ST  # noqa: E402

#: backfill over years of history: wider than the data's time span
BACKFILL_WATERMARK = "36500 days"


def _landed_raw(spark, sf, times: int = 1) -> str:
    """Raw transfers landed in arrival order, in so many deliveries."""
    land = scratch_path(spark, f"landing/{uuid.uuid4().hex}")
    raw = TD.raw_transfers(spark, sf)
    day = F.datediff(F.to_date("ingest_key.k1"), F.lit("1992-01-01").cast("date"))
    cuts = raw.select(F.percentile_approx(day, [k / times for k in range(1, times)]).alias("c")).first()[0] \
        if times > 1 else []
    part = F.lit(0)
    for c in cuts:
        part = part + (day > c).cast("int")
    with tidy_shuffles(spark):
        for k in range(times):
            raw.where(part == k).write.mode("append").option("compression", CODEC).parquet(land)
    return land


@register("incremental_ingest", C.with_ctes("TX") + f"SELECT {_TX_OUT} FROM tx")
def q_incremental_ingest(spark, sf):
    """Four deliveries in arrival order, at least four triggers: the result is
    the batch answer of D2 on all columns."""
    land = _landed_raw(spark, sf, times=4)
    base = scratch_path(spark, f"stream/{uuid.uuid4().hex}")
    schema = spark.read.parquet(land).schema
    files = len(spark.read.parquet(land).inputFiles())
    ST.incremental_ingest(spark, land, f"{base}/out", f"{base}/ckpt", f"{base}/rejected", schema=schema,
                          max_files=max(1, files // 4))
    return ST.ingested(spark, f"{base}/out").drop("ingest_key")


@register("streaming_time_series", C.with_ctes("TX_CLS") + f"""
SELECT {C.ymd('CAST("timestamp" AS DATE)')} AS period, activity_type, CAST(count("timestamp") AS BIGINT) AS transaction_count,
  CAST(coalesce(sum(amount), 0) AS DOUBLE) AS volume
FROM tx_cls WHERE "timestamp" IS NOT NULL AND activity_type IS NOT NULL GROUP BY 1, 2""")
def q_streaming_time_series(spark, sf):
    land = _landed_raw(spark, sf)
    base = scratch_path(spark, f"stream/{uuid.uuid4().hex}")
    ST.streaming_time_series(spark, land, f"{base}/out", f"{base}/ckpt", watermark=BACKFILL_WATERMARK)
    return ST.latest_windows(spark, f"{base}/out")


# --------------------------------------------------------------------- S12 / S13 / S14 / S15 / V9 / V10
from pyspark.sql import Window  # noqa: E402

from tokenflow.sources import typed as TY  # noqa: E402


@register("frame_roundtrip", C.with_ctes("TX") + f"SELECT {_TX_OUT} FROM tx")
def q_frame_roundtrip(spark, sf):
    """TX -> all-string records -> typed TX (schema conformance keeps
    every required column, typed NULL where the input lacks one)."""
    strings = EX.tx_to_json(_tx(spark, sf))
    return TY.tx_frame(TY.typed_tx(strings))


@register("validate_export", C.with_ctes("HOLDERS", extra="""
h AS (SELECT row_number() OVER (ORDER BY address || '|' || coin || '|' || chain) - 1 AS pos, * FROM (
        SELECT address, balance, stablecoin AS coin, chain, first_seen FROM holders
        UNION ALL SELECT address, balance, CASE stablecoin WHEN 'USDC' THEN 'USDT' ELSE 'USDC' END, chain, first_seen FROM holders))""") + """
SELECT 'holders[' || CAST(pos AS VARCHAR) || '].balance: invalid' AS error FROM h WHERE balance < 0
UNION ALL SELECT 'holders[' || CAST(pos AS VARCHAR) || '].' || f || ': invalid' FROM h, (VALUES ('first_seen'), ('last_activity')) t(f)
  WHERE first_seen IS NULL""")
def q_validate_export(spark, sf):
    """V9 record rules over the export form of the holders (array index =
    position in address order, as in a written document)."""
    h = _holders(spark, sf)
    other = F.when(F.col("stablecoin") == "USDC", "USDT").otherwise("USDC")
    h = EX.holder_to_json(h.unionByName(h.withColumn("stablecoin", other)))  # every address with two coins
    from tokenflow.operators import quality as Q
    # a written document has one array; its index is the order of the unique key
    # (address, coin, chain), taken from the range-partitioned rank
    from tokenflow.operators.rank import value_ranks
    h = h.withColumn("_k", F.concat_ws("|", "address", "stablecoin", "chain"))
    r = value_ranks(h, "_k").select(F.col("_k").alias("_a"), F.col("_below").alias("pos"))
    pos = h.join(r, h["_k"] == r["_a"]).drop("_a", "_k")
    e = Q.export_holder_errors(pos)
    return e.select(F.explode("errors").alias("error"))


@register("save_run_result", C.with_ctes("TX", "HOLDERS") + """
SELECT 'res-run-1' AS result_id, 'run-1' AS run_id,
  CAST((SELECT count(*) FROM tx) + (SELECT count(*) FROM holders) AS BIGINT) AS total_records""")
def q_save_run_result(spark, sf):
    """S13 + V10: validate before write, write the run export, append the
    RUN_RESULTS row, read the table back."""
    from tokenflow.operators import quality as Q
    tx = Q.assert_writable(_tx(spark, sf), ["transaction_hash", "chain", "timestamp"])
    base = scratch_path(spark, f"runs/{uuid.uuid4().hex}")
    out = EX.write_export(spark, f"{base}/exports", "run-1", tx, _holders(spark, sf),
                          ["etherscan", "bscscan", "polygonscan"])
    total = spark.read.json(f"{out}/metadata").first()["total_records"]
    EX.save_run_result(spark, f"{base}/run_results", "run-1", total, ["etherscan", "bscscan", "polygonscan"],
                       out, "{}")
    return spark.read.parquet(f"{base}/run_results").select("result_id", "run_id", "total_records")


@register("web_bundle")
def q_web_bundle(spark, sf):
    """S14 + S15: five analyses + both prediction sets as wrapped JSON files,
    then the manifest (path, type, size, sha256)."""
    tx = _tx(spark, sf)
    h = _hsov(spark, sf, tx)
    base = scratch_path(spark, f"bundle/{uuid.uuid4().hex}")
    analyses = {"activity_breakdown": A.activity_breakdown(tx), "holder_metrics": A.holder_metrics(h),
                "chain_metrics": A.by_chain(tx, h), "stablecoin_metrics": A.by_stablecoin(tx, h),
                "time_series": TS.ts_by_activity(tx, "monthly")}
    preds = _rule_preds(spark, sf).select("address", F.col("score").alias("sov_probability"))
    wallets = FE.label_wallets(_features(spark, sf)).select("address", "behavior_class")
    EX.web_bundle(spark, base, analyses, "run-1", "2001-10-01T00:00:00+00:00",
                  {"sov_predictions": (preds, "sov_predictor", "rule-percentile"),
                   "wallet_classifications": (wallets, "wallet_classifier", "taxonomy-1.0")})
    return EX.export_manifest(spark, base)


# --------------------------------------------------------------------- V13 / V14 / V20
@register("nesting_depth", """
SELECT event_id, CAST(list_max([
  (length(left(b, i)) - length(regexp_replace(left(b, i), '[\\[{]', '', 'g')))
  - (length(left(b, i)) - length(regexp_replace(left(b, i), '[\\]}]', '', 'g')))
  for i in range(1, length(b) + 1)]) AS BIGINT) AS depth
FROM (SELECT event_id, regexp_replace(regexp_replace(props, '"(\\\\.|[^"\\\\])*"', '""', 'g'),
                                      '\\[\\s*\\]|\\{\\s*\\}', '0', 'g') AS b FROM events)""")
def q_nesting_depth(spark, sf):
    ev = TD.table(spark, sf, "events").select("event_id", "props")
    return ev.select("event_id", PG.nesting_depth("props").cast("bigint").alias("depth"))


@register("missing_schema_policy", C.with_ctes("TX", "HOLDERS", "SUPP_HOLDERS") + """
SELECT source_explorer, endpoint, source_explorer <> 'secondary' AS schema_available,
  source_explorer <> 'secondary' AS accepted, CAST(count(*) AS BIGINT) AS records FROM (
  SELECT source_explorer, 'tokentx' AS endpoint FROM tx
  UNION ALL SELECT source_explorer, 'tokenholderlist' FROM holders WHERE balance >= 0
  UNION ALL SELECT source_explorer, 'tokenholderlist' FROM supp_holders WHERE balance >= 0) GROUP BY 1, 2""")
def q_missing_schema_policy(spark, sf):
    """V14 fail-closed over transfer pages, holder pages and the pages of a
    source without a schema (the secondary holder listing)."""
    tx = _tx(spark, sf)
    tp = PG.landed_transfer_pages(tx).withColumn("endpoint", F.lit("tokentx"))
    hold = _holders(spark, sf).unionByName(TD.supplier_holders(spark, sf))
    hp = PG.landed_holder_pages(hold).withColumn("endpoint", F.lit("tokenholderlist"))
    pages = tp.unionByName(hp)
    known = spark.createDataFrame([(e, ep) for e in ("etherscan", "bscscan", "polygonscan")
                                   for ep in ("tokentx", "tokenholderlist")], "source_explorer string, endpoint string")
    r = PG.missing_schema_policy(pages, known, "fail-closed")
    valid = r.select("source_explorer", "endpoint", "schema_available", "accepted", "result", "stablecoin", "chain", "page")
    parsed = valid.where(F.col("endpoint") == "tokentx").select(
        "source_explorer", "endpoint", "schema_available", "accepted",
        F.size(F.from_json("result", "array<struct<hash:string>>")).alias("n"))
    hparsed = (valid.where(F.col("endpoint") == "tokenholderlist")
               .select("source_explorer", "endpoint", "schema_available", "accepted",
                       F.from_json("result", PG.T.ArrayType(PG.RAW_HOLDER)).alias("a"))
               .select("source_explorer", "endpoint", "schema_available", "accepted",
                       F.size(F.filter("a", lambda x: ~x["TokenHolderQuantity"].startswith("-"))).alias("n")))
    return parsed.unionByName(hparsed).groupBy("source_explorer", "endpoint", "schema_available", "accepted").agg(
        F.sum("n").cast("bigint").alias("records"))


@register("class_filter", _FEATS + f"""
SELECT address, behavior_class FROM (SELECT address, {_LABEL} AS behavior_class FROM feats)
WHERE behavior_class IN ('whale', 'holder')""")
def q_class_filter(spark, sf):
    from tokenflow.operators import quality as Q
    return Q.class_filter(FE.label_wallets(_features(spark, sf)), ["whale", "holder"]).select("address", "behavior_class")


# --------------------------------------------------------------------- N4 / N5
_CHECK_OUT = """
co AS (SELECT mv.model_name, mv.version,
  CASE coalesce(agg.r, 0) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'none' END AS severity,
  coalesce(agg.r, 0) > 0 AS is_degraded, CAST(coalesce(agg.vc, 0) AS BIGINT) AS violation_count,
  coalesce(agg.violated, '') AS violated_metrics
FROM mv LEFT JOIN agg ON agg.model_name = mv.model_name AND agg.version = mv.version)"""


@register("monitor_audit", _CHECK_SQL.rstrip() + ",\n" + _CHECK_OUT + """
SELECT 'model_check' AS action, model_name, version, violation_count, violated_metrics, severity FROM co""")
def q_monitor_audit(spark, sf):
    return MO.monitor_audit(q_model_check(spark, sf))


@register("promotion_policy", _CHECK_SQL.rstrip() + ",\n" + _CHECK_OUT + """
SELECT model_name, version, severity, NOT is_degraded AND
  coalesce((SELECT value FROM ml WHERE version = 'rule-holding' AND metric = 'f1'), 0.0)
    < coalesce((SELECT value FROM ml WHERE version = 'rule-percentile' AND metric = 'f1'), 0.0) AS promotable
FROM co""")
def q_promotion_policy(spark, sf):
    ml = _metrics_long(spark, sf)
    cand = ml.where(F.col("version") == "rule-percentile")
    prod = ml.where(F.col("version") == "rule-holding")
    res = MO.check_models(cand, MO.thresholds_frame(spark), prod)
    return MO.promotion_policy(res, cand, prod, require_improvement=True).select(
        "model_name", "version", "severity", "promotable")


# --------------------------------------------------------------------- G7 / G6 / X3
@register("step_outputs", C.with_ctes("TX", "HOLDERS_TYPED", extra=_per_dim_sql("chain", dims.CHAINS, True)[0].strip())
          + """, bc AS (""" + _per_dim_sql("chain", dims.CHAINS, True)[1].strip() + """)
SELECT bc.chain, CAST(CAST(coalesce(v.vol, 0) AS DECIMAL(38,18)) AS VARCHAR) AS total_volume_text,
  CASE WHEN isnan(avg_gas_cost) OR isinf(avg_gas_cost) THEN NULL ELSE avg_gas_cost END AS avg_gas_cost
FROM bc LEFT JOIN (SELECT chain, sum(amount) AS vol FROM tx GROUP BY chain) v ON v.chain = bc.chain""")
def q_step_outputs(spark, sf):
    """The JSON-safe form of a step result (decimals as text, NaN/Inf
    as NULL)."""
    tx = _tx(spark, sf)
    safe = EX.json_safe(A.by_chain(tx, _hsov(spark, sf, tx)))
    return safe.select("chain", F.col("total_volume").alias("total_volume_text"), "avg_gas_cost")


_c, _s = _per_dim_sql("stablecoin", dims.STABLECOINS, False)
_c2, _s2 = _per_dim_sql("chain", dims.CHAINS, True)
_BY_BOTH = C.with_ctes("TX", "HOLDERS_TYPED", extra=_c.strip().replace("g AS", "cg AS").replace("hs AS", "chs AS").replace("e AS", "ce AS")
                       + ",\n" + _c2.strip()) + ", bc AS (" + _s.strip().replace("g.", "cg.").replace("hs.", "chs.").replace(
    "FROM e LEFT JOIN g ON", "FROM ce e LEFT JOIN cg ON").replace("LEFT JOIN hs ON", "LEFT JOIN chs ON") + "), bh AS (" + _s2.strip() + ")"


@register("chart_frames", _BY_BOTH + """
SELECT 'coin_activity' AS chart, stablecoin AS key, activity_type AS series, percentage AS value FROM (
  UNPIVOT (SELECT stablecoin, pct_transaction AS "transaction", pct_store_of_value AS store_of_value, pct_other AS other FROM bc)
  ON "transaction", store_of_value, other INTO NAME activity_type VALUE percentage)
UNION ALL SELECT 'chain', chain, 'total_volume', total_volume FROM bh
UNION ALL SELECT 'chain', chain, 'avg_transaction_size', avg_transaction_size FROM bh
UNION ALL SELECT 'chain', chain, 'sov_ratio', sov_ratio FROM bh
UNION ALL SELECT 'gas', chain, 'avg_gas_cost', avg_gas_cost FROM bh WHERE avg_gas_cost IS NOT NULL
UNION ALL SELECT 'gas', chain, 'excluded_count', excluded_gas_count FROM bh WHERE avg_gas_cost IS NOT NULL
UNION ALL SELECT 'holders', 'Store of Value', 'count', count_if(coalesce(is_store_of_value, false)) FROM holders_typed
UNION ALL SELECT 'holders', 'Active Transactor', 'count', count_if(NOT coalesce(is_store_of_value, false)) FROM holders_typed""")
def q_chart_frames(spark, sf):
    """All chart frames in one long form."""
    f = A.chart_frames(_tx(spark, sf), _hsov(spark, sf))
    d = lambda c: F.col(c).cast("double").alias("value")
    gas = f["gas"]
    parts = [f["coin_activity"].select(F.lit("coin_activity").alias("chart"), F.col("stablecoin").alias("key"), F.col("activity_type").alias("series"), d("percentage")),
             f["chain"].select(F.lit("chain"), "chain", "metric", d("value")),
             *[gas.select(F.lit("gas"), "chain", F.lit(c), d(c)) for c in ("avg_gas_cost", "excluded_count")],
             f["holders"].select(F.lit("holders"), "status", F.lit("count"), d("count"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@register("step_wrappers", C.with_ctes("TX", "HOLDERS_TYPED", extra="""
by_act AS (SELECT a.activity_type, count(tx.chain) AS n, coalesce(sum(amount), 0) AS vol
        FROM (VALUES ('transaction'), ('store_of_value'), ('other')) a(activity_type) LEFT JOIN tx ON tx.activity_type = a.activity_type GROUP BY 1),
top AS (SELECT balance, row_number() OVER (ORDER BY coalesce(balance, 0) DESC, address, stablecoin, chain) AS r, address FROM holders_typed),
ts AS (SELECT count(*) AS n FROM tx WHERE "timestamp" IS NOT NULL AND activity_type IS NOT NULL AND stablecoin IS NOT NULL
       GROUP BY CAST("timestamp" AS DATE), activity_type, stablecoin)""") + """
SELECT 'activity' AS step, 'counts.' || activity_type AS key, CAST(n AS VARCHAR) AS value FROM by_act
UNION ALL SELECT 'activity', 'volumes.' || activity_type, CAST(CAST(vol AS DECIMAL(38,18)) AS VARCHAR) FROM by_act
UNION ALL SELECT 'holder', 'total_holders', CAST(count(*) AS VARCHAR) FROM holders_typed
UNION ALL SELECT 'holder', 'sov_count', CAST(count_if(coalesce(is_store_of_value, false)) AS VARCHAR) FROM holders_typed
UNION ALL SELECT 'holder', 'top.' || CAST(r - 1 AS VARCHAR), address || ' ' || CAST(CAST(balance AS DECIMAL(38,18)) AS VARCHAR) FROM top WHERE r <= 10
UNION ALL SELECT 'time_series', 'rows', CAST(count(*) AS VARCHAR) FROM ts
UNION ALL SELECT 'time_series', 'transactions', CAST(sum(n) AS VARCHAR) FROM ts
UNION ALL SELECT 'chain', CAST(c.i AS VARCHAR) || '.' || c.chain, CAST((SELECT count(*) FROM tx WHERE tx.chain = c.chain) AS VARCHAR)
  FROM (VALUES (0, 'ethereum'), (1, 'bsc'), (2, 'polygon')) c(i, chain)""")
def q_step_wrappers(spark, sf):
    """The JSON texts of all four steps, read back with their types."""
    tx, h = _tx(spark, sf), _hsov(spark, sf)
    counts = "counts map<string,long>, volumes map<string,string>"
    act = SP.activity_step(tx).select(F.from_json("output", counts).alias("o"))
    out = act.select(F.lit("activity").alias("step"), F.explode(F.map_concat(
        F.transform_keys("o.counts", lambda k, v: F.concat(F.lit("counts."), k)).cast("map<string,string>"),
        F.transform_keys("o.volumes", lambda k, v: F.concat(F.lit("volumes."), k)))).alias("key", "value"))
    ho = SP.holder_step(h).select(F.from_json(
        "output", "total_holders long, sov_count long, top_holders array<struct<address:string,balance:string>>").alias("o"))
    out = out.union(ho.select(F.lit("holder"), F.explode(F.create_map(
        F.lit("total_holders"), F.col("o.total_holders").cast("string"), F.lit("sov_count"), F.col("o.sov_count").cast("string")))))
    out = out.union(ho.select(F.posexplode("o.top_holders").alias("i", "t")).select(
        F.lit("holder"), F.concat(F.lit("top."), F.col("i").cast("string")), F.concat_ws(" ", "t.address", "t.balance")))
    ts = SP.time_series_step(tx).agg(F.count("*").alias("n"), F.sum(F.get_json_object("output", "$.transaction_count").cast("long")).alias("t"))
    out = out.union(ts.select(F.lit("time_series"), F.explode(F.create_map(
        F.lit("rows"), F.col("n").cast("string"), F.lit("transactions"), F.col("t").cast("string")))))
    ch = SP.chain_step(tx, h).select(F.posexplode(F.from_json(
        F.get_json_object("output", "$.chain_metrics"), "array<struct<chain:string,transaction_count:long>>")).alias("i", "m"))
    return out.union(ch.select(F.lit("chain"), F.concat_ws(".", F.col("i").cast("string"), "m.chain"), F.col("m.transaction_count").cast("string")))


@register("missing_required", C.with_ctes("TX", "HOLDERS") + """
SELECT 'transactions' AS section, f AS field, CAST(CASE f WHEN 'timestamp' THEN (SELECT count(*) FROM tx WHERE block_number % 17 = 0)
  WHEN 'amount' THEN (SELECT count(*) FROM tx WHERE block_number % 5 = 0) WHEN 'source_explorer' THEN (SELECT count(*) FROM tx) ELSE 0 END AS BIGINT) AS missing
FROM (VALUES ('transaction_hash'), ('block_number'), ('timestamp'), ('from_address'), ('to_address'), ('amount'), ('stablecoin'), ('chain'),
  ('activity_type'), ('source_explorer')) t(f)
UNION ALL SELECT 'holders', f, CAST(CASE f WHEN 'first_seen' THEN (SELECT count(*) - count(first_seen) FROM holders)
  WHEN 'last_activity' THEN (SELECT count(*) - count(last_activity) FROM holders) ELSE 0 END AS BIGINT)
FROM (VALUES ('address'), ('balance'), ('stablecoin'), ('chain'), ('first_seen'), ('last_activity'), ('is_store_of_value'), ('source_explorer')) t(f)""")
def q_missing_required(spark, sf):
    """Required fields that are null or absent, per section, of records blanked by key."""
    b = F.col("block_number")
    tx = _tx(spark, sf).withColumns({"timestamp": F.when(b % 17 != 0, F.col("timestamp")), "amount": F.when(b % 5 != 0, F.col("amount"))}).drop("source_explorer")
    parts = [QL.missing_required(df, QL.SECTIONS[s]).select(F.lit(s).alias("section"), "field", "missing")
             for s, df in (("transactions", tx), ("holders", _holders(spark, sf)))]
    return parts[0].unionByName(parts[1])


@register("loaded_artifacts", C.with_ctes("TX", "HOLDERS") + """
SELECT 'run-2' AS run_id, * FROM (
  SELECT 'activity_breakdown' AS artifact, CAST(3 AS BIGINT) AS rows, CAST((SELECT count(*) FROM tx WHERE activity_type IN ('transaction', 'store_of_value', 'other')) AS BIGINT) AS figure
  UNION ALL SELECT 'holder_metrics', 1, CAST((SELECT count(*) FROM holders) AS BIGINT)
  UNION ALL SELECT 'time_series', CAST(count(*) AS BIGINT), CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM tx
    WHERE "timestamp" IS NOT NULL AND activity_type IS NOT NULL AND stablecoin IS NOT NULL GROUP BY CAST("timestamp" AS DATE), activity_type, stablecoin)
  UNION ALL SELECT 'chain_metrics', 3, CAST((SELECT count(*) FROM tx) AS BIGINT)
  UNION ALL SELECT 'sov_predictions', CAST((SELECT count(*) FROM holders) AS BIGINT), CAST((SELECT count(*) FROM holders) AS BIGINT)
  UNION ALL SELECT 'wallet_classifications', CAST((SELECT count(*) FROM holders) AS BIGINT), CAST((SELECT count(*) FROM holders) AS BIGINT))""")
def q_loaded_artifacts(spark, sf):
    """Two completed runs and a newer failed one; the six artifacts of the newest completed run are loaded and summed up."""
    from tokenflow.plans import artifacts as AR
    from tokenflow.plans.pipeline import analysis_pipeline
    outs = analysis_pipeline(spark, _tx(spark, sf), _holders(spark, sf), TD.REFERENCE_TIME)
    preds = _rule_preds(spark, sf).select("address", F.col("score").alias("sov_probability"), (F.col("prediction") == 1).alias("predicted_class"))
    frames = {k: outs[k] for k in ("activity_breakdown", "holder_metrics", "time_series", "chain_metrics")} | {
        "sov_predictions": preds, "wallet_classifications": outs["wallet_labels"]}
    base = scratch_path(spark, f"artifacts/{uuid.uuid4().hex}")
    AR.write_artifacts(spark, base, "run-1", {"holder_metrics": frames["holder_metrics"]})
    AR.write_artifacts(spark, base, "run-2", frames)
    runs = spark.createDataFrame([("master", "run-1", "completed", 1), ("master", "run-2", "completed", 2), ("master", "run-3", "failed", 3),
                                  ("other", "run-4", "completed", 4)], "pipeline string, run_id string, status string, created_at int")
    got = AR.load_latest_artifacts(spark, runs, base, "master")
    if got.problems:
        raise ValueError(f"artifacts not loaded: {got.problems}")
    figure = {"activity_breakdown": F.sum("tx_count"), "holder_metrics": F.sum("total_holders"), "time_series": F.sum("transaction_count"),
              "chain_metrics": F.sum("transaction_count"), "sov_predictions": F.count("predicted_class"), "wallet_classifications": F.count("behavior_class")}
    parts = [df.agg(F.count("*").alias("rows"), figure[n].cast("bigint").alias("figure")).select(
        F.lit(got.run_id).alias("run_id"), F.lit(n).alias("artifact"), "rows", "figure") for n, df in got.frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("pipeline_output", C.with_ctes("TX", "HOLDERS") + """
SELECT * FROM (VALUES ('activity_breakdown', CAST(3 AS BIGINT)), ('holder_metrics', 1), ('chain_metrics', 3)) t(output, rows)
UNION ALL SELECT 'top_holders', CAST(least(count(*), 10) AS BIGINT) FROM holders
UNION ALL SELECT 'features', CAST(count(*) AS BIGINT) FROM holders
UNION ALL SELECT 'wallet_labels', CAST(count(*) AS BIGINT) FROM holders
UNION ALL SELECT 'time_series', CAST(count(*) AS BIGINT) FROM (
  SELECT DISTINCT CAST("timestamp" AS DATE), activity_type, stablecoin FROM tx
  WHERE "timestamp" IS NOT NULL AND activity_type IS NOT NULL AND stablecoin IS NOT NULL)""")
def q_pipeline_output(spark, sf):
    """One run of the analysis pipeline written partitioned by run_id;
    returns (output, rows) of what was written."""
    from tokenflow.plans.pipeline import analysis_pipeline, write_outputs
    outs = analysis_pipeline(spark, _tx(spark, sf), _holders(spark, sf), TD.REFERENCE_TIME)
    base = scratch_path(spark, f"pipeline/{uuid.uuid4().hex}")
    return write_outputs(spark, outs, base, "run-1")


@register("streaming_request_rate", """
WITH e AS (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS us FROM events),
w AS (SELECT user_id, (us // 10000000) * 10000000 - k * 10000000 AS s FROM e, range(0, 6) r(k))
SELECT user_id, strftime(make_timestamp(s), '%Y-%m-%d %H:%M:%S.%f') AS window_start,
  strftime(make_timestamp(s + 60000000), '%Y-%m-%d %H:%M:%S.%f') AS window_end, CAST(count(*) AS BIGINT) AS requests
FROM w GROUP BY user_id, s""")
def q_streaming_request_rate(spark, sf):
    """Sliding 60 s / 10 s request counts per user from landed events."""
    land = scratch_path(spark, f"landing-events/{uuid.uuid4().hex}")
    TD.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")) \
        .write.mode("overwrite").parquet(land)
    base = scratch_path(spark, f"stream/{uuid.uuid4().hex}")
    ST.streaming_request_rate(spark, land, f"{base}/out", f"{base}/ckpt", watermark=BACKFILL_WATERMARK)
    return ST.latest_request_windows(spark, f"{base}/out")
