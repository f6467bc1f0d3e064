"""DuckDB SQL for the derived tables (same mapping as sources/testdata.py).

Used only as the correctness oracle; every registered query's SQL starts
with ``WITH`` + the CTEs it needs.
"""

ZERO = "'0x0000000000000000000000000000000000000000'"
REF = "TIMESTAMP '2001-10-01 00:00:00'"
US_DAY = "86400000000"


def addr(key: str) -> str:
    return f"('0x' || lpad(CAST({key} AS VARCHAR), 40, '0'))"


def explorer(chain: str) -> str:
    return (f"CASE {chain} WHEN 'ethereum' THEN 'etherscan' WHEN 'bsc' THEN 'bscscan' "
            f"WHEN 'polygon' THEN 'polygonscan' ELSE 'etherscan' END")


TX_RAW = f"""tx_raw AS (
  SELECT
    '0x' || lpad(CAST(l.l_orderkey * 8 + l.l_linenumber AS VARCHAR), 64, '0') AS transaction_hash,
    CAST(l.l_orderkey AS BIGINT) AS block_number,
    CAST(l.l_shipdate AS TIMESTAMP) AS "timestamp",
    {addr('o.o_custkey')} AS from_address,
    {addr('l.l_suppkey')} AS to_address,
    CASE WHEN l.l_discount = 0 THEN CAST(0 AS DECIMAL(18,2))
         ELSE CAST(l.l_extendedprice AS DECIMAL(18,2)) END AS amount,
    CASE WHEN l.l_linestatus = 'F' THEN 'USDC' ELSE 'USDT' END AS stablecoin,
    CASE WHEN l.l_returnflag = 'A' THEN 'ethereum' WHEN l.l_returnflag = 'N' THEN 'bsc'
         ELSE 'polygon' END AS chain,
    CAST(CASE WHEN l.l_tax = 0 THEN NULL ELSE 21000 + l.l_partkey END AS BIGINT) AS gas_used,
    CAST(l.l_quantity * 1e9 AS DECIMAL(38,9)) AS gas_price,
    l.l_shipdate AS k1, l.l_partkey AS k2, l.l_suppkey AS k3, l.l_extendedprice AS k4,
    l.l_quantity AS k5, l.l_discount AS k6, l.l_tax AS k7, o.o_custkey AS k8,
    l.l_linestatus AS k9,
    l.l_partkey AS lp_partkey, l.l_linenumber AS lp_linenumber
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
)"""

TX_COLLECT = f"""tx_collect AS (
  SELECT *,
    CASE WHEN lower(from_address) = {ZERO} THEN 'other'
         WHEN lower(to_address) = {ZERO} THEN 'other'
         WHEN amount > 0 AND length(from_address) > 0 AND length(to_address) > 0 THEN 'transaction'
         ELSE 'unknown' END AS activity_type,
    {explorer('chain')} AS source_explorer
  FROM tx_raw
)"""

TX_CLS = f"""tx_cls AS (
  SELECT * REPLACE (
    CASE WHEN lower(from_address) = {ZERO} THEN 'other'
         WHEN lower(to_address) = {ZERO} THEN 'other'
         WHEN amount = 0 THEN 'other' ELSE 'transaction' END AS activity_type)
  FROM tx_collect
)"""

TX = """tx AS (
  SELECT * EXCLUDE (rn, k1, k2, k3, k4, k5, k6, k7, k8, k9, lp_partkey, lp_linenumber) FROM (
    SELECT *, row_number() OVER (PARTITION BY transaction_hash, chain
                                 ORDER BY k1, k2, k3, k4, k5, k6, k7, k8, k9) AS rn
    FROM tx_cls) WHERE rn = 1
)"""

ACT = """act AS (
  SELECT address, min(ts) AS first_ts, max(ts) AS last_ts FROM (
    SELECT lower(from_address) AS address, "timestamp" AS ts FROM tx
    UNION ALL SELECT lower(to_address), "timestamp" FROM tx) GROUP BY address
)"""

HOLDERS = f"""holders AS (
  SELECT {addr('c.c_custkey')} AS address,
    CAST(c.c_acctbal AS DECIMAL(18,2)) AS balance,
    CASE WHEN c.c_custkey % 2 = 0 THEN 'USDC' ELSE 'USDT' END AS stablecoin,
    CASE c.c_custkey % 3 WHEN 0 THEN 'ethereum' WHEN 1 THEN 'bsc' ELSE 'polygon' END AS chain,
    act.first_ts AS first_seen, act.last_ts AS last_activity,
    false AS is_store_of_value,
    {explorer("CASE c.c_custkey % 3 WHEN 0 THEN 'ethereum' WHEN 1 THEN 'bsc' ELSE 'polygon' END")} AS source_explorer,
    false AS is_sov_heuristic
  FROM customer c LEFT JOIN act ON act.address = {addr('c.c_custkey')}
)"""

SIDES = """sides AS (
  SELECT address, max(CASE WHEN is_out THEN ts END) AS last_out,
         min(CASE WHEN NOT is_out THEN ts END) AS first_in FROM (
    SELECT lower(from_address) AS address, true AS is_out, "timestamp" AS ts FROM tx
    UNION ALL SELECT lower(to_address), false, "timestamp" FROM tx) GROUP BY address
)"""


def days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / {US_DAY}) AS BIGINT)"


HOLDERS_HP = f"""holders_hp AS (
  SELECT h.*, CAST(CASE
      WHEN s.last_out IS NOT NULL THEN greatest(0, {days(REF, 's.last_out')})
      WHEN s.first_in IS NOT NULL THEN greatest(0, {days(REF, 's.first_in')})
      ELSE 0 END AS BIGINT) AS holding_period
  FROM holders h LEFT JOIN sides s ON s.address = lower(h.address)
)"""

HOLDERS_SOV = """holders_sov AS (
  SELECT * EXCLUDE (holding_period) REPLACE (holding_period >= 30 AS is_store_of_value,
                                             holding_period >= 30 AS is_sov_heuristic)
  FROM holders_hp
)"""

HOLDERS_TYPED = f"""holders_typed AS (
  SELECT *, CAST(CASE WHEN first_seen IS NULL OR last_activity IS NULL THEN 0
             ELSE greatest(0, {days('last_activity', 'first_seen')}) END AS BIGINT)
             AS holding_period_days
  FROM holders_sov
)"""

_ORDER = ["TX_RAW", "TX_COLLECT", "TX_CLS", "TX", "ACT", "HOLDERS", "SIDES", "HOLDERS_HP",
          "HOLDERS_SOV", "HOLDERS_TYPED"]
_DEPS = {"TX_RAW": [], "TX_COLLECT": ["TX_RAW"], "TX_CLS": ["TX_COLLECT"], "TX": ["TX_CLS"],
         "ACT": ["TX"], "HOLDERS": ["ACT"], "SIDES": ["TX"],
         "HOLDERS_HP": ["HOLDERS", "SIDES"], "HOLDERS_SOV": ["HOLDERS_HP"],
         "HOLDERS_TYPED": ["HOLDERS_SOV"]}


def with_ctes(*needed: str, extra: str = "") -> str:
    """``WITH`` clause holding the needed CTEs (and their dependencies) in
    order, followed by ``extra`` CTE text (without leading comma)."""
    want: set[str] = set()

    def add(n):
        if n in want:
            return
        for d in _DEPS[n]:
            add(d)
        want.add(n)
    for n in needed:
        add(n)
    parts = [globals()[n] for n in _ORDER if n in want]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"

TXC = """txc AS (
  SELECT * EXCLUDE (rn, k1, k2, k3, k4, k5, k6, k7, k8, k9, lp_partkey, lp_linenumber) FROM (
    SELECT *, row_number() OVER (PARTITION BY transaction_hash, chain
                                 ORDER BY k1, k2, k3, k4, k5, k6, k7, k8, k9) AS rn
    FROM tx_collect) WHERE rn = 1
)"""

SUPP_HOLDERS = f"""supp_holders AS (
  SELECT {addr('s.s_suppkey')} AS address,
    CAST(s.s_acctbal AS DECIMAL(18,2)) AS balance,
    CASE WHEN s.s_suppkey % 2 = 0 THEN 'USDC' ELSE 'USDT' END AS stablecoin,
    CASE s.s_suppkey % 3 WHEN 0 THEN 'ethereum' WHEN 1 THEN 'bsc' ELSE 'polygon' END AS chain,
    CAST(NULL AS TIMESTAMP) AS first_seen, CAST(NULL AS TIMESTAMP) AS last_activity,
    s.s_nationkey % 2 = 0 AS is_store_of_value, 'secondary' AS source_explorer,
    false AS is_sov_heuristic
  FROM supplier s
)"""

_ORDER += ["TXC", "SUPP_HOLDERS"]
_DEPS.update({"TXC": ["TX_COLLECT"], "SUPP_HOLDERS": []})


def week_tue(ts: str) -> str:
    """Tuesday-start week of a timestamp, as DATE."""
    return f"(CAST(date_trunc('week', CAST({ts} AS DATE) - 1) AS DATE) + 1)"


def period_sql(ts: str, aggregation: str) -> str:
    if aggregation == "daily":
        return f"CAST({ts} AS DATE)"
    if aggregation == "weekly":
        return week_tue(ts)
    return f"CAST(date_trunc('month', {ts}) AS DATE)"


def ymd(d: str) -> str:
    return f"strftime({d}, '%Y-%m-%d')"


def ymdhms(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%d %H:%M:%S.%f')"
