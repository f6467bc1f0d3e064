"""Scalar derivations (P-operators) as Spark column expressions.

All of them are built-in expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tokenflow import dims
from tokenflow.schemas import AMOUNT

ADDRESS_RE = r"^0x[a-fA-F0-9]{40}$"
HASH_RE = r"^0x[a-fA-F0-9]{64}$"
AMOUNT_RE = r"^[0-9]+(\.[0-9]{1,18})?$"
US_PER_DAY = 86_400_000_000
#: 0001-01-01 and 9999-12-31T23:59:59 in Unix seconds
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# P1 ---------------------------------------------------------------------
def scale_amount(raw, decimals) -> Column:
    """Raw number string / 10^decimals, exact: the text gets the exponent
    ``e-<decimals>`` and is parsed once, so no intermediate type can overflow or
    round. Malformed or too large (> 20 integer digits) -> NULL."""
    text = col(raw)
    d = (col(decimals) if not isinstance(decimals, int) else F.lit(decimals)).cast("string")
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.concat(text, F.lit("e-"), d).try_cast(AMOUNT))


# P2 ---------------------------------------------------------------------
def parse_epoch(s) -> Column:
    """Unix seconds string -> UTC timestamp; missing -> epoch 0, malformed or
    outside the years 1 to 9999 -> NULL (the caller rejects the record)."""
    secs = F.when(missing(s), F.lit(0).cast("bigint")).otherwise(col(s).try_cast("bigint"))
    return F.timestamp_seconds(F.when(secs.between(FIRST_SECOND, LAST_SECOND), secs))


def missing(s) -> Column:
    """Absent or blank text."""
    return F.coalesce(F.trim(col(s)) == "", F.lit(True))


# P5 ---------------------------------------------------------------------
def classify_collect(from_addr, to_addr, amount) -> Column:
    """Collect-time activity: mint/burn -> other, positive transfer between
    two parties -> transaction, anything else -> unknown."""
    f, t, a = F.lower(col(from_addr)), F.lower(col(to_addr)), col(amount)
    z = F.lit(dims.ZERO_ADDRESS)
    return (F.when(f == z, "other").when(t == z, "other")
            .when((a > 0) & (F.length(col(from_addr)) > 0) & (F.length(col(to_addr)) > 0),
                  "transaction")
            .otherwise("unknown"))


# P6 ---------------------------------------------------------------------
def classify_tx(from_addr, to_addr, amount) -> Column:
    """Canonical activity: zero sender or receiver (case-insensitive) or a
    zero amount -> other, else transaction."""
    f, t, a = F.lower(col(from_addr)), F.lower(col(to_addr)), col(amount)
    z = F.lit(dims.ZERO_ADDRESS)
    return (F.when(f == z, "other").when(t == z, "other")
            .when(a == 0, "other").otherwise("transaction"))


# P7 ---------------------------------------------------------------------
def normalize_address(a) -> Column:
    return F.lower(col(a))


def validate_and_normalize_address(a) -> Column:
    return F.when(col(a).rlike(ADDRESS_RE), F.lower(col(a)))


# P8 / P9 / P10 ------------------------------------------------------------
def safe_decimal(v) -> Column:
    """null, empty or malformed -> NULL (try_cast: ANSI mode would fail)."""
    return F.nullif(F.trim(col(v).cast("string")), F.lit("")).try_cast(AMOUNT)


def safe_timestamp(s) -> Column:
    """ISO-8601 text (``Z`` or ``+00:00`` accepted) -> timestamp; bad -> NULL."""
    return F.try_to_timestamp(F.nullif(F.trim(col(s)), F.lit("")))


def ensure_utc(c, naive: bool = True) -> Column:
    """Naive (TIMESTAMP_NTZ) values are taken as UTC; the session time zone
    is pinned to UTC, so the cast keeps the wall clock."""
    return col(c).cast("timestamp")


# P11 ----------------------------------------------------------------------
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def period_bucket(ts, aggregation: str = "daily", week_start: str = "tuesday") -> Column:
    """Period start date. Weekly periods start on Tuesday by default (the
    reference's pandas ``W-MON`` periods *end* on Monday)."""
    d = F.to_date(col(ts))
    if aggregation == "daily":
        return d
    if aggregation == "weekly":
        k = WEEKDAYS.index(week_start.lower())
        if k == 0:
            return F.to_date(F.date_trunc("week", d))
        return F.date_add(F.to_date(F.date_trunc("week", F.date_sub(d, k))), k)
    if aggregation == "monthly":
        return F.trunc(d, "month")
    raise ValueError(f"Invalid aggregation: {aggregation!r}; "
                     "expected 'daily', 'weekly' or 'monthly'")


# P12 ----------------------------------------------------------------------
explorer_for_chain = dims.explorer_expr


# P13 ----------------------------------------------------------------------
def gas_wei_product(gas_used, gas_price) -> Column:
    """gas_used * gas_price in wei, exact to the 9 digits that a price may
    have: whole and fractional part of the price are multiplied apart, so the
    product keeps its scale. A product of 1e29 wei or more is NULL."""
    used, price = col(gas_used).cast("decimal(19,0)"), col(gas_price).try_cast("decimal(38,9)")
    whole = F.floor(price)
    part = (price - whole).cast("decimal(9,9)")
    return F.try_add(F.try_multiply(used, whole).try_cast("decimal(38,9)"), (used * part).cast("decimal(28,9)")).try_cast("decimal(38,9)")


def gas_cost_native(gas_used, gas_price) -> Column:
    """gas_used * gas_price / 1e18 (native units) as double."""
    return gas_wei_product(gas_used, gas_price).cast("double") / F.lit(1e18)


# P14 / P15 ----------------------------------------------------------------
def confidence_level(score) -> Column:
    s = col(score)
    return F.when(s >= 0.85, "high").when(s >= 0.5, "medium").otherwise("low")


def sov_status_label(flag) -> Column:
    return F.when(col(flag), "Store of Value").otherwise("Active Transactor")


def sov_probability_label(p) -> Column:
    return F.when(col(p) >= 0.5, "Likely SoV").otherwise("Likely Active")


# P19 ----------------------------------------------------------------------
def mask_address(a) -> Column:
    """first 6 + '...' + last 4 characters when longer than 10."""
    c = col(a)
    return F.when(F.length(c) > 10,
                  F.concat(F.substring(c, 1, 6), F.lit("..."), F.right(c, F.lit(4)))
                  ).otherwise(c)


# time helpers --------------------------------------------------------------
def whole_days_between(later, earlier) -> Column:
    """floor((later - earlier) / 1 day) on exact microseconds."""
    diff = F.unix_micros(col(later)) - F.unix_micros(col(earlier))
    return F.floor(diff / F.lit(US_PER_DAY)).cast("bigint")


def fractional_days_between(later, earlier) -> Column:
    diff = F.unix_micros(col(later)) - F.unix_micros(col(earlier))
    return diff.cast("double") / F.lit(float(US_PER_DAY))


def round2_half_even(x) -> Column:
    """Python/numpy ``round(x, 2)`` (half-even on the binary value)."""
    return F.rint(col(x) * 100.0) / 100.0
