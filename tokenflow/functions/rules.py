"""Validation rules (V1-V5, V8) as boolean column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tokenflow import dims
from tokenflow.functions.scalar import ADDRESS_RE, AMOUNT_RE, HASH_RE, col

# fixed value: 2^256 - 1, the largest uint256 amount
MAX_UINT256 = ("115792089237316195423570985008687907853269984665640564039457584007913129639935")
BLOCK_FUTURE_BUFFER = 1000
FUTURE_SLACK_SECONDS = 300


def address_ok(a) -> Column:
    """V1."""
    return F.coalesce(col(a).rlike(ADDRESS_RE), F.lit(False))


def tx_hash_ok(h) -> Column:
    """V2."""
    return F.coalesce(col(h).rlike(HASH_RE), F.lit(False))


def amount_ok(v) -> Column:
    """V3: plain decimal text, <= 18 fraction digits, <= 2^256-1.

    The bound has 78 digits (beyond decimal(38)), so the zero-stripped integer
    part is compared by (length, text); equal to the bound is valid only if
    the fraction is zero."""
    s = col(v)
    ip = F.regexp_replace(F.regexp_extract(s, r"^([0-9]+)", 1), r"^0+", "")
    frac = F.regexp_extract(s, r"\.([0-9]+)$", 1)
    frac_zero = (frac == "") | frac.rlike(r"^0+$")
    n = F.length(ip)
    mx = F.lit(MAX_UINT256)
    within = (n < 78) | ((n == 78) & ((ip < mx) | ((ip == mx) & frac_zero)))
    return F.coalesce(s.rlike(AMOUNT_RE) & within, F.lit(False))


def timestamp_ok(epoch_seconds, chain, reference_time) -> Column:
    """V4: genesis(chain) <= ts <= reference + 300 s; unknown chain invalid.
    ``reference_time`` is a parameter (the reference reads the clock)."""
    g = F.create_map(*[x for kv in dims.GENESIS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    gen = g[F.lower(col(chain))]
    ref = F.unix_seconds(F.lit(reference_time).cast("timestamp"))
    t = col(epoch_seconds).cast("bigint")
    return F.coalesce(gen.isNotNull() & (t >= gen) & (t <= ref + FUTURE_SLACK_SECONDS), F.lit(False))


def block_ok(block, max_known=None) -> Column:
    """V5: >= 0 and <= max_known + 1000 when max_known is given."""
    b = col(block)
    ok = b >= 0
    if max_known is not None:
        mk = col(max_known) if not isinstance(max_known, int) else F.lit(max_known)
        ok = ok & (mk.isNull() | (b <= mk + BLOCK_FUTURE_BUFFER))
    return F.coalesce(ok, F.lit(False))


def nonempty(c) -> Column:
    return F.coalesce(F.length(F.trim(col(c).cast("string"))) > 0, F.lit(False))


def errors_array(checks: list[tuple[str, Column]]) -> Column:
    """V6: field names of failed checks (never values), in check order.
    ``array_compact`` (not a lambda ``filter``) keeps it inside codegen."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks]))
