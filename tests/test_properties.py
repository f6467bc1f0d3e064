"""Property tests against plain-Python / pandas statements of the rules
(each hypothesis example batch is one Spark job)."""

import datetime as dt
from decimal import Decimal

import pandas as pd
from hypothesis import given, settings, strategies as st

from tokenflow.functions import scalar as S
from tokenflow.operators.rank import average_percentile


@settings(max_examples=15, deadline=None)
@given(st.lists(st.datetimes(min_value=dt.datetime(2015, 1, 1), max_value=dt.datetime(2030, 12, 31)),
                min_size=1, max_size=30))
def test_weekly_bucket_equals_pandas_w_mon(spark, ts):
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp")
    got = [r[0] for r in df.select(S.period_bucket("ts", "weekly")).collect()]
    want = [p.start_time.date() for p in pd.Series(pd.to_datetime(ts)).dt.to_period("W-MON")]
    assert got == want
    months = [r[0] for r in df.select(S.period_bucket("ts", "monthly")).collect()]
    assert months == [t.date().replace(day=1) for t in ts]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(min_value=-5, max_value=20)), min_size=1, max_size=60),
       st.integers(min_value=1, max_value=7))
def test_percentile_equals_pandas_rank_pct(spark, values, parts):
    rows = [(i, None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, b double")
    got = {r.id: r.p for r in average_percentile(df, "b", "p", partitions=parts).collect()}
    want = (pd.Series([v for _, v in rows], dtype="float64").rank(pct=True) * 100).tolist()
    for i, w in enumerate(want):
        if pd.isna(w):
            assert got[i] is None
        else:
            assert abs(got[i] - w) < 1e-9


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(min_value=0, max_value=10**37), st.sampled_from([0, 6, 18])),
                min_size=1, max_size=30))
def test_scale_amount_is_exact_decimal_shift(spark, pairs):
    df = spark.createDataFrame([(str(v), d) for v, d in pairs], "v string, d int")
    got = [r[0] for r in df.select(S.scale_amount("v", "d")).collect()]
    import decimal
    for (v, d), g in zip(pairs, got):
        with decimal.localcontext(decimal.Context(prec=100)):  # Python's default 28 digits would round
            exact = Decimal(v).scaleb(-d)
        if exact >= Decimal(10) ** 20:      # beyond decimal(38,18): NULL -> quarantine
            assert g is None
        else:
            assert g == exact
