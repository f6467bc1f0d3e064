"""W4 and A5 on hot keys: prefix sums and order statistics over range partitions."""

import datetime as dt
import random
import statistics

import pytest
import pyspark.sql.functions as F
from hypothesis import HealthCheck, given, settings, strategies as st

from tokenflow.operators import history as HI
from tokenflow.operators.analytics import holder_metrics
from tokenflow.operators.rank import median

T0 = dt.datetime(2024, 1, 1)


def brute(rows, window, limit):
    out = []
    for i, (user, us) in enumerate(rows):
        frame = [t for u, t in rows if u == user and us - window * 10**6 < t <= us]
        n, ok = len(frame), len(frame) - 1 < limit
        out.append((i, n, ok, limit - n if ok else 0, 0 if ok else max(1, (min(frame) + window * 10**6 - us) // 10**6 + 1)))
    return out


def rate(spark, rows, window, limit, partitions):
    df = spark.createDataFrame([(i, u, T0 + dt.timedelta(microseconds=t)) for i, (u, t) in enumerate(rows)],
                               "i int, user_id long, ts timestamp").repartition(3)
    got = HI.request_rate(df, window_seconds=window, limit=limit, partitions=partitions)
    assert got.columns == ["i", "user_id", "ts", "in_window", "allowed", "remaining", "retry_after"]
    return sorted(tuple(r)[:1] + tuple(r)[3:] for r in got.collect())


@pytest.mark.parametrize("window,limit,partitions", [(10, 5, 7), (1, 1, 20), (100000, 1000, 5)])
def test_hot_user_equals_brute_force(spark, window, limit, partitions):
    r = random.Random(window)
    rows = [(1, r.randrange(60 * 10**6)) for _ in range(500)] + [(r.choice([2, 3, None]), r.randrange(60) * 10**6) for _ in range(120)]
    rows += [(1, 30 * 10**6)] * 20 + [(1, 30 * 10**6 + window * 10**6)] * 3  # equal times, and exactly one window later
    assert rate(spark, rows, window, limit, partitions) == brute(rows, window, limit)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2]), st.integers(0, 12).map(lambda s: s * 500_000)), min_size=1, max_size=40), st.integers(1, 4))
def test_random_events(spark, rows, limit):
    assert rate(spark, rows, 2, limit, 4) == brute(rows, 2, limit)


def test_events_without_a_time_and_empty_log(spark):
    df = spark.createDataFrame([(1, None), (1, T0)], "user_id long, ts timestamp")
    got = {r.ts is None: tuple(r)[2:] for r in HI.request_rate(df).collect()}
    assert got == {True: (None,) * 4, False: (1, True, 99, 0)}
    assert HI.request_rate(df.where("false")).count() == 0


def test_a_user_with_nearly_all_events_is_spread(spark):
    """90 % of 20,000 events have one key: no range partition holds more than twice its share of the differences."""
    ev = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("_key"), (F.col("id") * 1000).alias("_at"))
    load = HI.window_load(ev, 60_000_000, partitions=8)
    assert load.count() == 20_000
    assert load.where("_key = -1").agg(F.max("in_window")).first()[0] == 18_000
    parts = [r[0] for r in HI.differences(ev, 60_000_000, partitions=8).groupBy("_part").count().select("count").collect()]
    assert len(parts) == 8 and max(parts) <= 2 * sum(parts) / 8


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 1.0], [2.0] * 7 + [9.0] * 7, list(map(float, range(101)))])
def test_median_is_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = [v for v in values if v is not None]
    assert median(df, "x", partitions=5).first()[0] == (statistics.median(known) if known else None)


def test_holder_metrics_has_no_percentile_buffer(spark):
    rows = [("a", i % 3 == 0, i, float(i % 17)) for i in range(200)]
    df = spark.createDataFrame(rows, "address string, is_store_of_value boolean, balance int, holding_period_days double")
    out = holder_metrics(df)
    assert out.first().median_holding_period_days == statistics.median([r[3] for r in rows if r[1]])
    assert "percentile" not in out._jdf.queryExecution().executedPlan().toString()
    assert holder_metrics(df.drop("holding_period_days")).first().median_holding_period_days == 0.0
    assert holder_metrics(df.where("false")).first().median_holding_period_days == 0.0
