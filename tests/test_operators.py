"""Hand-written fixtures for the edge cases of FIXTURES.md."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tokenflow import dims
from tokenflow.functions import rules as R
from tokenflow.functions import scalar as S
from tokenflow.operators import analytics as A
from tokenflow.operators import classify as CL
from tokenflow.operators import features as FE
from tokenflow.operators import merge as MG
from tokenflow.operators import timeseries as TS
from tokenflow.operators.rank import average_percentile
from tokenflow.schemas import HOLDER, TX

Z = dims.ZERO_ADDRESS
A1 = "0x" + "a" * 40
A2 = "0x" + "b" * 40
REF = dt.datetime(2024, 3, 1)


def tx_row(h="0x" + "1" * 64, ts=dt.datetime(2024, 1, 1), f=A1, t=A2, amt="10", coin="USDC",
           chain="ethereum", act="transaction", src="etherscan", gas=21000, gp="1000000000"):
    return (h, 1, ts, f, t, None if amt is None else Decimal(amt), coin, chain, act, src, gas,
            None if gp is None else Decimal(gp))


def holder_row(a=A1, bal="1", coin="USDC", chain="ethereum", first=None, last=None, sov=False, src="etherscan"):
    return (a, None if bal is None else Decimal(bal), coin, chain, first, last, sov, src, False)


def test_empty_inputs_keep_schema_and_zero_fill(spark):
    tx = spark.createDataFrame([], TX)
    r = {x.activity_type: x for x in A.activity_breakdown(tx).collect()}
    assert set(r) == set(dims.ACTIVITY_TYPES)
    assert all(x.tx_count == 0 and x.count_pct == 0.0 and x.volume_pct == 0.0 for x in r.values())
    h = A.holder_metrics(spark.createDataFrame([], HOLDER)).first()
    assert h.total_holders == 0 and h.avg_balance_sov == 0.0


def test_strict_enum_gate_raises(spark):
    tx = spark.createDataFrame([tx_row(act="unknown")], TX)
    with pytest.raises(Exception):
        A.activity_breakdown(tx).collect()
    assert A.activity_breakdown(tx, strict=False).count() == 3


def test_classify_zero_address_any_case_and_zero_amount(spark):
    rows = [tx_row(h="0x" + "1" * 64, f=Z.upper().replace("0X", "0x")),
            tx_row(h="0x" + "2" * 64, t="0x" + "0" * 40),
            tx_row(h="0x" + "3" * 64, amt="0"),
            tx_row(h="0x" + "4" * 64)]
    out = CL.classify_transactions(spark.createDataFrame(rows, TX)).select("activity_type").collect()
    assert [r[0] for r in out] == ["other", "other", "other", "transaction"]


def test_dedup_first_source_kept_other_chain_kept(spark):
    rows = [tx_row(src="etherscan"), tx_row(src="bscscan"), tx_row(chain="bsc", src="bscscan")]
    df = spark.createDataFrame(rows, TX).withColumn(
        "ingest_key", F.struct(F.when(F.col("source_explorer") == "etherscan", 0).otherwise(1).alias("r")))
    out = MG.dedup_tx(df).collect()
    assert len(out) == 2
    eth = [r for r in out if r.chain == "ethereum"][0]
    assert eth.source_explorer == "etherscan"


def test_merge_holders_case_insensitive(spark):
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    rows = [holder_row(a=A1, bal="5", first=t2, last=t2, src="etherscan"),
            holder_row(a=A1.upper().replace("0X", "0x"), bal="7", first=t1, last=None, sov=True, src="bscscan")]
    out = MG.merge_holders(MG.union_sources([spark.createDataFrame(x, HOLDER).withColumn("ingest_key", F.lit(0))
                                             for x in (rows[:1], rows[1:])])).collect()
    assert len(out) == 1
    r = out[0]
    assert r.balance == Decimal("7") and r.first_seen == t1 and r.last_activity == t2
    assert r.is_store_of_value is True and r.source_explorer == "etherscan,bscscan" and r.address == A1


def test_holding_period_branches(spark):
    txs = [tx_row(h="0x" + "1" * 64, ts=dt.datetime(2024, 1, 1), f=A1, t=A2),      # A1 sends
           tx_row(h="0x" + "2" * 64, ts=dt.datetime(2024, 1, 31), f=A2, t="0x" + "c" * 40)]
    hs = [holder_row(a=A1), holder_row(a=A2), holder_row(a="0x" + "c" * 40), holder_row(a="0x" + "d" * 40)]
    tx = spark.createDataFrame(txs, TX)
    out = {r.address: r.holding_period for r in
           CL.holding_period(spark.createDataFrame(hs, HOLDER), tx, REF).collect()}
    assert out[A1] == 60                      # since last outgoing
    assert out[A2] == 30                      # last outgoing (2024-01-31)
    assert out["0x" + "c" * 40] == 30         # only incoming: since first incoming
    assert out["0x" + "d" * 40] == 0          # no transfers
    # exactly 30 days is store of value; reference before last outgoing -> 0
    sov = {r.address: r.is_store_of_value for r in
           CL.sov_heuristic(spark.createDataFrame(hs, HOLDER), tx, REF).collect()}
    assert sov[A2] is True
    early = CL.holding_period(spark.createDataFrame(hs[:1], HOLDER), tx, dt.datetime(2023, 1, 1)).first()
    assert early.holding_period == 0


def test_weekly_periods_start_tuesday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 2),)], "ts timestamp")
    out = [r[0] for r in df.select(S.period_bucket("ts", "weekly")).collect()]
    assert out == [dt.date(2023, 12, 26), dt.date(2024, 1, 2)]
    with pytest.raises(ValueError):
        S.period_bucket("ts", "hourly")


def test_time_series_drops_null_keys_and_totals_conserve(spark):
    rows = [tx_row(h="0x" + "1" * 64), tx_row(h="0x" + "2" * 64, act=None), tx_row(h="0x" + "3" * 64, ts=None)]
    tx = spark.createDataFrame(rows, TX)
    s = TS.time_series_totals(tx, "daily").collect()
    assert len(s) == 1 and s[0].transaction_count == 1 and s[0].total_count == 3


def test_percentile_average_ties_and_null(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0), (4, None), (5, 5.0)], "id int, b double")
    out = {r.id: r.p for r in average_percentile(df, "b", "p", partitions=3).collect()}
    assert out == {1: 37.5, 2: 37.5, 3: 75.0, 4: None, 5: 100.0}


def test_features_single_send_volatility_and_cross_chain(spark):
    txs = [tx_row(h="0x" + "1" * 64, f=A1, t=A2, chain="ethereum"),
           tx_row(h="0x" + "2" * 64, f=A2, t=A1, chain="bsc")]
    hs = [holder_row(a=A1, first=dt.datetime(2024, 1, 1), last=dt.datetime(2024, 2, 1))]
    f = FE.holder_features(spark.createDataFrame(hs, HOLDER), spark.createDataFrame(txs, TX), REF).first()
    assert f.balance_volatility == 0.0          # one send, one receive: std undefined -> 0
    assert f.cross_chain_flag == 0              # sends on one chain, receives on another
    assert f.transaction_count == 2
    assert abs(f.holding_period_days - 60.0) < 1e-9
    empty = FE.holder_features(spark.createDataFrame(hs, HOLDER), None, REF).first()
    assert empty.transaction_count == 0 and empty.avg_transaction_size == 0.0


def test_amount_rule_boundaries(spark):
    mx = R.MAX_UINT256
    cases = [(mx, True), (str(int(mx) + 1), False), ("1." + "1" * 19, False), ("1e5", False),
             (".5", False), ("5.", False), ("0", True), ("-1", False), (mx + ".0", True), (mx + ".5", False)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "v string")
    got = [r[0] for r in df.select(R.amount_ok("v")).collect()]
    assert got == [e for _, e in cases]


def test_address_and_hash_rules(spark):
    df = spark.createDataFrame([(A1.upper().replace("0X", "0x"),), ("0x123",), ("1x" + "a" * 40,)], "a string")
    assert [r[0] for r in df.select(R.address_ok("a")).collect()] == [True, False, False]


def test_scale_amount_known_answer(spark):
    df = spark.createDataFrame([("1000000000", 6), ("1", 18), ("abc", 6)], "v string, d int")
    out = [r[0] for r in df.select(S.scale_amount("v", F.col("d"))).collect()]
    assert out == [Decimal("1000"), Decimal("0.000000000000000001"), None]
    e = spark.createDataFrame([("1699000000",)], "s string").select(S.parse_epoch("s")).first()[0]
    assert e == dt.datetime(2023, 11, 3, 8, 26, 40)


def test_numbers_out_of_range_reject_and_do_not_raise(spark):
    df = spark.createDataFrame([("99999999999999999",), ("253402300799",), ("253402300800",), ("-62135596801",), ("9" * 40,), ("",)], "s string")
    got = [r[0] is None for r in df.select(S.parse_epoch("s").cast("string")).collect()]
    assert got == [True, False, True, True, True, False]
    gas = spark.createDataFrame([(21000, Decimal(10) ** 25), (21000, Decimal(10) ** 20), (10**18, Decimal("1.5")), (None, Decimal(1)),
                                 (2**63 - 1, Decimal(10) ** 28), (3, None)], "u long, p decimal(38,9)")
    got = [r[0] for r in gas.select(S.gas_cost_native("u", "p")).collect()]
    assert got == [None, 2.1e6, 1.5, None, None, None]


def test_union_keeps_the_order_of_each_type(spark):
    a = spark.createDataFrame([("x", 10), ("x", 9)], "name string, ingest_key long")
    b = spark.createDataFrame([("y", "10"), ("y", "9")], "name string, ingest_key string")
    out = MG.union_sources([a, b, a])
    first = {r[0]: r[1] for r in out.groupBy("ingest_key.source_rank").agg(F.min("ingest_key").alias("k")).select("source_rank", "k.pos").collect()}
    assert first[0].k0 == 9 and first[1].k1 == "10" and first[2].k0 == 9
    assert MG.union_sources([a, a]).schema["ingest_key"].dataType["pos"].dataType.simpleString() == "bigint"


def test_duplicate_prediction_address_raises(spark):
    h = spark.createDataFrame([holder_row()], HOLDER)
    p = spark.createDataFrame([(A1, True), (A1, False)], "address string, prediction boolean")
    with pytest.raises(ValueError):
        CL.sov_ml_override(h, p)
    ok = spark.createDataFrame([(A1, True)], "address string, predicted_class boolean")
    assert CL.sov_ml_override(h, ok).first().is_store_of_value is True


def test_chain_ties_first_in_fixed_order(spark):
    rows = [tx_row(h="0x" + "1" * 64, chain="bsc"), tx_row(h="0x" + "2" * 64, chain="ethereum")]
    bc = A.by_chain(spark.createDataFrame(rows, TX))
    assert A.most_active_chain(bc).first().chain == "ethereum"


def test_wallet_labels_priority(spark):
    f = spark.createDataFrame([(99.5, 5.0, 1.0), (50.0, 5.0, 2.0), (50.0, 0.01, 40.0), (50.0, 0.5, 10.0)],
                              "balance_percentile double, transaction_frequency double, holding_period_days double")
    assert [r.behavior_class for r in FE.label_wallets(f).collect()] == ["whale", "trader", "holder", "retail"]


def test_column_checks_and_sov_flag_type(spark):
    tx = spark.createDataFrame([tx_row()], TX)
    with pytest.raises(ValueError):
        A.activity_breakdown(tx.drop("amount"))
    h_str = spark.createDataFrame([("0x" + "a" * 40, "ethereum", "yes")], "address string, chain string, is_store_of_value string")
    with pytest.raises(ValueError):
        A.by_chain(tx, h_str)
    h_num = spark.createDataFrame([("0x" + "a" * 40, "ethereum", 1), ("0x" + "b" * 40, "ethereum", 0)],
                                  "address string, chain string, is_store_of_value int")
    r = {x.chain: x.sov_ratio for x in A.by_chain(tx, h_num).collect()}
    assert r["ethereum"] == 0.5 and r["bsc"] == 0.0
