"""Validators, raw pages and gates: property tests (hypothesis, every
example batch checked in one Spark job) and hand-written fixtures."""

import re
import string
from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tokenflow.functions import rules as R
from tokenflow.functions import scalar as S
from tokenflow.operators import merge as MG
from tokenflow.sources import pages as PG

HEX = "0123456789abcdefABCDEF"
MAX = int(R.MAX_UINT256)
AMOUNT_RE = re.compile(r"^[0-9]+(\.[0-9]{1,18})?$")


def py_amount_ok(v: str) -> bool:
    """Plain-Python statement of the V3 rule used as the property oracle."""
    if not AMOUNT_RE.match(v):
        return False
    return Decimal(v) <= MAX


amounts = st.one_of(
    st.integers(min_value=0, max_value=MAX + 10).map(str),
    st.builds(lambda i, f: f"{i}.{f}", st.integers(min_value=0, max_value=10**30),
              st.text(alphabet=string.digits, min_size=1, max_size=20)),
    st.text(alphabet="0123456789.-eE+ ", max_size=12),
    st.sampled_from([str(MAX), str(MAX + 1), f"{MAX}.0", f"{MAX}.000001", "0", "00", ".5", "5.", "1e5"]),
)


@settings(max_examples=25, deadline=None)
@given(st.lists(amounts, min_size=1, max_size=40))
def test_amount_rule_matches_plain_rule(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(R.amount_ok("v")).collect()]
    assert got == [py_amount_ok(v) for v in values]


addresses = st.one_of(
    st.text(alphabet=HEX, min_size=40, max_size=40).map(lambda h: "0x" + h),
    st.text(alphabet=HEX + "xg", min_size=0, max_size=44),
    st.text(alphabet=HEX, min_size=38, max_size=42).map(lambda h: "0x" + h),
)


@settings(max_examples=25, deadline=None)
@given(st.lists(addresses, min_size=1, max_size=40))
def test_address_rule_and_normalisation_idempotent(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "a string")
    rows = df.select(R.address_ok("a").alias("ok"), S.validate_and_normalize_address("a").alias("n")).collect()
    for v, r in zip(values, rows):
        expect = bool(re.match(r"^0x[a-fA-F0-9]{40}$", v))
        assert r.ok == expect
        assert r.n == (v.lower() if expect else None)
    twice = df.select(S.normalize_address(S.normalize_address("a"))).collect()
    assert [r[0] for r in twice] == [v.lower() for v in values]


def test_errors_name_fields_never_values(spark):
    bad = "0xZZ" + "1" * 38
    df = spark.createDataFrame([(bad, "-5")], "address string, balance string")
    from tokenflow.operators.quality import holder_record_errors
    errs = holder_record_errors(df).first().errors
    assert errs == ["address", "balance"]
    assert all(bad not in e and "-5" not in e for e in errs)


def test_message_pages_parse_to_no_rows_and_flags(spark):
    pages = spark.createDataFrame([
        ("etherscan", "USDC", "ethereum", 0, "0", "No transactions found", "No transactions found"),
        ("etherscan", "USDT", "ethereum", 0, "0", "NOTOK", "Max rate limit reached"),
        ("bscscan", "USDC", "bsc", 0, "0", "NOTOK", "Sorry, it looks like you are trying to access an API Pro endpoint"),
        ("etherscan", "USDC", "ethereum", 1, "1", "OK",
         '[{"hash":"0x' + "a" * 64 + '","blockNumber":"5","timeStamp":"1699000000","from":"0x' + "1" * 40
         + '","to":"0x' + "2" * 40 + '","value":"1000000000","contractAddress":"0x' + "3" * 40 + '"}]'),
    ], "source_explorer string, stablecoin string, chain string, page long, status string, message string, result string")
    st_ = {(r.stablecoin, r.page, r.source_explorer): r for r in PG.response_status(pages).collect()}
    assert st_[("USDC", 0, "etherscan")].response_ok and st_[("USDC", 0, "etherscan")].is_empty
    assert st_[("USDT", 0, "etherscan")].rate_limited and not st_[("USDT", 0, "etherscan")].response_ok
    assert st_[("USDC", 0, "bscscan")].pro_only
    tx = PG.read_api_transfers(pages).collect()
    assert len(tx) == 1 and tx[0].amount == Decimal("1000") and tx[0].errors == []
    assert str(tx[0].timestamp) == "2023-11-03 08:26:40"


def test_schema_errors_carry_paths(spark):
    pages = spark.createDataFrame([
        ("1", "OK", '[{"hash":"0x12","blockNumber":"x","timeStamp":"1","from":"0x' + "1" * 40
         + '","to":"0x' + "2" * 40 + '","value":"1"}]')], "status string, message string, result string")
    e = PG.response_schema_errors(pages).first()
    assert not e.schema_ok
    assert "result[0].hash does not match pattern" in e.schema_errors
    assert "result[0].blockNumber does not match pattern" in e.schema_errors
    assert "result[0].contractAddress is required" in e.schema_errors


def test_nesting_depth_and_version_class(spark):
    df = spark.createDataFrame([('{"a": [1, {"b": 2}]}',), ('{"a": "[[[["}',), ("[]",), ('{"a": {}}',)], "j string")
    assert [r[0] for r in df.select(PG.nesting_depth("j")).collect()] == [3, 1, 0, 1]
    v = spark.createDataFrame([("1.0.0", "1.0.0"), ("2.0.0", "1.0.0"), ("1.1.0", "1.0.0"),
                               ("1.0.3", "1.0.0"), ("x", "1.0.0")], "d string, e string")
    assert [r[0] for r in v.select(PG.schema_version_class("d", "e")).collect()] == [
        "none", "major", "minor", "patch", "minor"]


def test_completeness_gate(spark):
    runs = spark.createDataFrame([("etherscan", "ethereum", True, [], 1.0), ("bscscan", "bsc", True, [], 1.0),
                                  ("polygonscan", "polygon", False, ["boom"], 1.0)],
                                 "source_explorer string, chain string, success boolean, errors array<string>, seconds double")
    c = MG.completeness(runs).first()
    assert c.successful_sources == 2 and abs(c.completeness_ratio - 2 / 3) < 1e-12
    data = spark.createDataFrame([("etherscan",), ("polygonscan",)], "source_explorer string")
    assert [r[0] for r in MG.completeness_gate(runs, data, 2).collect()] == ["etherscan"]
    with pytest.raises(RuntimeError):
        MG.completeness_gate(runs, data, 3)


def test_hot_address_third_of_rows(spark):
    """One address sends a third of all transfers: results are whole and the
    per-address aggregation is partial (map-side) before the shuffle."""
    from tokenflow.operators.classify import address_sides
    from tokenflow.schemas import TX
    import datetime as dt
    hot = "0x" + "e" * 40
    rows = []
    for i in range(300):
        frm = hot if i % 3 == 0 else "0x" + f"{i:040x}"
        rows.append(("0x" + f"{i:064x}", i, dt.datetime(2024, 1, 1 + i % 28), frm, "0x" + f"{i + 1000:040x}",
                     Decimal(i), "USDC", "ethereum", "transaction", "etherscan", None, None))
    tx = spark.createDataFrame(rows, TX).repartition(6)
    sides = address_sides(tx)
    r = sides.where(F.col("address") == hot).first()
    assert r.last_out == dt.datetime(2024, 1, 28)
    plan = sides._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan


def test_fetch_limit_is_per_source_and_coin(spark):
    rec = lambda i: ('{"TokenHolderAddress":"0x' + f"{i:040x}" + '","TokenHolderQuantity":"' + str(i) + '"}')
    rows = []
    for page in range(3):
        items = ",".join(rec(page * 10 + j) for j in range(10))
        rows.append(("etherscan", "USDC", "ethereum", page, "1", "OK", "[" + items + "]"))
    rows.append(("etherscan", "USDT", "ethereum", 0, "1", "OK", "[" + rec(99) + "]"))
    pages = spark.createDataFrame(rows, "source_explorer string, stablecoin string, chain string, page long, "
                                        "status string, message string, result string")
    h = PG.read_api_holders(pages, cap=25).collect()
    usdc = sorted(int(r.address, 16) for r in h if r.stablecoin == "USDC")
    assert usdc == list(range(25))
    assert len([r for r in h if r.stablecoin == "USDT"]) == 1
    assert PG.read_api_holders(pages, cap=None).count() == 31


def test_malformed_fields_are_rejected_and_missing_ones_take_defaults(spark):
    """Only absent text takes a default; malformed text is an error."""
    good = dict(hash="0x" + "a" * 64, blockNumber="7", timeStamp="1700000000", to="0x" + "b" * 40, value="1.5",
                gasUsed="21000", gasPrice="25.5", contractAddress="0x" + "c" * 40, **{"from": "0x" + "d" * 40})
    cases = [({}, []), ({"timeStamp": "abc"}, ["timeStamp"]), ({"blockNumber": None}, []), ({"blockNumber": "x"}, ["blockNumber"]),
             ({"gasUsed": "xx"}, ["gasUsed"]), ({"timeStamp": None}, []), ({"gasPrice": "1e"}, ["gasPrice"])]
    import json
    recs = [{k: v for k, v in (good | c).items() if v is not None} for c, _ in cases]
    pages = spark.createDataFrame([("etherscan", "USDC", "ethereum", 0, "1", "OK", json.dumps(recs))],
                                  "source_explorer string, stablecoin string, chain string, page long, status string, "
                                  "message string, result string")
    out = sorted(PG.read_api_transfers(pages).collect(), key=lambda r: r.ingest_key.pos)
    assert [list(r.errors) for r in out] == [e for _, e in cases]
    assert float(out[0].amount) == 1.5e-6 and out[2].block_number == 0 and out[5].timestamp.timestamp() == 0
    from tokenflow.functions import scalar as SC
    cost = PG.read_api_transfers(pages).where("ingest_key.pos = 0").select(SC.gas_cost_native("gas_used", "gas_price").alias("c")).first().c
    assert abs(cost - 25.5 * 21000 / 1e18) < 1e-30


def test_page_files_keep_file_and_page_order(spark, tmp_path):
    """S5 over two response files: the limit takes the first records in file order."""
    import json
    rec = dict(blockNumber="1", timeStamp="1", to="0x" + "b" * 40, value="1", **{"from": "0x" + "d" * 40})
    for f in range(2):
        items = [rec | {"hash": f"0x{f}{k}" + "0" * 62} for k in range(2)]
        (tmp_path / f"{f}.json").write_text(json.dumps({"status": "1", "message": "OK", "result": json.dumps(items)}))
    from pyspark.sql import functions as F
    pages = PG.read_pages(spark, str(tmp_path)).withColumns(
        {"source_explorer": F.lit("etherscan"), "stablecoin": F.lit("USDC"), "chain": F.lit("ethereum")})
    out = PG.read_api_transfers(pages, limit=2).collect()
    assert sorted(r.transaction_hash[:4] for r in out) == ["0x00", "0x01"]
    keys = {tuple(r.ingest_key) for r in PG.read_api_transfers(pages).collect()}
    assert len(keys) == 4


def test_optional_columns_and_nested_json(spark):
    """A10 without gas columns, M1h without a chain column, S16 inside structs and maps."""
    import datetime as dt
    from decimal import Decimal

    from pyspark.sql import functions as F

    from test_operators import TX, tx_row
    from tokenflow.operators import analytics as A, features as FE
    from tokenflow.sources import export as EX
    tx = spark.createDataFrame([tx_row()], TX)
    r = A.by_chain(tx.drop("gas_used", "gas_price")).where("chain = 'ethereum'").first()
    assert r.avg_gas_cost is None and r.excluded_gas_count == 1
    assert FE.side_stats(tx.drop("chain")).count() == 2
    d = spark.createDataFrame([(1,)], "a int").select(
        F.struct(F.lit(float("nan")).alias("x"), F.lit(Decimal("1.50")).alias("y")).alias("s"),
        F.create_map(F.lit("k"), F.lit(float("inf"))).alias("m"), F.lit(dt.date(2020, 1, 2)).alias("d"))
    out = EX.json_safe(d).first()
    assert out.s.x is None and out.s.y == "1.50" and out.m == {"k": None} and out.d == "2020-01-02"


def test_split_is_exact_per_class(spark):
    """M5: round(0.2 n) of each class; a class too small falls back to one class."""
    from tokenflow.operators import features as FE
    d = spark.createDataFrame([(f"a{i}", "x" if i < 100 else "y") for i in range(137)], "address string, c string")
    n = {(r.c, r.is_test): r["count"] for r in FE.split(d, label="c").groupBy("c", "is_test").count().collect()}
    assert n[("x", True)] == 20 and n[("y", True)] == 7
    small = FE.split(d.where("address < 'a11'").withColumn("c", d.address), label="c")
    assert small.count() == round(small.count()) and small.where("is_test").count() == round(0.2 * small.count())


def test_shared_folder_is_required_on_a_cluster():
    import pytest
    from tokenflow import session
    assert session._local_scratch("local[4]").startswith("/tmp/")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session._local_scratch(master)
