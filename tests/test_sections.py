"""V10, S22, G7 and A25."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tokenflow.operators import analytics as A, quality as QL
from tokenflow.plans import artifacts as AR, steps as SP
from tokenflow.schemas import HOLDER, TX
from tokenflow.sources import export as EX, testdata as TD


def sections(spark):
    meta = spark.createDataFrame([("r", "2024", "1", ["a"], 3)],
                                 "run_id string, collection_timestamp string, agent_version string, explorers_queried array<string>, total_records long")
    summary = spark.createDataFrame([(k, "x", 1, "1") for k in QL.SUMMARY_PARTS], EX.SUMMARY)
    return {"metadata": meta, "summary": summary, "transactions": spark.createDataFrame([], TX), "holders": spark.createDataFrame([], HOLDER)}


def test_sections_keys_and_types_before_writing(spark):
    good = sections(spark)
    assert QL.section_problems(good) == []
    assert set(QL.validate_before_write(good)) == set(good)
    bad = {"metadata": good["metadata"].drop("agent_version").withColumn("run_id", F.lit(1)).withColumn("explorers_queried", F.lit("a")),
           "summary": good["summary"].where("kind <> 'chain'"), "transactions": good["transactions"].drop("amount")}
    assert QL.section_problems(bad) == [
        "Missing 'holders' section", "metadata: missing field agent_version", "transactions: missing field amount",
        "'run_id' must be a string", "'explorers_queried' must be a list", "Missing summary field by_chain"]
    with pytest.raises(ValueError, match="Missing 'holders' section"):
        QL.validate_before_write(bad)
    with pytest.raises(ValueError, match="missing field chain"):
        QL.validate_before_write(good | {"transactions": good["transactions"].drop("chain")})


def test_a_null_key_fails_the_write(spark, tmp_path):
    good = sections(spark)
    h = TD.holders_base_table(spark, SF).limit(5)
    gated = QL.validate_before_write(good | {"holders": h})["holders"]
    gated.write.parquet(f"{tmp_path}/ok")
    broken = QL.validate_before_write(good | {"holders": h.withColumn("address", F.when(F.col("balance") > 10**12, "x"))})["holders"]
    with pytest.raises(Exception, match="required field is null"):
        broken.write.parquet(f"{tmp_path}/bad")
    counts = {r.field: r.missing for r in QL.missing_required(h.drop("chain"), ["address", "chain"]).collect()}
    assert counts == {"address": 0, "chain": 5}


def test_artifacts_of_the_newest_completed_run(spark, tmp_path):
    base = str(tmp_path)
    preds = spark.createDataFrame([("a", 0.5, True)], "address string, sov_probability double, predicted_class boolean")
    wallets = spark.createDataFrame([("a", "whale"), ("b", "retail")], "address string, behavior_class string")
    AR.write_artifacts(spark, base, "1", {"sov_predictions": preds, "wallet_classifications": wallets, "holder_metrics": wallets})
    runs = spark.createDataFrame([("p", "1", "completed", 1), ("p", "2", "running", 2), ("q", "9", "completed", 3)],
                                 "pipeline string, run_id string, status string, created_at int")
    got = AR.load_latest_artifacts(spark, runs, base, "p")
    assert got.run_id == "1" and set(got.frames) == {"sov_predictions", "wallet_classifications"}
    assert got.frames["wallet_classifications"].count() == 2
    assert got.problems == {"activity_breakdown": "not in the manifest", "holder_metrics": "column total_holders is missing",
                            "time_series": "not in the manifest", "chain_metrics": "not in the manifest"}
    preds.write.mode("append").parquet(f"{base}/run_id=1/sov_predictions")
    assert AR.load_latest_artifacts(spark, runs, base, "p").problems["sov_predictions"] == "row count differs from the manifest"
    assert AR.load_latest_artifacts(spark, runs, base, "none") is None
    assert set(AR.load_latest_artifacts(spark, runs, base, "q").problems.values()) == {"the run has no manifest"}
    with pytest.raises(ValueError):
        AR.write_artifacts(spark, base, "3", {"other": preds})


def test_step_wrappers_are_json(spark):
    tx, h = TD.tx_table(spark, SF), TD.holders_table(spark, SF)
    act = json.loads(SP.activity_step(tx).first()[0])
    assert set(act) == {"counts", "percentages", "volumes", "volume_percentages"} and sum(act["counts"].values()) == tx.count()
    assert abs(sum(act["volume_percentages"].values()) - 100) < 1e-6 and Decimal(act["volumes"]["transaction"]) > 0
    ho = json.loads(SP.holder_step(h, top_n=3).first()[0])
    balances = [Decimal(t["balance"]) for t in ho["top_holders"]]
    assert len(balances) == 3 and balances == sorted(balances, reverse=True) and isinstance(ho["avg_balance_sov"], str)
    ch = json.loads(SP.chain_step(tx, h).first()[0])["chain_metrics"]
    assert [c["chain"] for c in ch] == ["ethereum", "bsc", "polygon"] and isinstance(ch[0]["total_volume"], str)
    ts = [json.loads(r[0]) for r in SP.time_series_step(tx, "monthly").collect()]
    assert sum(t["transaction_count"] for t in ts) == tx.where("activity_type IS NOT NULL").count()
    empty = json.loads(SP.activity_step(tx.where("false")).first()[0])
    assert set(empty["counts"].values()) == {0}


def test_chart_frames(spark):
    tx, h = TD.tx_table(spark, SF), TD.holders_table(spark, SF)
    f = A.chart_frames(tx, h)
    assert {(r.stablecoin, r.activity_type) for r in f["coin_activity"].collect()} == {
        (c, a) for c in ("USDC", "USDT") for a in ("transaction", "store_of_value", "other")}
    assert {r.status: r["count"] for r in f["holders"].collect()}["Store of Value"] == h.where("is_store_of_value").count()
    assert f["gas"].count() == 3
    assert A.chart_frames(tx.withColumn("gas_used", F.lit(None).cast("long")), h)["gas"].count() == 0
