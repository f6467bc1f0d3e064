"""Work that must be done once, in tasks whose size does not grow with the tables."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.helpers import docs
from tokenflow.operators import analytics as A, features as FE, ml as ML
from tokenflow.plans import pipeline as PL, queries as Q
from tokenflow.schemas import FEATURES
from tokenflow.sources import export as EX, pages as PG, response_rules as RR, testdata as TD


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_parse_an_answer_once(spark):
    df = spark.createDataFrame([("{}",)], "body string")
    doc = RR.documents()[("etherscan", "tokentx")]
    plan = df.select(RR.compile_rule(doc, "body").alias("e"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json(") == 1


def test_counted_errors_evaluate_the_rules_once(spark):
    row = ("etherscan", "USDC", "ethereum", "1", "OK", '[{"hash":"0x12"}]')
    pages = spark.createDataFrame([row, row], "source_explorer string, stablecoin string, chain string, status string, message string, result string")
    counted = Q._counted_errors(pages, "tokentx")
    assert {r.error: r.n for r in counted.collect()}["result[*].hash does not match pattern"] == 2
    filters = [line for line in optimized(counted).splitlines() if "Filter" in line]
    assert all("variant" not in line.lower() for line in filters)


@pytest.mark.parametrize("price, n, mean", [("9" + "0" * 28, 4, 9e10), ("1", 3, 1e-18)])
def test_gas_total_beyond_one_decimal(spark, price, n, mean):
    tx = spark.range(n).select(F.lit("ethereum").alias("chain"), F.lit(1).cast("decimal(38,18)").alias("amount"),
                               F.lit("transaction").alias("activity_type"), F.lit(1).cast("bigint").alias("gas_used"),
                               F.lit(price).cast("decimal(38,9)").alias("gas_price"))
    r = A.by_chain(tx).where("chain = 'ethereum'").first()
    assert r.avg_gas_cost == pytest.approx(mean, rel=1e-15) and r.excluded_gas_count == 0


def test_transfers_are_dealt_by_their_number(spark, monkeypatch):
    want = TD.canonical_tx(spark, SF)
    monkeypatch.setattr(TD, "ROWS_PER_TASK", 100)
    got = TD.canonical_tx(spark, SF)
    assert got.rdd.getNumPartitions() >= TD.table(spark, SF, "lineitem").count() // 100
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_written_tables_need_no_sort(spark):
    assert not any("chain=" in f for t in (TD.tx_table, TD.collected_tx_table) for f in t(spark, SF).inputFiles())


def test_side_stats_hash(spark):
    rows = [("a", "b", 1, "x"), ("a", "c", 2, "y"), ("b", "c", 3, "x"), ("b", "c", 3, None), ("d", "d", 1, None)]
    tx = spark.createDataFrame(rows, "from_address string, to_address string, amount int, chain string").withColumn(
        "amount", F.col("amount").cast("decimal(38,18)"))
    got = FE.side_stats(tx)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert {r.a: (r.chains_from, r.chains_to) for r in got.collect()} == {
        "a": (True, None), "b": (False, False), "c": (None, True), "d": (None, None)}


def test_class_summary_reads_predictions_once(spark):
    c = spark.createDataFrame([("a", 0.5), ("a", 0.9), ("b", None)], "behavior_class string, confidence double")
    s = ML.class_summary(c)
    rows = {r.behavior_class: tuple(r)[1:] for r in s.collect()}
    assert rows == {"a": (2, 1, 0.7, 0.5, 0.9), "b": (1, 1, 0.7, 0.5, 0.9)}
    plan = s._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan") == 1
    assert ML.class_summary(c.limit(0)).count() == 0


def test_training_frame_is_computed_once(spark):
    f = spark.range(60).select(F.concat(F.lit("0x"), F.col("id").cast("string")).alias("address"), (F.col("id") % 2).cast("int").alias("label"),
                               *[(F.col("id") * k % 7).cast("double").alias(c) for k, c in enumerate(FEATURES, 1)])
    for split in (ML.train_sov(f, trees=2, depth=2)[2],
                  ML.train_wallets(FE.label_wallets(f.drop("label")), trees=2, depth=2)[2]):
        assert "left_outer" not in split._jdf.queryExecution().logical().toString().lower().replace("leftouter", "left_outer").split("logicalrdd")[-1]
        assert "_th" not in optimized(split)


def test_checked_metrics_are_frozen(spark):
    ml = Q._metrics_long(spark, SF)
    assert "Join" not in optimized(ml) and ml.count() == 8


def test_pipeline_computes_shared_frames_once(spark):
    outs = PL.analysis_pipeline(spark, TD.tx_table(spark, SF), TD.holders_base_table(spark, SF), TD.REFERENCE_TIME)
    for name in ("holder_metrics", "top_holders", "features", "wallet_labels"):
        assert "Generate explode" not in optimized(outs[name]), name


def test_export_is_compressed(spark, tmp_path):
    tx = TD.tx_table(spark, SF).limit(50)
    out = EX.write_export(spark, str(tmp_path), "r", tx, TD.holders_base_table(spark, SF).limit(5), ["etherscan"])
    for part, n in (("transactions", 50), ("holders", 5)):
        files = [f for f in os.listdir(f"{out}/{part}") if f.startswith("part-")]
        assert files and all(f.endswith(".json.gz") for f in files)
    read = EX.read_export(spark, out)
    assert (read[0].count(), read[1].count()) == (50, 5)


def test_ingest_deals_by_key_hash(spark, tmp_path, monkeypatch):
    from tokenflow.operators import merge
    from tokenflow.streaming import ingest as ST, key_index as KI
    raw = TD.raw_transfers(spark, SF).limit(200)
    raw.coalesce(1).write.mode("append").parquet(f"{tmp_path}/land")
    raw.coalesce(1).write.mode("append").parquet(f"{tmp_path}/land")  # the same rows once more
    used, real = [], merge.dedup_tx
    monkeypatch.setattr(merge, "dedup_tx", lambda tx, keys, **kw: used.append(keys) or real(tx, keys, **kw))
    ST.incremental_ingest(spark, f"{tmp_path}/land", f"{tmp_path}/out", f"{tmp_path}/ckpt", f"{tmp_path}/bad",
                          schema=spark.read.parquet(f"{tmp_path}/land").schema, max_files=1)
    assert len(used) == 2 and all(k[0] == KI.KEY for k in used)
    got = ST.ingested(spark, f"{tmp_path}/out")
    assert got.count() == raw.select("transaction_hash", "chain").distinct().count() > 0


def test_mix_is_returned_in_training_order(spark, tmp_path):
    from tokenflow.llm import mixing
    docs(spark, [(i, "w " * (i % 13), "en", f"s{i % 4}") for i in range(400)]).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    at = [r.position for r in mixing.query(spark, str(tmp_path)).collect()]
    known = [t for t in at if t is not None]
    assert len(at) == 400 and known == sorted(known) and at[:len(known)] == known


def test_wallets_are_not_sent_through_the_driver(spark, tmp_path, monkeypatch):
    """Sides that grow with the wallets meet in a shuffle, however small their files."""
    h = spark.range(200).select(F.concat(F.lit("0xA"), "id").alias("address"), (F.col("id") % 3 == 0).alias("is_store_of_value"),
                                F.col("id").alias("x"))
    h.write.parquet(f"{tmp_path}/h")
    h = spark.read.parquet(f"{tmp_path}/h")
    want = ML.label_join(h.drop("is_store_of_value"), h, one_row_per_address=True)
    monkeypatch.setattr(ML, "FEW", 199)
    got = ML.label_join(h.drop("is_store_of_value"), h, one_row_per_address=True)
    assert got.count() == 200 and got.exceptAll(want).isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
