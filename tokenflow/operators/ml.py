"""Models on the wallet features (M6-M16) with Spark ML.

xgboost / scikit-learn are replaced by Spark ML forests and boosted trees
(all take ``weightCol``); numbers will not equal the reference's models, so
tests check invariants (bounds, one class per row, sums) rather than values.
Metrics that are plain aggregations of (label, prediction, score) are
computed with DataFrame aggregates and are exactly checkable.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tokenflow import dims
from tokenflow.operators import boosting
from tokenflow.operators.features import split
from tokenflow.operators.rank import value_ranks
from tokenflow.schemas import FEATURES
from tokenflow.session import checkpoint_dir

#: wallets up to which Spark may choose to broadcast a side of the label join
FEW = 100_000

CLASS_INDEX = {c: i for i, c in enumerate(dims.BEHAVIOR_CLASSES)}


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")


# E5 -------------------------------------------------------------------------
def label_join(features: DataFrame, holders: DataFrame, one_row_per_address: bool = False) -> DataFrame:
    """Features x distinct (lower(address), SoV flag); may fan out when an
    address carries both flags (kept, as in the reference) unless
    ``one_row_per_address`` (then any True wins). Both sides are as many as the
    wallets: more than ``FEW`` are joined by a shuffle even where their compressed
    files look small enough to be sent through the driver."""
    lab = holders.select(F.lower("address").alias("_a"),
                         F.coalesce("is_store_of_value", F.lit(False)).cast("int").alias("label"))
    lab = (lab.groupBy("_a").agg(F.max("label").alias("label")) if one_row_per_address
           else lab.dropDuplicates(["_a", "label"]))
    if features.count() > FEW:
        lab = lab.hint("merge")
    return features.join(lab, F.lower(features["address"]) == lab["_a"], "inner").drop("_a")


# M6 -------------------------------------------------------------------------
def train_sov(labeled: DataFrame, model: str = "forest", trees: int = 100, depth: int = 10,
              seed: int = 42, test_size: float = 0.2):
    """Binary SoV model; positive weight = negatives / max(positives, 1).
    counted on the training side only. Returns (PipelineModel | None, test
    predictions, train/test split frame). A single-class label set returns no
    model (metrics short-circuit); no labelled row at all is an error."""
    checkpoint_dir(labeled.sparkSession)
    s = split(labeled, test_size=test_size, seed=seed, label="label").checkpoint(eager=True)  # every pass of the fit reads it
    counts = s.where(~F.col("is_test")).groupBy("label").count().collect()  # <= 2 rows
    if not counts and labeled.isEmpty():
        raise ValueError("no feature row matches a labelled holder")
    pos = sum(r["count"] for r in counts if r["label"] == 1)
    neg = sum(r["count"] for r in counts if r["label"] == 0)
    if pos == 0 or neg == 0:
        return None, None, s
    w = float(neg) / max(pos, 1)
    s = s.withColumn("weight", F.when(F.col("label") == 1, F.lit(w)).otherwise(F.lit(1.0)))
    if model == "gbt":
        clf = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight",
                            maxDepth=depth, maxIter=trees, seed=seed)
    else:
        clf = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight",
                                     numTrees=trees, maxDepth=depth, seed=seed)
    pm = Pipeline(stages=[_assembler(), clf]).fit(s.where(~F.col("is_test")))
    preds = pm.transform(s.where(F.col("is_test")))
    return pm, preds, s


# M7 -------------------------------------------------------------------------
def eval_binary(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                score: str = "score") -> DataFrame:
    """precision, recall, f1 (0 on zero division) and exact ROC AUC (ties
    averaged, Mann-Whitney form); AUC 0.5 when only one class is present.
    The score ranks come from the range-partitioned rank (no global window)."""
    y = F.col(label).cast("int")
    yhat = F.col(prediction).cast("int")
    c = pred.agg(F.count_if((y == 1) & (yhat == 1)).alias("tp"),
                 F.count_if((y == 0) & (yhat == 1)).alias("fp"),
                 F.count_if((y == 1) & (yhat == 0)).alias("fn"),
                 F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"))
    r = value_ranks(pred, score)
    avg_rank = F.col("_below").cast("double") + (F.col("_cnt").cast("double") + 1.0) / 2.0
    # positives per distinct score first: a common score is one row on both sides
    per_score = pred.where(y == 1).groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("_p"))
    pos_ranks = (per_score.join(r.select(F.col(score).alias("_s"), avg_rank.alias("_r")), "_s")
                 .agg(F.sum(F.col("_p") * F.col("_r")).alias("rank_sum_pos")))
    j = _one(c, pos_ranks)
    tp, fp, fn, p, n = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "p", "n"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2.0 * prec * rec / (prec + rec)).otherwise(0.0)
    auc = F.when((p > 0) & (n > 0),
                 (F.col("rank_sum_pos") - p * (p + 1.0) / 2.0) / (p * n)).otherwise(0.5)
    return j.select(prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), auc.alias("auc"),
                    F.col("p").cast("bigint").alias("positives"), F.col("n").cast("bigint").alias("negatives"))


def _one(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of the one-row frame ``b`` on every row of ``a`` (scalar subqueries)."""
    from tokenflow.functions.frames import attach_scalars
    return attach_scalars(a, b)


# M8 -------------------------------------------------------------------------
def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(FEATURES, [float(x) for x in imp])), "feature string, importance double")


# M9 -------------------------------------------------------------------------
def class_index(c) -> F.Column:
    """Fixed label -> index (trader 0, holder 1, whale 2, retail 3)."""
    m = F.create_map(*[x for k, v in CLASS_INDEX.items() for x in (F.lit(k), F.lit(float(v)))])
    return m[c]


def train_wallets(labeled: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42,
                  model: str = "forest"):
    """4-class model on M3 labels with class weights (M4): ``forest``, ``boosted`` (one
    multinomial model, ``boosting``) or ``ovr-gbt`` (one binary model per class)."""
    from tokenflow.operators.features import class_weights
    d = labeled.withColumn("label", class_index(F.col("behavior_class")))
    checkpoint_dir(d.sparkSession)
    s = split(d, test_size=0.2, seed=seed, label="behavior_class").checkpoint(eager=True)  # every pass of the fit reads it
    w = class_weights(s.where(~F.col("is_test"))).select("behavior_class", "weight")  # training rows only
    s = s.join(F.broadcast(w.where(F.col("behavior_class").isin(*dims.BEHAVIOR_CLASSES))), "behavior_class", "left")
    s = s.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    if model == "boosted":
        pm = boosting.fit(s.where(~F.col("is_test")), _assembler(), len(CLASS_INDEX), trees, depth, seed=seed)
        return pm, pm.transform(s.where(F.col("is_test"))), s
    if model == "ovr-gbt":
        clf = OneVsRest(classifier=GBTClassifier(maxDepth=depth, maxIter=trees, seed=seed),
                        labelCol="label", featuresCol="features", weightCol="weight")
    else:
        clf = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight",
                                     numTrees=trees, maxDepth=depth, seed=seed)
    pm = Pipeline(stages=[_assembler(), clf]).fit(s.where(~F.col("is_test")))
    return pm, pm.transform(s.where(F.col("is_test"))), s


# M10 ------------------------------------------------------------------------
def eval_multiclass(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy, macro precision / recall / f1 and per-class p/r/f1 from the
    confusion counts (one groupBy; the per-class table has <= k rows)."""
    cm = pred.groupBy(F.col(label).alias("y"), F.col(prediction).alias("yhat")).agg(F.count("*").alias("n"))
    per_true = cm.groupBy("y").agg(F.sum("n").alias("support"),
                                   F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n"))).alias("tp"))
    per_pred = cm.groupBy(F.col("yhat").alias("y")).agg(F.sum("n").alias("predicted"))
    pc = per_true.join(per_pred, "y", "full").na.fill(0, ["support", "tp", "predicted"])
    pc = pc.select(F.col("y").alias("class"),
                   F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0).alias("precision"),
                   F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0).alias("recall"),
                   "tp", "support")
    pc = pc.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                    2.0 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                       .otherwise(0.0))
    w = Window.partitionBy()  # over the k class rows
    return (pc.withColumn("accuracy", F.sum("tp").over(w).cast("double") / F.sum("support").over(w).cast("double"))
              .withColumn("macro_precision", F.avg("precision").over(w))
              .withColumn("macro_recall", F.avg("recall").over(w))
              .withColumn("macro_f1", F.avg("f1").over(w)))


# M11 / M12 ------------------------------------------------------------------
def predict_sov(features: DataFrame, model: PipelineModel | None) -> DataFrame:
    """address, sov_probability clipped to [0,1], predicted_class; no model
    -> empty result with the schema."""
    if model is None:
        return features.limit(0).select("address", F.lit(0.0).alias("sov_probability"),
                                        F.lit(False).alias("predicted_class"))
    p = model.transform(features)
    prob = F.least(F.greatest(vector_to_array("probability")[1], F.lit(0.0)), F.lit(1.0))
    return p.select("address", prob.alias("sov_probability"),
                    (F.col("prediction") == 1.0).alias("predicted_class"))


def pred_metadata(preds: DataFrame) -> DataFrame:
    n = F.count("*")
    pos = F.count_if(F.col("predicted_class"))
    return preds.agg(n.cast("bigint").alias("prediction_count"), pos.cast("bigint").alias("predicted_sov"),
                     F.when(n > 0, pos.cast("double") / n.cast("double")).otherwise(0.0).alias("sov_ratio"),
                     F.coalesce(F.avg("sov_probability"), F.lit(0.0)).alias("mean_probability"))


# M13 / M14 ------------------------------------------------------------------
def classify_wallets(features: DataFrame, model: PipelineModel) -> DataFrame:
    """class, confidence = max probability, one probability column per class
    looked up by label index (absent class -> 0)."""
    p = model.transform(features)
    vector = p.schema["probability"].dataType.typeName() != "array"
    p = p.withColumn("_pr", vector_to_array("probability") if vector else F.col("probability"))
    cols = []
    for c, i in CLASS_INDEX.items():
        cols.append(F.coalesce(F.when(F.size("_pr") > i, F.col("_pr")[i]), F.lit(0.0)).alias(f"prob_{c}"))
    inv = F.create_map(*[x for k, v in CLASS_INDEX.items() for x in (F.lit(float(v)), F.lit(k))])
    return p.select("address", inv[F.col("prediction")].alias("behavior_class"),
                    F.array_max("_pr").alias("confidence"), *cols)


def class_summary(classified: DataFrame, low: float = 0.6) -> DataFrame:
    """Rows per class with the confidence figures of all rows, from one pass over the predictions."""
    c = F.col("confidence")
    g = classified.groupBy("behavior_class").agg(
        F.count("*").cast("bigint").alias("count"), F.count_if(c < low).alias("_low"), F.sum(c).alias("_sum"),
        F.count(c).alias("_n"), F.min(c).alias("_min"), F.max(c).alias("_max"))
    w = Window.partitionBy()  # over the k class rows
    return g.select("behavior_class", "count", F.sum("_low").over(w).cast("bigint").alias("low_confidence"),
                    (F.sum("_sum").over(w) / F.nullif(F.sum("_n").over(w), F.lit(0).cast("bigint"))).alias("avg_confidence"),
                    F.min("_min").over(w).alias("min_confidence"), F.max("_max").over(w).alias("max_confidence"))


# M15 ------------------------------------------------------------------------
def training_metadata(split_df: DataFrame, label: str = "label",
                      taxonomy_version: str | None = None) -> DataFrame:
    """sample counts and positive ratios per side of the split."""
    out = split_df.groupBy(F.when(F.col("is_test"), "test").otherwise("train").alias("part")).agg(
        F.count("*").cast("bigint").alias("samples"),
        F.avg(F.col(label).cast("double")).alias("positive_ratio"))
    if taxonomy_version is not None:
        out = out.withColumn("taxonomy_version", F.lit(taxonomy_version))
    return out


# M16 / S20 ------------------------------------------------------------------
def save_model(spark: SparkSession, model: PipelineModel, base: str, name: str,
               metrics: dict[str, float], version: str | None = None) -> str:
    """Versioned model directory + an appended MODEL_VERSIONS row (parquet)."""
    version = version or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S")
    path = f"{base}/{name}/{version}"
    model.write().overwrite().save(path)
    row = spark.createDataFrame([(name, version, path, _dt.datetime.now(_dt.timezone.utc), metrics, False)],
                                "model_name string, version string, path string, created timestamp, "
                                "metrics map<string,double>, is_production boolean")
    row.write.mode("append").parquet(f"{base}/_versions")
    return version


def _table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """Rows of one model; None if the table was never written."""
    try:
        return spark.read.parquet(path).where(F.col("model_name") == name)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_model(spark: SparkSession, base: str, name: str, version: str = "latest") -> PipelineModel | None:
    """``latest`` = newest version row; missing -> None."""
    v = _table(spark, f"{base}/_versions", name)
    if v is None:
        return None
    if version == "latest":
        r = v.agg(F.max_by("path", "created").alias("p")).first()
    else:
        r = v.where(F.col("version") == version).agg(F.max_by("path", "created").alias("p")).first()
    if r is None or r["p"] is None:
        return None
    return PipelineModel.load(r["p"])


def promote_model(spark: SparkSession, base: str, name: str, version: str) -> None:
    """Append a stage event; the production flag is the latest event."""
    ev = spark.createDataFrame([(name, version, _dt.datetime.now(_dt.timezone.utc))],
                               "model_name string, version string, promoted timestamp")
    ev.write.mode("append").parquet(f"{base}/_promotions")


def model_versions(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Versions with metrics and the production flag (latest promotion)."""
    v = spark.read.parquet(f"{base}/_versions").where(F.col("model_name") == name)
    events = _table(spark, f"{base}/_promotions", name)
    if events is not None:
        p = events.agg(F.max_by("version", "promoted").alias("prod"))
        v = _one(v.drop("is_production"), p).withColumn("is_production", F.col("version") == F.col("prod")).drop("prod")
    return v.withColumn("promotable", ~F.col("is_production") & F.col("version").isNotNull())
