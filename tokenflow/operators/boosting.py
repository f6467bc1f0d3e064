"""M9: one multinomial boosted model, by additive logistic regression on
Spark's regression trees.

With scores f_1 .. f_K and p = softmax(f), a round fits one tree per class to
the working response z = (y - p) / h with row weight w * h, h = p (1 - p). The weighted
mean of z in a leaf is sum(w (y - p)) / sum(w h), the Newton step of the
multinomial log-likelihood, so Spark's leaf values need no second pass. All classes of a
round start from the same probabilities, which therefore sum to 1, and their trees
are fitted at the same time (as ``OneVsRest`` does with ``parallelism``).

Rows stay distributed: the driver loop sees trees only. The scores of the
training rows are frozen in the shared folder after every round. The result is
an ordinary ``PipelineModel`` (assembler, one tree ensemble per class, softmax in SQL) that is
saved and loaded like any other.
"""

from __future__ import annotations

import uuid
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import add

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from tokenflow.session import checkpoint_dir

#: least curvature of a row: no working response beyond 4
LEAST = 0.25


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    e = [F.exp(s - top) for s in scores]
    return [x / reduce(add, e) for x in e]


def _ensemble(trees: list, rate: float, score: str) -> GBTRegressionModel:
    """Spark's model of a weighted sum of fitted trees."""
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    java = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = sc._gateway.new_array(sc._jvm.double, len(trees))
    for i, t in enumerate(trees):
        java[i], weights[i] = t._java_obj, rate
    model = sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"boost_{uuid.uuid4().hex[:12]}", java, weights)
    out = GBTRegressionModel(model)
    out._resetUid(model.uid())
    return out.setFeaturesCol("features").setPredictionCol(score)


def fit(train: DataFrame, assembler, classes: int, rounds: int = 30, depth: int = 4, rate: float = 0.3, seed: int = 42,
        label: str = "label", weight: str = "weight") -> PipelineModel:
    """Model of ``label`` (0 .. classes - 1) on the assembler's features. Rows
    without a label are left out; a null weight is 1."""
    checkpoint_dir(train.sparkSession)
    rows = assembler.transform(train).where(F.col(label).isNotNull()).select(
        "features", F.col(label).cast("int").alias("_y"), F.coalesce(F.col(weight), F.lit(1.0)).alias("_w"))
    shares = {r[0]: r[1] for r in rows.groupBy("_y").agg(F.sum("_w")).collect()}  # one row per class
    if not shares:
        raise ValueError("no labelled rows")
    total = sum(shares.values())
    floor = 1e-9 * total
    start = [float(max(shares.get(k, 0.0), floor) / total) for k in range(classes)]
    known = [k for k in range(classes) if k in shares]  # a class without rows keeps its start
    scores = [F.col(f"_f{k}") for k in range(classes)]
    rows = rows.withColumns({f"_f{k}": F.log(F.lit(s)) for k, s in enumerate(start)}).checkpoint(eager=True)
    trees: list[list] = [[] for _ in range(classes)]
    for r in range(rounds if len(known) > 1 else 0):
        p = softmax(scores)
        now = rows.withColumns({f"_p{k}": p[k] for k in known})

        def fit_class(k):
            h = F.greatest(2 * F.col(f"_p{k}") * (1 - F.col(f"_p{k}")), F.lit(LEAST))
            z = ((F.col("_y") == k).cast("double") - F.col(f"_p{k}")) / h
            target = now.select("features", z.alias("_z"), (F.col("_w") * h).alias("_wh"))
            return DecisionTreeRegressor(labelCol="_z", weightCol="_wh", featuresCol="features", maxDepth=depth, seed=seed + r,
                                         predictionCol=f"_t{k}").fit(target)
        with ThreadPool(len(known)) as pool:
            step = dict(zip(known, pool.map(inheritable_thread_target(train.sparkSession)(fit_class), known)))
        for k, tree in step.items():
            trees[k].append(tree)
            rows = tree.transform(rows)
        rows = rows.withColumns({f"_f{k}": F.col(f"_f{k}") + rate * F.col(f"_t{k}") for k in step}).drop(
            *[f"_t{k}" for k in step]).checkpoint(eager=True)
    ensembles = [_ensemble(trees[k], rate, f"_s{k}") for k in range(classes) if trees[k]]
    return PipelineModel([assembler, *ensembles, _probabilities(start, [k for k in range(classes) if trees[k]])])


def _probabilities(start: list[float], boosted: list[int]) -> SQLTransformer:
    """``probability`` (array, by class) and ``prediction`` from the score columns."""
    s = [f"(ln({p!r}D){f' + _s{k}' if k in boosted else ''})" for k, p in enumerate(start)]
    top = f"greatest({', '.join(s)})"
    e = [f"exp({x} - {top})" for x in s]
    probs = f"transform(array({', '.join(e)}), x -> x / ({' + '.join(e)}))"
    return SQLTransformer(statement=f"SELECT *, {probs} AS probability, CAST(array_position({probs}, array_max({probs})) - 1 AS DOUBLE) "
                                    "AS prediction FROM __THIS__")


def log_loss(predicted: DataFrame, probability: Column, label: str = "label") -> float:
    """Mean -ln p of the true class."""
    p = F.get(probability, F.col(label).cast("int"))
    return predicted.agg(F.avg(-F.log(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(1e-15))))).first()[0]
