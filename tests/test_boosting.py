"""M9: multinomial boosting against a plain loop, one-vs-rest, and a saved copy."""

import math
import random
import threading

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tokenflow.operators import boosting as B


def rows(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = r.random(), r.random()
        y = 0 if a < 0.4 else (1 if b < 0.5 else 2)
        out.append((a, b, float(y if r.random() < 0.8 else r.randrange(3)), 1.0))
    return out


def reference(data, classes, rounds, rate):
    """Stumps on binary features, chosen by weighted squared error, as lists."""
    total = sum(w for *_, w in data)
    start = [math.log(sum(w for *_, y, w in data if y == k) / total) for k in range(classes)]
    f = [start[:] for _ in data]
    for _ in range(rounds):
        moves = []
        for k in range(classes):
            zs = []
            for (x, y, w), fi in zip(data, f):
                top = max(fi)
                p = math.exp(fi[k] - top) / sum(math.exp(v - top) for v in fi)
                h = max(2 * p * (1 - p), B.LEAST)
                zs.append((((y == k) - p) / h, w * h))
            best = None
            for j in range(len(data[0][0])):
                sides = [[(z, w) for (x, _, _), (z, w) in zip(data, zs) if x[j] == v] for v in (0.0, 1.0)]
                means = [sum(z * w for z, w in s) / sum(w for _, w in s) for s in sides]
                error = sum(w * (z - m) ** 2 for s, m in zip(sides, means) for z, w in s)
                if best is None or error < best[0] - 1e-12:
                    best = (error, j, means)
            moves.append(best)
        for i, (x, _, _) in enumerate(data):
            for k, (_, j, means) in enumerate(moves):
                f[i][k] += rate * means[int(x[j])]
    out = []
    for fi in f:
        e = [math.exp(v - max(fi)) for v in fi]
        out.append([v / sum(e) for v in e])
    return out


def test_equals_a_plain_loop(spark):
    r = random.Random(4)
    data = []
    for _ in range(120):
        x = (float(r.random() < 0.5), float(r.random() < 0.3), float(r.random() < 0.7))
        y = 0 if x[0] and r.random() < 0.9 else 1 if x[1] else 2 if r.random() < 0.8 else 1
        data.append((x, y, 1.0 + y))
    df = spark.createDataFrame([(i, *x, float(y), w) for i, (x, y, w) in enumerate(data)], "i int, a double, b double, c double, label double, weight double")
    m = B.fit(df, VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), 3, rounds=3, depth=1, rate=0.5)
    got = [r.probability for r in m.transform(df).orderBy("i").collect()]
    for g, want in zip(got, reference(data, 3, 3, 0.5)):
        assert all(abs(a - b) < 1e-9 for a, b in zip(g, want))


def test_beats_one_vs_rest_and_survives_saving(spark, tmp_path):
    cols = "a double, b double, label double, weight double"
    train, test = spark.createDataFrame(rows(600, 1), cols).coalesce(2), spark.createDataFrame(rows(500, 2), cols).coalesce(2)
    va = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    m = B.fit(train, va, 3, rounds=8, depth=2)
    out = m.transform(test)
    assert out.where(F.abs(F.aggregate("probability", F.lit(0.0), lambda s, x: s + x) - 1) > 1e-9).count() == 0
    assert out.where(F.col("prediction") != F.array_position("probability", F.array_max("probability")) - 1).count() == 0
    ovr = OneVsRest(classifier=GBTClassifier(maxDepth=2, maxIter=8, stepSize=0.3, seed=1), weightCol="weight").fit(va.transform(train))
    scored, parts = va.transform(test), []
    for k, binary in enumerate(ovr.models):
        scored = binary.setPredictionCol(f"p{k}").setRawPredictionCol(f"r{k}").setProbabilityCol(f"q{k}").transform(scored)
        parts.append(vector_to_array(f"q{k}")[1])
    total = parts[0] + parts[1] + parts[2]
    ovr_loss = B.log_loss(scored.withColumn("pr", F.array(*[p / total for p in parts])), F.col("pr"))
    assert B.log_loss(out, F.col("probability")) < ovr_loss < math.log(3)
    m.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m").transform(test)
    key = ["a", "b"]
    assert sorted(map(str, again.select(*key, "probability").collect())) == sorted(map(str, out.select(*key, "probability").collect()))


def test_missing_classes_and_weights(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (0.0, 2.0, 3.0), (1.0, None, 1.0)], "a double, label double, weight double")
    m = B.fit(df, VectorAssembler(inputCols=["a"], outputCol="features"), 4, rounds=2, depth=1)
    r = m.transform(df).first()
    assert r.prediction == 2.0 and r.probability[2] > 0.999 and abs(sum(r.probability) - 1) < 1e-9


def test_classes_of_a_round_are_fitted_at_the_same_time(spark, monkeypatch):
    """Every fit waits for the other two: one after the other they would never start."""
    together, one = threading.Barrier(3, timeout=60), B.DecisionTreeRegressor.fit
    monkeypatch.setattr(B.DecisionTreeRegressor, "fit", lambda self, df: together.wait() is not None and one(self, df))
    df = spark.createDataFrame([(1.0, 0.0, 1.0), (0.0, 1.0, 1.0), (2.0, 2.0, 1.0)], "a double, label double, weight double")
    m = B.fit(df, VectorAssembler(inputCols=["a"], outputCol="features"), 3, rounds=1, depth=2)
    assert [r.prediction for r in m.transform(df).collect()] == [0.0, 1.0, 2.0]
