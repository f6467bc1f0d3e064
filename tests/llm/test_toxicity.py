import random
import re
import zlib

import numpy as np
import pyspark.sql.functions as F

from tests.llm.helpers import docs
from tokenflow.llm import toxicity as X

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def brute_terms(spark, text):
    """Hash of every distinct word and stem, one word at a time."""
    words = {w for w in re.split(r"[\W_]+", (text or "").lower()) if w}
    spec = [("w", w) for w in words] + [(n, w[:n]) for n in X.STEMS for w in words if len(w) > n]
    if not spec:
        return set()
    df = spark.createDataFrame([(None if n == "w" else n, w) for n, w in spec], "n int, w string")
    return {r[0] for r in df.select(F.when(F.isnull("n"), F.xxhash64("w")).otherwise(F.xxhash64("n", "w"))).collect()}


def brute_score(machine, found):
    at = [i for i, k in enumerate(machine.keys.tolist()) if k in found]
    z = machine.bias + sum(machine.weight[i] for i in at)
    for a, i in enumerate(at):
        for j in at[a + 1:]:
            z += float(machine.factor[i] @ machine.factor[j])
    return 1 / (1 + np.exp(-z))


def test_terms_equal_brute_force(spark):
    texts = ["You IDIOT, you idiot! Über-größe x_y 1234567", "", None, "...", "aaaaaa aaaaab", "é\n\té"]
    got = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).select("doc_id", X.terms(F.col("text"))).collect()
    for i, found in got:
        assert len(found) == len(set(found)) and set(found) == brute_terms(spark, texts[i])


def test_scores_equal_all_pairs_on_the_given_table(spark):
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = X.learn(X.training_rows(sample, labels), epochs=3)
    assert len(m.keys) and np.abs(m.factor).sum() > 0
    got = X.score(sample, m).select("doc_id", "toxicity", X.terms(F.col("text")).alias("t")).collect()
    assert len(got) == sample.count()
    assert all(abs(r.toxicity - brute_score(m, set(r.t))) < 1e-9 for r in got)


def interaction(n, seed):
    """Insults at things and neutral words on a group are clean, both together are not."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{r.randrange(400)}" for _ in range(r.randrange(20, 60))]
        insult, group = r.random() < 0.45, r.random() < 0.45
        words += ["vermin"] * insult + ["strangers"] * group
        r.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_pairs_that_a_linear_model_misses():
    def arrays(rows):
        sets = [sorted({hash(("t", w)) for w in t.split()}) for _, t, _ in rows]
        return np.array([x for s in sets for x in s], np.int64), np.array([len(s) for s in sets]), np.array([float(y) for *_, y in rows])

    found, sizes, y = arrays(interaction(1500, 1))
    test = arrays(interaction(600, 2))

    def loss(m):
        p = m.scores(test[0], np.repeat(np.arange(600), test[1]), 600)
        return -np.log(np.where(test[2] == 1, p, 1 - p)).mean(), ((p >= 0.5) == (test[2] == 1)).mean()

    machine, additive = X.fit(found, sizes, y), X.fit(found, sizes, y, factors=1, epochs=0)
    linear = X.fit(found, sizes, y)._replace(factor=np.zeros_like(machine.factor))
    at = [int(np.flatnonzero(machine.keys == hash(("t", w)))[0]) for w in ("vermin", "strangers")]
    assert machine.factor[at[0]] @ machine.factor[at[1]] > 0.5  # the pair itself counts
    assert loss(machine)[1] == 1 and loss(machine)[0] < 0.5 * loss(linear)[0] and loss(additive)[1] < 1


def test_held_out_accuracy_and_contract(spark):
    out = {r.doc_id: r for r in X.query(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
               for i, r in out.items())
    held = [(labels[i], r.predicted) for i, r in out.items() if r.held_out and i in labels]
    toxic = [p for y, p in held if y]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(p for y, p in held if not y) <= 0.005 * len(held)


def test_labels_of_held_out_rows_are_not_read(spark, tmp_path):
    rows = [(i, f"word{i % 7} " + ("idiot" if i % 3 == 0 else "fine"), "en", "s") for i in range(300)]
    for at, flip in (("a", 0), ("b", 1)):
        docs(spark, rows).write.parquet(f"{tmp_path}/{at}/documents.parquet")
        held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(300)]
        labels = [(i, 1, (i % 3 == 0) ^ (flip & held[i])) for i in range(300)]
        spark.createDataFrame([(i, q, int(t)) for i, q, t in labels], LABELS).write.parquet(f"{tmp_path}/{at}/labels.parquet")
    a, b = ({r.doc_id: r.score for r in X.query(spark, f"{tmp_path}/{at}").collect()} for at in "ab")
    assert a == b and a[0] > 0.9 and a[1] < 0.1


def test_edge_rows(spark):
    long = "calm " * 300_000 + "idiot"
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "...", "en", "s"), (None, "idiot", "en", "s"), (None, "idiot", "en", "s"),
            (4, "calm", "en", "s"), (5, long, "en", "s"), (6, "idiot", "en", "s"), (6, "calm", "en", "s")]
    train = [(100 + i, "you idiot" if i % 2 else "calm day", "en", "s") for i in range(60)]
    labels = spark.createDataFrame([(100 + i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (4, 1, None), (101, 0, 1), (7, 1, 5)], LABELS)
    known = docs(spark, train + rows)
    m = X.learn(X.training_rows(known, labels), least=3.0)
    data = known.selectExpr("*", "1 AS toxicity", "2 AS label", "3 AS terms", "4 AS key", "5 AS of")
    got = {(r.doc_id, r.text): r for r in X.score(data, m).collect()}
    assert X.score(data, m).columns == data.columns and X.score(data, m).count() == 69
    assert X.learn(X.training_rows(data, labels.selectExpr('*', '0 AS label', '1 AS of')), least=3.0).bias == m.bias
    rest = got[(1, None)].toxicity
    assert rest == got[(2, "")].toxicity == got[(3, "...")].toxicity and abs(rest - X.logistic(np.array(m.bias))) < 1e-12
    assert got[(6, "idiot")].toxicity > 0.7 > 0.3 > got[(4, "calm")].toxicity
    assert got[(None, "idiot")].toxicity == got[(6, "idiot")].toxicity and got[(5, long)].label == 2
    nothing = X.learn(X.training_rows(known, labels.where("false")))
    assert X.score(known, nothing).agg(F.max("toxicity")).first()[0] < 1e-9
    assert X.score(known.where("false"), m).count() == 0
    one = X.learn(X.training_rows(known, labels.where("toxic = 1")))
    assert X.score(known, one).agg(F.min("toxicity")).first()[0] > 0.5


def test_sample_bounds_take_whole_documents(spark):
    rows = [(i, f"a{i} b{i} c{i}", "en", "s") for i in range(40)] + [(1, f"x{i} y z", "en", "s") for i in range(100)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], LABELS)
    picked = X.training_rows(docs(spark, rows), labels, limit=30).collect()
    assert len(picked) == 30
    picked = X.training_rows(docs(spark, rows), labels, most_terms=20).collect()
    assert sum(len(r.terms) for r in picked) <= 20 and all(len(r.terms) == 3 for r in picked) and len(picked) == 6
