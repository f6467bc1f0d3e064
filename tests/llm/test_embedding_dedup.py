import math

import numpy as np
import pyspark.sql.functions as F

from tests.llm.helpers import components
from tokenflow.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows
          if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)]
    n, links = {i: 0 for i, _ in rows}, []
    for k, (a, x) in enumerate(ok):
        for b, y in ok[:k]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    c = components(n, links)
    return {i: (n[i], c[i]) for i, _ in rows}


def cloud(r, center, n, spread):
    out = center + spread * r.normal(size=(n, len(center)))
    return out.astype(np.float32).tolist()


def test_recall_on_pairs_around_the_threshold(spark):
    r = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        c = r.normal(size=64)
        rows += cloud(r, c, 4, 0.15)  # cosines around 0.95 to 0.98
    rows += cloud(r, np.zeros(64), 400, 1.0)
    rows = list(enumerate(rows))
    got = {x.vec_id: x for x in E.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()}
    want = brute(rows)
    found, there = sum(x.n_links for x in got.values()), sum(n for n, _ in want.values())
    assert there > 200 and 0.9 * there <= found <= there
    assert all(got[i].n_links <= want[i][0] for i in got)


def test_crowds_copies_and_mixed_balls(spark):
    """Groups far above the crowd size, of several radii, and exact copies."""
    r = np.random.default_rng(9)
    c = r.normal(size=32)
    rows = cloud(r, c, 150, 0.01) + cloud(r, c, 80, 0.16) + cloud(r, r.normal(size=32), 100, 0.001)
    rows += [rows[0]] * 120 + [[1.0] * 32] * 3
    rows = list(enumerate(rows))
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in E.near_duplicates(
        spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), crowd=16).collect()}
    want = brute(rows)
    there, found = sum(n for n, _ in want.values()), sum(x[0] for x in got.values())
    assert 0.95 * there <= found <= there
    assert all(got[i][0] <= want[i][0] for i in got)
    assert all(got[i][1] == c and got[i][2] == (c == i) for i, (n, c) in want.items() if i < 150 or i >= 230)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]),
            (8, [2.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e30, 1e-30]), (12, [-1.0, 0.0])]
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("node", F.lit(1)).withColumn("id", F.lit(2))
    got = {x.vec_id: (x.n_links, x.component_id) for x in E.near_duplicates(d).collect()}
    assert got == brute(rows)
    assert E.near_duplicates(d.limit(0)).count() == 0
    bad = E.near_duplicates(d.where("vec_id <= 3")).collect()
    assert [(x.n_links, x.kept) for x in bad] == [(0, True)] * 3


def test_codes_are_balanced():
    x = np.random.default_rng(1).normal(size=(4000, 20)) + 3
    mean, projections = E.itq(x, bits=16)
    share = ((x - mean) @ projections[0] >= 0).mean(axis=0)
    assert np.all(abs(share - 0.5) < 0.05)
    assert np.allclose(projections[0].T @ projections[0], np.eye(16), atol=1e-8)
