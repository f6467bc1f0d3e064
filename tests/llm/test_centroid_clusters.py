import hashlib
import math

import numpy as np

from tokenflow.llm import centroid_clusters as C, column_blocks as B

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, width, scale=64):
    """Lists and Python integers only; (vec_id, cluster, distance) rows and centroids."""
    ok = [(i, [int(x) * scale if abs(x) > 2 ** 53 else math.floor(scale * x) for x in v], v) for i, v in rows  # exactly
          if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(ok, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    cents = [r[1] for r in first[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        groups = {}
        for _, v, _ in ok:
            groups.setdefault(nearest(v)[0], []).append(v)
        for j, g in groups.items():
            cents[j] = [sum(x) // len(g) for x in zip(*g)]
    return [(i, *nearest(v)) for i, v, _ in ok], cents


def key(r):
    return (r[0] is None, r)


def same(spark, rows, **args):
    data = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA.replace("float", args.pop("kind", "float")))
    found = C.cluster(data.repartition(3), **args)
    got = sorted(((r.id, r.cluster, r.distance) for r in found.rows.collect()), key=key)
    want, cents = brute(rows, args.get("k", 16), args.get("rounds", 3), args.get("width", 64))
    top = [(i, c, min(d, B.LONG_MAX)) for i, c, d in want]
    assert got == sorted(top, key=key)
    assert found.centroids.tolist() == cents
    return got


def test_equals_brute_force_with_uneven_blocks(spark):
    r = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(r.normal(size=(300, 10)).astype(np.float32).tolist())]
    same(spark, rows, width=10, block=4, k=7, rounds=4)
    same(spark, rows, width=10, block=1, k=3, rounds=2)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.1, -0.1, 0.5]
    rows = [(1, v), (1, v), (1, [0.2, 0.1, 0.0]), (None, v), (None, [3.0, -2.0, 1.0]), (2, None), (3, [nan, 0.0, 0.0]),
            (4, [0.0, inf, 0.0]), (5, [0.0, None, 0.0]), (6, [1.0]), (7, []), (8, [0.0, 0.0, 0.0]), (9, [-1 / 64, 1 / 64, 0.0])]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = same(spark, rows, width=3, block=2, k=16)
    assert [r[0] for r in got] == [1, 1, 1, 8, 9, None, None]


def test_ties_and_empty_clusters(spark):
    """Equal starts: the smaller number wins and the others stay as they were."""
    rows = [(i, [1.0, 1.0]) for i in range(40)] + [(100, [1.0, 1.0])]
    got = same(spark, rows, width=2, k=5)
    assert {r[1] for r in got} == {0}


def test_numbers_beyond_a_long(spark):
    rows = [(i, [float(10 ** (3 * i)), -float(2 ** (5 * i)), 1e300 if i == 9 else 0.25, 1.7e308 if i == 8 else 0.0]) for i in range(10)]
    got = same(spark, rows, width=4, block=3, k=3, rounds=2, kind="double")
    assert max(r[2] for r in got) == B.LONG_MAX


def test_empty_table_and_clashing_columns(spark):
    assert C.cluster(spark.createDataFrame([], SCHEMA)).rows.count() == 0
    rows = [(i, [float(i)] * 2, "x") for i in range(5)]
    clash = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string").selectExpr(
        "*", "0 AS distance", "1 AS chunk", "2 AS row", "3 AS id")
    assert [r.id for r in C.cluster(clash, width=2, k=2).rows.orderBy("id").collect()] == list(range(5))


def test_query_columns(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(r.normal(size=(60, 64)).astype(np.float32).tolist())] + [(99, None)]
    spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x.vec_id: x for x in C.query(spark, str(tmp_path)).collect()}
    want, cents = brute(rows, 16, 3, 64)
    for i, c, d in want:
        assert (got[i].cluster, got[i].distance) == (c, d)
        assert got[i].cluster_inertia == sum(x for _, k, x in want if k == c)
        assert got[i].inertia == sum(x for _, _, x in want)
        assert got[i].centroid_sha256 == hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()
    assert len(got) == 60
