import hashlib
import math

import numpy as np
import pytest

from tokenflow.llm import column_blocks as B, vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, codes, error) rows and codebooks, with lists and Python integers."""
    ok = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = -(-max((len(v) for _, v in ok), default=0) // parts)
    cut = []
    for i, v in ok:
        # a power of two times a double, exactly
        full = [math.floor(x) * scale if abs(x) > 2 ** 53 else math.floor(scale * x) for x in v] + [0] * (parts * w - len(v))
        cut.append((i, [full[p * w:(p + 1) * w] for p in range(parts)]))
    order = sorted(range(len(ok)), key=lambda r: (ok[r][0] is None, ok[r][0] or 0, ok[r][1]))
    books = [[cut[r][1][p] for r in order[:entries]] for p in range(parts)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, x in cut:
                groups.setdefault(nearest(x[p], books[p])[0], []).append(x[p])
            for j, g in groups.items():
                books[p][j] = [sum(c) // len(g) for c in zip(*g)]
    out = []
    for i, x in cut:
        best = [nearest(x[p], books[p]) for p in range(parts)]
        out.append((i, [c for c, _ in best], min(sum(d for _, d in best), B.LONG_MAX)))
    return out, books


def key(r):
    return (r[0] is None, r)


def same(spark, rows, **args):
    found = V.compress(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3), **args)
    got = sorted(((r.id, list(r.codes), r.error) for r in found.rows.collect()), key=key)
    want, books = brute(rows, **args)
    assert got == sorted(want, key=key)
    assert found.books.tolist() == books
    return got, found.books


@pytest.mark.parametrize("width,spread", [(8, 3000), (5, 40), (1, 3), (16, 10**6), (3, 10**9), (4, 10**14)])
def test_search_equals_direct_distances(width, spread):
    """Also where int64 is too small, and on many ties (small spread)."""
    r = np.random.default_rng(width)
    x, book = r.integers(-spread, spread + 1, (400, width)), r.integers(-spread, spread + 1, (13, width))
    index, d, _ = V.encode(x, book)
    full = ((x.astype(object)[:, None] - book.astype(object)[None]) ** 2).sum(axis=2)
    assert index.tolist() == [min(range(13), key=lambda j: (f[j], j)) for f in full]
    assert d.tolist() == full.min(axis=1).tolist()


def test_entries_are_dropped_early():
    r = np.random.default_rng(1)
    book = np.cumsum(r.integers(-9, 9, (16, 32)), axis=1) * 50  # neighbouring components go together
    x = book[r.integers(0, 16, 3000)] + r.integers(-20, 20, (3000, 32))
    assert V.encode(x, book)[2] < 0.3 * x.size * 16


def test_matrix_is_orthogonal_in_sequency_order():
    h = V.walsh(16)
    assert (h @ h.T == 16 * np.eye(16)).all()
    assert [int((row[1:] != row[:-1]).sum()) for row in h] == list(range(16))
    assert V.walsh(5).shape == (8, 5)


def test_equals_brute_force_and_decodes(spark):
    r = np.random.default_rng(2)
    rows = list(enumerate(r.normal(size=(150, 24)).tolist()))
    got, books = same(spark, rows)
    ints = B.floors(np.array([v for _, v in rows]), V.SCALE)
    back = V.decode(np.array([c for _, c, _ in got]), books)
    assert ((ints - back) ** 2).sum(axis=1).tolist() == [e for _, _, e in got]
    same(spark, rows, parts=5, entries=4, rounds=2)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 8), (1, [0.5] * 8), (1, [0.25] * 9), (None, [1.0] * 3), (None, []), (3, None), (4, [nan]), (5, [inf, 1.0]),
            (6, [None, 1.0]), (7, [-1e-9] * 8), (8, [1e200, -1e18, 3.5] + [0.0] * 5)]
    got, _ = same(spark, rows)
    assert [g[0] for g in got] == [1, 1, 1, 7, 8, None, None]
    same(spark, [(1, []), (2, [])])


def test_empty_table_clashing_columns_and_nulls_in_label(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert V.compress(empty, keep=("label",)).rows.count() == 0
    clash = spark.createDataFrame([(i, [float(i)] * 8, i % 2, "x") for i in range(6)], SCHEMA + ", code string").selectExpr(
        "*", "0 AS id", "1 AS error", "2 AS codes")
    kept = V.compress(clash, keep=("label", "code", "id", "error")).rows.orderBy("id").collect()
    assert [(r.id, r.kept.label, r.kept.code, r.kept.id) for r in kept] == [(i, i % 2, "x", 0) for i in range(6)]
    r = np.random.default_rng(6)
    rows = [(i, v, [None, 0, 1][i % 3]) for i, v in enumerate(r.normal(size=(90, 16)).tolist())]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = V.query(spark, str(tmp_path)).collect()
    want, books = brute([r[:2] for r in rows])
    error = {i: e for i, _, e in want}
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    for x in got:
        assert x.code == "".join(f"{c:02x}" for c in want[x.vec_id][1]) and x.error == error[x.vec_id]
        assert x.label_error == sum(e for i, e in error.items() if i % 3 == x.vec_id % 3)
        assert x.codebooks_sha256 == digest
    assert len(got) == 90
