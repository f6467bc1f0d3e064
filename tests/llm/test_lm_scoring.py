import collections
import math
import zlib

import numpy as np
import pyspark.sql.functions as F

from tests.llm.helpers import UPPER, docs, words
from tokenflow.llm import ctw, lm_scoring as S

SF = "/root/testdata/sf0.01"


def kt(n0, n1):
    p = 1.0
    for k in range(n0):
        p *= (k + 0.5) / (k + 1)
    for k in range(n1):
        p *= (k + 0.5) / (n0 + k + 1)
    return p


def plain_ctw(train, depth):
    """log10 p(next | context) by the textbook recursion, node by node."""
    n = collections.Counter()
    for text in train:
        data = bytes(depth) + text + b"\0"
        for i in range(depth, len(data)):
            bits = f"{data[i]:08b}"
            for d in range(depth + 1):
                for k in range(8):
                    n[(data[i - d:i], bits[:k], bits[k])] += 1
    children = collections.defaultdict(set)
    for c, b, _ in n:
        if c:
            children[(c[1:], b)].add(c)
    memo = {}

    def pw(c, b):
        if (c, b) not in memo:
            e = kt(n[(c, b, "0")], n[(c, b, "1")])
            memo[(c, b)] = e if len(c) == depth else 0.5 * e + 0.5 * math.prod(pw(x, b) for x in children[(c, b)])
        return memo[(c, b)]

    def one(context, b):
        p = None
        for d in range(depth, -1, -1):
            c = context[len(context) - d:]
            n0, n1 = n[(c, b, "0")], n[(c, b, "1")]
            if not n0 + n1:
                continue
            q = (n1 + 0.5) / (n0 + n1 + 1)
            w = 0.5 * kt(n0, n1) / pw(c, b)
            p = q if p is None else w * q + (1 - w) * p
        return 0.5 if p is None else p

    def log10(context, byte):
        bits = f"{byte:08b}"
        return sum(math.log10(one(context, bits[:k]) if bits[k] == "1" else 1 - one(context, bits[:k])) for k in range(8))

    return log10


def test_weighting_equals_the_textbook_recursion(spark):
    texts = ["abab ba", "abba", "", "cab ab", "zz é"]
    d = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    train = F.col("doc_id") != 4
    got = {r.doc_id: r.score for r in S.score(d, "text", "doc_id", train, depth=3).collect()}
    p = plain_ctw([t.encode() for t in texts[:4]], 3)
    for i, t in enumerate(texts):
        data = bytes(3) + t.encode() + b"\0"
        want = sum(p(data[k - 3:k], data[k]) for k in range(3, len(data)))
        assert abs(got[i] - want) < 1e-5, (t, got[i], want)


def test_next_byte_probabilities_sum_to_one():
    data = np.frombuffer(b"\0\0the cat the dog\0", dtype=np.uint8)
    g, n = np.unique(ctw.grams_of(data, 2), return_counts=True)
    context = g[3] >> np.uint64(8) << np.uint64(8)
    full = np.union1d(g, context + np.arange(256, dtype=np.uint64))
    counts = np.zeros(len(full))
    counts[np.searchsorted(full, g)] = n
    roots, ones = ctw.subtree(full, counts, 2, 0, True)
    p = ctw.Top(roots, 0).log10(full, ones, 2)
    at = np.searchsorted(full, context + np.arange(256, dtype=np.uint64))
    assert abs((10 ** p[at]).sum() - 1) < 1e-9


def test_base_on_the_whole_table_and_model_beats_a_shallow_one(spark):
    rows = [(r.doc_id, (r.text or "").translate(UPPER)) for r in
            spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = collections.Counter()
    for i, t in rows:
        if not held[i]:
            c.update(words(t))
            c["\n"] += 1
    n, v = sum(c.values()), len(c)
    out = {r.doc_id: r for r in S.query(spark, SF).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        w = [*words(t), "\n"]
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
    size = {i: len(t.encode()) + 1 for i, t in rows}
    bits = lambda k: -sum(out[i].score for i in out if held[i] == k) / math.log10(2) / sum(size[i] for i in out if held[i] == k)
    assert bits(False) < bits(True) < 3.2


def test_dictionary_and_broadcast_ways_agree(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = (S.score(d, "text", "doc_id", ~S.held_out(F.col("doc_id")), **kw).orderBy("doc_id").collect()
            for kw in ({}, {"broadcast_grams": 0, "block": 50_000}))
    assert [r.doc_id for r in a] == [r.doc_id for r in b]
    assert all(abs(x.score - y.score) < 1e-9 and abs(x.base_score - y.base_score) < 1e-9 for x, y in zip(a, b))


def test_edge_rows(spark):
    d = docs(spark, [(1, None, "en", "s"), (2, "", "en", "s"), (3, " \t", "en", "s"), (3, " \t", "en", "s"),
                     (None, "A a", None, None), (5, "long " * 100_000, "en", "s")]).withColumn("block", F.lit(1)).withColumn("key", F.lit(2))
    out = S.score(d, "text", "doc_id", F.lit(True)).collect()
    got = {r.doc_id: (r.n_tokens, r.n_known) for r in out}
    assert len(out) == 6 and got == {1: (1, 1), 2: (1, 1), 3: (1, 1), None: (3, 3), 5: (100_001, 100_001)}
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out)
    assert S.score(d.limit(0), "text", "doc_id", F.lit(True)).count() == 0
    none = S.score(d, "text", "doc_id", F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known) for r in none} == {(0, 0)}
    assert abs(next(r.score for r in none if r.doc_id == 2) - 8 * math.log10(0.5)) < 1e-6
