import random

import pyspark.sql.functions as F
import pytest

from tests.llm.helpers import UPPER, components, docs, simple, words
from tokenflow.llm import jaccard_join as J


def shingles(text):
    w = words((text or "").translate(UPPER))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    s = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(s) for b, y in s[:k]
             if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    c = components({i for i, _ in s}, links)
    return sorted((i, len(x), c[i]) for i, x in s)


def variants(r, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed,short,tile", [(0, 64, 4096), (1, 4, 4096), (2, 2, 8)])
def test_groups_equal_brute_force(spark, seed, short, tile):
    """Near copies around the threshold, long lists and small tiles."""
    r = random.Random(seed)
    texts = []
    for g in range(6):
        base = [f"w{r.randrange(300)}" for _ in range(r.choice([8, 40, 120]))]
        texts += variants(r, base, r.randint(2, 30), 4)
    passage = [f"hot{k}" for k in range(30)]
    texts += [" ".join(passage + [f"u{r.randrange(10 ** 6)}" for _ in range(r.randint(0, 40))]) for _ in range(30)]
    texts += ["Short Text", "short text", "a b c d e", "A B c d e", "", None, "  "]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    got = J.near_duplicates(simple(spark, rows), short=short, tile=tile, hot=50 if seed else J.HOT).collect()
    assert sorted((x.doc, x.n_shingles, x.component) for x in got) == brute(rows)


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in J.query(spark, sf).collect())
    assert got == brute(rows)


def test_edge_rows_and_keep_one(spark):
    long = " ".join(f"w{k % 700}x{k % 11}" for k in range(50_000))
    d = docs(spark, [(7, long, "en", "a"), (5, long, "en", "b"), (None, "solo text that nobody else has here", None, None),
                     (9, "a b c d e f", "en", "a"), (9, "q r s t u v", "en", "a"), (8, "Q R S T U V", "en", "a"),
                     (6, "a b c d e f", "en", "a"), (1, None, "en", "a"), (2, "", "en", "a")])
    got = sorted(((x.doc, x.component) for x in J.near_duplicates(d).collect()))
    assert got == [(J.NULL_ID, J.NULL_ID), (1, 1), (2, 2), (5, 5), (6, 6), (7, 5), (8, 6), (9, 6), (9, 6)]
    kept = J.keep_one(d.withColumn("doc", F.lit(1)).withColumn("component", F.lit(2)))
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == [1, 2, 5, 6]
    assert kept.columns == [*d.columns, "doc", "component"]
    assert J.near_duplicates(d.limit(0)).count() == 0


def test_threshold_is_inclusive(spark):
    a = " ".join(f"t{k}" for k in range(13))  # 9 shingles
    b = " ".join([f"t{k}" for k in range(12)] + ["z"])  # shares 8 of 10
    rows = [(1, a), (2, b)]
    assert brute(rows)[1][2] == 1
    assert {x.component for x in J.near_duplicates(simple(spark, rows)).collect()} == {1}


def test_keep_one_keeps_one_row_of_near_copies(spark):
    a, b, c, e = (" ".join(f"{x}{k}" for k in range(60)) for x in "abce")
    rows = [(None, a), (None, a), (None, a + " more"), (None, e), (5, b), (5, b), (5, c), (7, a), (8, "few"), (8, "few"), (9, None), (9, None)]
    kept = J.keep_one(simple(spark, rows)).collect()
    assert [r.doc_id for r in kept if r.text in (a, a + " more", e)] == [None, None]
    assert e in {r.text for r in kept}
    assert sorted((r.doc_id, r.text) for r in kept if r.text in (b, c)) == [(5, b), (5, c)]
    assert sorted(r.doc_id for r in kept if r.text in ("few", None)) == [8, 9, 9]
    assert kept[0].__fields__ == simple(spark, rows).columns
