import random

import pyspark.sql.functions as F
import pytest

from tests.llm.helpers import docs, simple, words
from tokenflow.llm import line_dedup as L


def brute(rows, least):
    """Union of all runs of at least ``least`` words with an earlier copy: each
    is a union of runs that are shortest from their start or from their end."""
    seen, out = {}, {}
    for doc, text in rows:
        lines = text.split("\n") if text else []
        n = [len(words(x)) for x in lines]
        blocks = set()
        for i in range(len(lines)):
            for step in (1, -1):
                j, total = i, 0
                while 0 <= j < len(lines):
                    total += n[j]
                    if total >= least:
                        blocks.add((min(i, j), max(i, j) + 1))
                        break
                    j += step
        gone = set()
        for i, j in sorted(blocks):
            if seen.setdefault(tuple(lines[i:j]), (doc, i)) != (doc, i):
                gone |= set(range(i, j))
        out[doc] = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_runs_equal_brute_force(spark, seed):
    r = random.Random(seed)
    lines = [f"l{k} " * r.randint(0, 3) for k in range(6)]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 14)))) for i in range(60)]
    got = {x.doc_id: x.text for x in L.dedup(simple(spark, rows), min_words=5).collect()}
    want = brute(rows, 5)
    assert got == want


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = {x.doc_id: x.text for x in L.query(spark, sf).collect()}
    assert got == brute(rows, L.MIN_WORDS)


def test_planted_passage_goes_from_later_documents_only(spark):
    passage = "\n".join(" ".join(f"p{k}w{j}" for j in range(20)) for k in range(4))
    rows = [(i, f"own {i} first\n{passage}\nown {i} last") for i in (5, 2, 9)]
    got = {x.doc_id: x for x in L.dedup(simple(spark, rows)).collect()}
    assert got[2].text == rows[1][1]
    assert got[5].text == "own 5 first\nown 5 last" and got[5].line_dedup.n_removed == 4


def test_edge_rows(spark):
    long = "\n".join(f"line {k} with some words in it" for k in range(3000))
    d = docs(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (None, long, "en", "a"), (3, long, "en", "a"),
                     (3, long, "en", "a"), (4, "\n\n", None, None), (6, "x\x0by", "en", "a")])
    out = L.dedup(d.withColumn("line_dedup", F.lit(1)).withColumn("doc", F.lit(2)))
    assert out.columns.count("line_dedup") == 1 and "doc" in out.columns
    got = [(x.doc_id, x.text) for x in out.collect()]
    assert sorted(got, key=repr) == sorted([(1, None), (2, ""), (None, long), (3, ""), (3, ""), (4, "\n\n"), (6, "x\x0by")], key=repr)
    assert L.dedup(d.limit(0)).count() == 0
