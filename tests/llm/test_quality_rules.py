import re

import pyspark.sql.functions as F

from tests.llm.helpers import simple, words
from tokenflow.llm import quality_rules as Q

SF = "/root/testdata/sf0.01"


def counts(text):
    w = words(text)
    t = text or ""
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")]
    win = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    twice = {x for x in win if win.count(x) > 1} if len(win) < 3000 else None
    if twice is None:
        seen = {}
        for x in win:
            seen[x] = seen.get(x, 0) + 1
        twice = {x for x, n in seen.items() if n > 1}
    covered = {i for k, x in enumerate(win) if x in twice for i in (k, k + 1, k + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \t\n", "one", "a b c a b c", "x " * 4000, "á b\x0bc\r\nd", "l1\nl1\n\n\nl1\nl2", "#*$ %&|<> w" * 9,
         " ".join(f"w{i % 40}" for i in range(200)), " ".join(f"w{i}" for i in range(30000)) + " a b c a b c"]


def test_counts_equal_brute_force_on_edge_texts(spark):
    d = simple(spark, list(enumerate(TEXTS)) + [(None, "a b"), (3, "one")])
    got = Q.judge(d).select("doc_id", "text", "quality.*").collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        e = counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e, (r.doc_id, e)
        assert r.base_failed == (e[0] < 50 or 100 * e[4] > 50 * e[0])
        assert not (r.base_failed and r.kept)


def test_query_equals_brute_force_and_agrees_with_labels(spark):
    out = {r.doc_id: r for r in Q.query(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(rows)
    for r in rows:
        o = out[r.doc_id]
        assert (o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words) == counts(r.text)
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    seen = [(x.quality, out[x.doc_id].kept) for x in labels if not out[x.doc_id].base_failed]
    clean = [kept for q, kept in seen if q == 1]
    junk = [kept for q, kept in seen if q == 0]
    assert sum(clean) >= 0.98 * len(clean)  # clean documents stay
    assert sum(junk) <= 0.1 * len(junk)


def test_rule_accuracies_come_from_the_table(spark):
    """A rule that fires on half of all texts says nothing and is outvoted."""
    v = [[0, 2, 2, 2, 2, 2, 2]] * 500 + [[2] * 7] * 500
    p = {tuple(r._v): r.p_good for r in Q.posteriors(spark.createDataFrame([(x,) for x in v], "_v array<int>")).collect()}
    rare = [[0, 2, 2, 2, 2, 2, 2]] * 20 + [[2] * 7] * 980
    q = {tuple(r._v): r.p_good for r in Q.posteriors(spark.createDataFrame([(x,) for x in rare], "_v array<int>")).collect()}
    assert p[(0, 2, 2, 2, 2, 2, 2)] > q[(0, 2, 2, 2, 2, 2, 2)]
    assert q[(0, 2, 2, 2, 2, 2, 2)] < 0.5 < q[(2,) * 7]


def test_empty_table_and_clashing_columns(spark):
    d = simple(spark, [(1, "a b c")])
    assert Q.judge(d.limit(0)).count() == 0 and Q.keep(d.limit(0)).count() == 0
    clash = d.withColumn("_v", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("quality", F.lit(2)).withColumn("_row", F.lit(0))
    out = Q.judge(clash)
    assert out.columns.count("quality") == 1 and out.first().n_words == "x" and out.first().quality.n_words == 3
    assert Q.keep(clash).columns == clash.columns


def test_no_python_on_the_main_path(spark):
    plan = Q.text_counts(simple(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
