import random
import zlib

import pyspark.sql.functions as F

from tests.llm.helpers import docs
from tokenflow.llm import language_id as L

SF = "/root/testdata/sf0.01"


def parse(text, sample):
    """Phrases per symbol by trying every length."""
    s, t = ("".join(map(chr, L.symbols(x))) for x in (text, sample))
    n = 0
    for at in range(0, len(s), L.LANE):
        x, i = s[at:at + L.LANE], 0
        while i < len(x):
            j = i + 1
            while j <= len(x) and x[i:j] in t:
                j += 1
            i, n = max(j - 1, i + 1), n + 1
    return n / len(s)


def test_phrases_equal_brute_force():
    r = random.Random(3)
    samples = (("a", "".join(r.choice("abc d") for _ in range(300))), ("b", "".join(r.choice("bcde é") for _ in range(300))))
    model = L.Model(samples)
    texts = ["".join(r.choice("abcde éßx,") for _ in range(r.choice([1, 5, 700, 1500]))) for _ in range(40)]
    got = model.phrases([L.symbols(t) for t in texts])
    for k, (_, s) in enumerate(samples):
        assert all(abs(got[k][i] - parse(t, s)) < 1e-12 for i, t in enumerate(texts))


def test_automaton_accepts_exactly_the_substrings():
    s = [1, 2, 1, 1, 2, 3, 2, 1]
    a = L.SuffixAutomaton(__import__("numpy").array(s))
    subs = {tuple(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)}

    def accepted(state, word):
        yield word
        for c, to in a.next[state].items():
            yield from accepted(to, (*word, c))

    assert set(accepted(0, ())) == subs


def test_held_out_accuracy_on_the_whole_table(spark):
    out = L.query(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(out) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r.lang_pred == lang[r.doc_id] for r in out if r.held_out and lang[r.doc_id]]
    assert sum(held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_edge_rows(spark):
    train = docs(spark, [(1, "the cat and the dog " * 30, "en", "s"), (2, "der hund und die katze " * 30, "de", "s"),
                         (3, "no label", None, "s"), (4, None, "xx", "s"), (5, "123", "yy", "s")])
    known = L.samples(train)
    assert [k for k, _ in known] == ["de", "en"]
    d = docs(spark, [(1, None, None, None), (2, "", "en", "s"), (3, "12 34", "en", "s"), (4, "the dog", None, None),
                     (None, "DIE KATZE", None, None), (6, "hund und " * 60_000, "en", "s")])
    got = {(r.doc_id, r.language.lang_pred) for r in L.identify(d.withColumn("language", F.lit(1)), known).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "de"), (6, "de")}
    assert L.identify(d.limit(0), known).count() == 0
    assert {r.language.lang_pred for r in L.identify(d, L.samples(train.limit(0))).collect()} == {"und"}
    # labels of held-out rows, source and ids do not reach the prediction
    moved = d.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")).withColumn("doc_id", F.lit(0))
    assert sorted(r.language.lang_pred for r in L.identify(moved, known).collect()) == ["de", "de", "en", "und", "und", "und"]
