import corpus_pipeline as C
from tests.llm.helpers import docs
from tests.llm.test_jaccard_join import brute as near_brute
from tests.llm.test_line_dedup import brute as line_brute
from tests.llm.test_packing import slow_ids

GOOD = " ".join(f"word{k}" for k in range(90))


def fixture(spark):
    passage = "\n".join(" ".join(f"p{k}w{j}" for j in range(30)) for k in range(3))
    rows = [(i, f"{' '.join(f'd{i}x{j}' for j in range(80))}\n{passage}\nend of document {i}.", "en", f"s{i % 4}") for i in range(30)]
    rows += [(100, GOOD, "en", "s0"), (101, GOOD + " extra", "en", "s1"), (102, "too short", "en", "s1"), (103, None, None, None),
             (104, "### $$$ %%% " * 60, "en", "s2"), (105, rows[3][1], "en", "s2")]
    return docs(spark, rows)


def test_each_stage_on_its_own_input(spark):
    d = fixture(spark).cache()
    assert [n for n, _ in C.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights",
                                        "best-fit packing"]
    good = C.quality(spark, d, "").cache()
    assert good.columns == d.columns
    assert {r.doc_id for r in d.collect()} - {r.doc_id for r in good.collect()} == {102, 103, 104}

    lines = C.lines(spark, good, "").cache()
    want = line_brute([(r.doc_id, r.text) for r in good.orderBy("doc_id").collect()], 50)
    got = {r.doc_id: r for r in lines.collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, t in want.items() if t != ""}
    assert 105 not in got and all(r.n_chars == len(r.text) for r in got.values())

    one = C.near_copies(spark, lines, "").cache()
    groups = near_brute([(r.doc_id, r.text) for r in lines.collect()])
    assert {r.doc_id for r in one.collect()} == {i for i, _, c in groups if i == c}
    assert 101 not in {r.doc_id for r in one.collect()}

    mix = C.mix(spark, one, "").cache()
    assert mix.columns == d.columns and {r.doc_id for r in mix.collect()} <= {r.doc_id for r in one.collect()}

    packed = C.pack(spark, mix, "").collect()
    tokens = sum(len(slow_ids(r.text)) + 1 for r in mix.collect())
    assert sum(r.length for r in packed) == tokens


def test_run_on_a_whole_table(spark):
    out = C.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024
