import zlib

import numpy as np
import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.helpers import docs
from tokenflow.llm import packing as P
from tokenflow.llm.common import table


def slow_ids(text):
    return P._encoders(P.VOCABULARY)[0].encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab \n\t'<|endoftext|>éß1", max_size=80)))
def test_ids_equal_the_tokenizers_library(text):
    assert P.encode(text) == slow_ids(text)


@pytest.mark.parametrize("counts", [{}, {1024: 3}, {1: 5000}, {600: 10, 424: 7, 300: 9}, {l: 1 + l % 7 for l in range(1, 1025)}])
@pytest.mark.parametrize("grouping", P.GROUPINGS)
def test_plan_is_gapless_and_complete(counts, grouping):
    p = P.Plan(dict(counts), 1024, *grouping)
    ranks, fill = {}, {}
    for length, r0, r1, first, offset in p.rows:
        assert ranks.get(length, 0) == r0
        ranks[length] = r1
        for k in range(r1 - r0):
            fill.setdefault(first + k, []).append((offset, length))
    assert ranks == counts
    assert sorted(fill) == list(range(p.sequences))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_configurations_meet_the_demand():
    sizes, demand = np.array([700, 400, 310]), np.array([10.0, 20.0, 33.0])
    found = P.configurations(sizes, demand, 1024)
    assert np.allclose(sum(c * x for c, x in found), demand)
    assert all(c @ sizes <= 1024 for c, _ in found)


def check(rows, texts):
    """texts: by doc id, one per document."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, parts in by_doc.items():
        ids = [*slow_ids(texts[d]), P.END_ID]
        at = 0
        for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(by_seq)


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {x.doc_id: x.text for x in table(spark, sf, "documents").collect()}
    rows = P.query(spark, sf).collect()
    used = check(rows, texts)
    assert used <= 1.005 * sum(r.length for r in rows) / 1024 + 1


def test_edge_rows_and_sequences(spark):
    d = docs(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (3, "word " * 5000, "en", "a"), (4, "x", None, None)])
    out = P.pack_documents(d.withColumn("sequence_id", F.lit(1)).withColumn("length", F.lit(2)))
    check(out.collect(), {1: None, 2: "", 3: "word " * 5000, 4: "x"})
    whole = P.sequences(out).collect()
    assert all(len(s.ids) <= 1024 for s in whole) and sum(len(s.ids) for s in whole) == out.agg(F.sum("length")).first()[0]
    assert P.pack_documents(d.limit(0)).count() == 0
    twice = d.union(d)
    got = P.pack_documents(twice, with_ids=False)
    assert got.count() == 2 * P.pack_documents(d, with_ids=False).count()
    assert got.groupBy("sequence_id", "offset").count().where("count > 1").count() == 0
