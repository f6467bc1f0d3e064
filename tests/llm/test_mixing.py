import pyspark.sql.functions as F

from tests.llm.helpers import docs, words
from tokenflow.llm import mixing as M


def targets(sizes, budget=1.5, most=2):
    """Literal rule: share by weight, cap, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, got, free = budget * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while free:
        share = left / sum(w[s] for s in free)
        over = {s for s in free if share * w[s] > most * sizes[s]}
        if not over:
            return got | {s: share * w[s] for s in free}
        for s in over:
            got[s] = most * sizes[s]
            left -= got[s]
        free -= over
    return got


ROWS = [(i, "w " * ((i * 37) % 50), "en", f"src{i % 7}" if i % 9 else None) for i in range(300)]
ROWS += [(i, "w " * 40, "en", "hot") for i in range(300, 800)] + [(900, None, "en", "empty"), (901, "", None, "empty")]


def test_targets_and_taken(spark):
    d = docs(spark, ROWS)
    rows = M.placed(d.repartition(5)).select("_row.*", "mix.*").collect()
    again = M.placed(d.repartition(3)).select("_row.*", "mix.*").collect()
    sizes = {}
    for _, t, _, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    key = lambda r: (r.doc_id, r.taken, tuple(r.positions))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert all(0 <= t <= 1 for r in rows for t in r.positions)


def test_positions_follow_the_schedule(spark):
    """Half of a source's demand is met when the integral of its schedule is a half."""
    d = docs(spark, [(i, "w " * 10, "en", f"s{i % 3}") for i in range(3000)])
    p = M.placed(d).select("_row.source", F.explode("mix.positions").alias("t"))
    early = {r.source: r.n for r in p.groupBy("source").agg(F.avg((F.col("t") <= 0.5).cast("int")).alias("n")).collect()}
    for k, (a, b) in enumerate(M.SCHEDULES):
        assert abs(early[f"s{k}"] - (a * 0.5 + (b - a) * 0.125)) < 0.02


def test_mixed_is_sorted_and_whole(spark):
    d = docs(spark, ROWS).withColumn("size", F.lit("x")).withColumn("target", F.lit(1))
    out = M.mixed(d)
    assert out.columns == d.columns
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert max(n.values()) <= 2 and set(n) <= {r[0] for r in ROWS}
    assert M.mixed(d.limit(0)).count() == 0


def test_repeated_rows_and_ties(spark):
    d = docs(spark, [(1, "a b c", "en", "s")] * 4 + [(None, "a b", None, None)] * 2)
    rows = M.placed(d).select("_row.doc_id", "mix.*").collect()
    assert len(rows) == 6 and all(r.taken <= 2 * r.size for r in rows)


