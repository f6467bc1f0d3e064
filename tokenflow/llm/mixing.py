"""Mixing sources to target weights as a time-varying curriculum (native).

Each source has a weight schedule over training time t in [0, 1]: a line from
``start`` to ``end`` times its average weight. The integral of the schedule is
the share of the source's demand met by time t; inverting it turns a document's
place in its source's token stream into its training position, and the mix is
the documents range-sorted by position.

Targets: sources in code point order (null last) weigh 3, 1, 2, 3, 1, 2, ...
and share ``budget`` times all sizes; a target stops at ``most`` times the size
of its source and the excess goes to the others by weight until none is above.
That fixed point is solved directly: a source is capped exactly when its cap
per weight is below the water level.

A source's stream is its documents in the order of md5(id), passed ``most``
times; a document takes what of its words lies before the target in each pass.
Cumulative sizes come from two steps, sums per (source, md5 bucket) and order
within a bucket, so a source with a third of all rows never meets in one task.

Defined results: null text or a text without a word has size 0 and takes 0;
a source of size 0 has target 0; null source is a source of its own; repeated
rows (equal id and text) follow each other in the stream and agree on every
rerun as a multiset; an empty table gives an empty result; all other columns
are kept untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tokenflow.llm.common import cut, doc_key, shuffle_partitions, table, words

WEIGHTS = (3, 1, 2)
BUDGET, MOST = 1.5, 2
#: (start, end) of each weight's schedule, relative to its average: heavy
#: sources fade out, light ones fade in, the middle stays
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size, target, kind) from (source, source_size): one row
    per source, a table of the number of sources."""
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "utf-8"))
    n = len(weights)
    s = sizes.withColumn("kind", (F.row_number().over(order) - 1) % n)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("kind") + 1))
    s = s.withColumn("cap", F.col("source_size") * float(most))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "kind", F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("pool", F.sum("source_size").over(whole) * float(budget))
    # water level if every source before this one is capped and this one is not
    s = s.withColumn("level", (F.col("pool") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("w").over(rest))
    s = s.withColumn("water", F.max(F.when(F.col("cap") / F.col("w") > F.col("level"), F.col("level"))).over(whole))
    return s.select("source", "source_size", "kind", F.when(
        F.col("water").isNull() | (F.col("cap") <= F.col("water") * F.col("w")), F.col("cap")
    ).otherwise(F.col("water") * F.col("w")).alias("target"))


def position(demand, target, kind, schedules=SCHEDULES):
    """Training time at which a source has met ``demand`` of its ``target``:
    the inverse of G(t) = a t + (b - a) t^2 / 2 with a + b = 2."""
    u = F.when(target > 0, demand / target).otherwise(F.lit(0.0))
    out = None
    for i, (a, b) in enumerate(schedules):
        if a == b:
            t = u
        else:
            t = (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2.0 * (b - a)) * u, F.lit(0.0))) - F.lit(a)) / F.lit(b - a)
        out = F.when(kind == i, t) if out is None else out.when(kind == i, t)
    return out


def placed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
           weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """One row per row of ``docs`` with struct ``mix``: size, source_size,
    target, taken and ``positions`` (training time of each pass that takes
    words of the document)."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(source).alias("source"), F.md5(doc_key(F.col(doc_id))).alias("_k"),
                       F.size(words(F.col(text))).cast("long").alias("size"),
                       F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_tk"))
    return _place(held, weights, budget, most)


def _place(held: DataFrame, weights, budget, most) -> DataFrame:
    # a key without null, so that window and join share one exchange of the rows
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    held = held.withColumn("_b", F.substr("_k", F.lit(1), F.lit(4))).withColumn("_s", key)
    buckets = held.groupBy("_s", "_b").agg(F.first("source").alias("source"), F.sum("size").alias("_bs"))
    # offsets in two steps of at most 256 rows each: over groups of buckets, then inside a group
    buckets = buckets.withColumn("_g", F.substr("_b", F.lit(1), F.lit(2)))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(
        Window.unboundedPreceding, -1)
    groups = buckets.groupBy("_s", "_g").agg(F.sum("_bs").alias("_gs")).withColumn(
        "_go", F.coalesce(F.sum("_gs").over(before("_s", "_g")), F.lit(0))).drop("_gs")
    sized = targets(buckets.groupBy("source").agg(F.sum("_bs").alias("source_size")), weights, budget, most)
    # at most 65,536 buckets a source, each with its offset and its source's target
    offs = (buckets.join(groups, ["_s", "_g"])
            .withColumn("_off", F.col("_go") + F.coalesce(F.sum("_bs").over(before("_s", "_g", "_b")), F.lit(0)))
            .drop("source", "_bs").join(sized.withColumn("_s", key), "_s").select("_s", "_b", "_off", "source_size", "target", "kind"))
    inside = Window.partitionBy("_s", "_b").orderBy("_k", "_tk", "size").rowsBetween(Window.unboundedPreceding, -1)
    x = held.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offs, ["_s", "_b"])
    passes, starts = [], []
    for p in range(most):
        start = F.col("_off") + F.col("_in") + F.lit(p) * F.col("source_size")
        passes.append(F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - start)))
        starts.append(F.when(passes[-1] > 0, position(start.cast("double"), F.col("target"), F.col("kind"))))
    taken = passes[0]
    for p in passes[1:]:
        taken = taken + p
    return x.select("_row", F.struct(
        "size", "source_size", "target", taken.cast("long").alias("taken"),
        F.filter(F.array(*starts), lambda t: t.isNotNull()).alias("positions"),
        F.array(*passes).alias("passes")).alias("mix"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **kw) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row per pass that takes
    words of a document, range-sorted by training position. A pass that the
    target ends inside a document takes the whole document when at least half
    of it lies before the target, so texts stay whole."""
    p = placed(docs, text, source, doc_id, **kw)
    kept = F.filter(F.arrays_zip(F.col("mix.positions").alias("t"),
                                 F.filter("mix.passes", lambda n: n > 0).alias("n")),
                    lambda z: z["n"] * 2 >= F.col("mix.size"))
    rows = p.withColumn("_z", F.explode(kept)).select("_row", F.col("_z.t").alias("_t"))
    return _in_training_order(rows, F.col("_t"), F.col(f"_row.{doc_id}")).select("_row.*")


def _in_training_order(rows: DataFrame, at, doc_id) -> DataFrame:
    """``rows`` range-sorted by training time; rows without one (nothing taken) come last."""
    order = [at.asc_nulls_last(), doc_id]
    return rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = docs.select(F.struct("doc_id").alias("_row"), "source", F.md5(doc_key(F.col("doc_id"))).alias("_k"),
                       F.size(words(F.col("text"))).cast("long").alias("size"), F.lit("").alias("_tk"))
    out = _place(cut(held), WEIGHTS, BUDGET, MOST)
    out = out.select("_row.doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken",
                     F.get("mix.positions", F.lit(0)).alias("position"))
    return _in_training_order(out, F.col("position"), F.col("doc_id"))


SQL = """
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3 AS kind FROM s),
w AS (SELECT *, CASE kind WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
             source_size * 2.0::DOUBLE AS cap, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS pool FROM n),
l AS (SELECT *, (pool - coalesce(sum(cap) OVER (ORDER BY cap / w, kind, source IS NULL, source
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
               / sum(w) OVER (ORDER BY cap / w, kind, source IS NULL, source
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT *, (SELECT max(level) FROM l WHERE cap / w > level) AS water FROM l),
t AS (SELECT source, source_size, kind,
             CASE WHEN water IS NULL OR cap <= water * w THEN cap ELSE water * w END AS target FROM m),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.kind,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, greatest(0, least(size, CAST(round(target) AS BIGINT) - start)) AS p1,
             greatest(0, least(size, CAST(round(target) AS BIGINT) - start - source_size)) AS p2 FROM c),
u AS (SELECT *, CASE WHEN p1 > 0 THEN CASE WHEN target > 0 THEN CAST(start AS DOUBLE) / target ELSE 0.0 END END AS x FROM p)
SELECT doc_id, size, source_size, target, CAST(p1 + p2 AS BIGINT) AS taken,
       CASE WHEN x IS NULL THEN NULL WHEN kind = 0 THEN (sqrt(greatest(2.25::DOUBLE + -2.0::DOUBLE * x, 0.0)) - 1.5::DOUBLE) / -1.0::DOUBLE
                 WHEN kind = 1 THEN (sqrt(greatest(0.25::DOUBLE + 2.0::DOUBLE * x, 0.0)) - 0.5::DOUBLE) / 1.0::DOUBLE
                 ELSE x END AS position
FROM u
"""
