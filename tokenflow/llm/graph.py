"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tokenflow.llm.common import cut, narrowed


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest
    node of its component. ``edges``: columns a, b of one ordered type.

    Alternating large-star and small-star steps: every step points the
    neighbours of a node at the smallest of them, by partial aggregates joined
    back on the node, so a node with very many edges is never collected. The
    number of steps grows with the logarithm of the longest path.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    mark = _mark(e)
    rows = mark[0]  # a step never adds edges
    e = narrowed(e, rows)
    while mark[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = cut(narrowed(narrowed(large, rows).distinct(), rows))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .unionByName(least.select("hi", F.col("m").alias("lo"))))
        e = cut(narrowed(narrowed(small, rows).distinct(), rows))
        before, mark = mark, _mark(e)
        if before == mark:
            break
    least = e.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "node")
    roots = e.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return least.unionByName(roots)


def _mark(e: DataFrame):
    """Fingerprint of an edge table: one aggregated row."""
    return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first())
