"""Centroid clustering by dimension-sharded Lloyd iterations.

The vectors, as exact integers, are cut into column blocks (``column_blocks``):
a shard is one block of columns of one chunk of vectors. A round:

1. every shard computes the exact squared distances of its columns to its
   slice of the centroids;
2. ``reduceByKey`` on the chunk adds the blocks; the smallest sum is the nearest
   centroid (ties: the smaller number);
3. the assignment goes back to the shards of the chunk, every shard sums its own
   columns by cluster, and the sums of a block become its next slice.

The vectors are dealt to their shards once (later rounds read the same shuffle
files); a round moves partial distances and assignments only. Between rounds the driver holds the centroids: ``k`` times
the number of columns, whatever the number of vectors. Every round starts from
the written blocks, so nothing has to be kept in executors.

Defined results: vectors that are null, of another length or hold null or
non-finite components are left out; a null id counts as the empty text where
starts are chosen; equal ids are separate vectors, the smaller vector first;
with fewer vectors than ``k`` there are as many centroids as vectors; an empty
table gives an empty result; sums and distances beyond a long are given as the
largest long; columns other than id and vector are not read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenflow.llm import column_blocks as B
from tokenflow.llm.common import doc_key, shuffle_partitions, table, written

K, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
#: columns of one block
BLOCK = 16


class Clusters(NamedTuple):
    rows: DataFrame  # id, cluster, distance
    centroids: np.ndarray  # (clusters, columns) integers


def _nearest(partial, shuffles: int):
    """(chunk, (cluster, distance) arrays) from the shards' partial distances."""
    return partial.reduceByKey(B.add, shuffles).mapValues(lambda d: (d.argmin(axis=1), d.min(axis=1)))


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS,
            width: int = WIDTH, scale: int = SCALE, block: int = BLOCK, salt: str = "1:") -> Clusters:
    """Clusters of the vectors with ``width`` components; the starts are the
    vectors with the smallest sha256 of ``salt`` and the id."""
    spark = df.sparkSession
    ok = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        B.whole(F.col(vector_col)) & (F.size(vector_col) == width))
    starts = ok.orderBy(F.sha2(F.concat(F.lit(salt), doc_key(F.col("id"))), 256), "vector").limit(k).collect()
    if not starts:
        none = ok.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false")
        return Clusters(none, np.zeros((0, width), np.int64))
    centroids = B.floors(np.array([r.vector for r in starts], dtype=np.float64).reshape(-1, width), scale)
    edges = [*range(0, width, block), width] if width else [0, 0]
    shuffles = shuffle_partitions(spark)
    dealt = B.blocks(ok, "vector", scale, edges, "cluster-blocks")
    shards = dealt.drop("rows").rdd.map(lambda r: ((r.chunk, r.block), B.unpack(r))).partitionBy(shuffles)

    for _ in range(rounds):
        slices = _slices(spark, centroids, edges)
        n_blocks, groups = len(edges) - 1, len(centroids)
        nearest = _nearest(shards.map(lambda s: (s[0][0], B.distances(s[1], slices.value[s[0][1]]))), shuffles)
        back = nearest.flatMap(lambda a: [((a[0], b), a[1][0]) for b in range(n_blocks)]).partitionBy(shards.getNumPartitions())
        own = shards.join(back, shards.getNumPartitions())
        updated = (own.map(lambda s: (s[0][1], B.sums(s[1][0], s[1][1], groups)))
                   .reduceByKey(B.add_sums, n_blocks)
                   .map(lambda s: (s[0], B.floor_means(slices.value[s[0]], *s[1]))).collectAsMap())
        centroids = np.concatenate([updated[b] for b in range(n_blocks)], axis=1)
    slices = _slices(spark, centroids, edges)
    nearest = _nearest(shards.map(lambda s: (s[0][0], B.distances(s[1], slices.value[s[0][1]]))), shuffles)
    answers = spark.createDataFrame(nearest.map(lambda a: (a[0], a[1][0].tolist(), B.long(a[1][1]))),
                                    "chunk long, cluster array<int>, distance array<long>")
    rows = written(B.members(dealt, answers).select("row.id", "cluster", "distance"), "clusters")
    return Clusters(rows, centroids)


def _slices(spark: SparkSession, centroids: np.ndarray, edges: list[int]):
    return spark.sparkContext.broadcast([centroids[:, a:b] for a, b in zip(edges, edges[1:])])


def _as_long(total):
    return F.least(total, F.lit(B.LONG_MAX).cast("decimal(38,0)")).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "embeddings"))
    sums = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total"))
    hashes = [(i, hashlib.sha256(B.digits(c).encode()).hexdigest()) for i, c in enumerate(found.centroids)]
    names = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    # one row per centroid, at most K
    per = sums.join(F.broadcast(names), "cluster").select(
        "cluster", _as_long(F.col("total")).alias("cluster_inertia"), "centroid_sha256")
    everything = found.rows.agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).select(_as_long(F.col("total")))
    return (found.rows.join(F.broadcast(per), "cluster")
            .select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia",
                    everything.scalar().alias("inertia"), "centroid_sha256"))
