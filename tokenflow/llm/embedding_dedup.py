"""Near-duplicate embeddings by iterative quantisation.

1. Equal vectors become one node with a count.
2. Iterative quantisation learns, on a bounded sample of nodes (``SAMPLE``,
   the smallest hashes), rotations of the leading principal axes whose signs
   are balanced bits; ``ROTATIONS`` of them give one code each.
3. Multi-index Hamming tables: a code is cut into substrings of ``SUBSTRING``
   bits; nodes that agree in one substring up to one bit and differ in at most
   ``MOST_BITS`` bits of the whole code are candidates. Every node is indexed.
4. Crowded buckets first: nodes within half the threshold angle of a bucket's
   leader form a ball. Any two nodes of a ball are linked, so a ball is counted
   and never expanded.
5. Candidate pairs of balls or single nodes are reranked with the original
   vectors in double precision: by the leaders' angle and the radii all, none
   or some of their members link; only in the last case members are paired.

Defined results: a vector that is null, zero or holds null or non-finite
components links with nothing; vectors of different length never link; a null
id counts as the smallest id; rows with one id are separate vectors; an empty
table gives an empty result; other columns are carried out of the comparison.
Node identity is a 64-bit hash of the vector. Bounds in data: none on buckets,
partners or candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenflow.llm.common import cut, table
from tokenflow.llm.graph import components
from tokenflow.llm.jaccard_join import NULL_ID

THRESHOLD = 0.95
SAMPLE = 10_000
BITS, SUBSTRING, ROTATIONS, MOST_BITS = 64, 16, 2, 30
CROWD = 64


# --------------------------------------------------------------------- model

def itq(sample: np.ndarray, bits: int = BITS, rotations: int = ROTATIONS, rounds: int = 40, seed: int = 7):
    """(mean, projections): sign((x - mean) @ p) are the bits of one code."""
    mean = sample.mean(axis=0)
    x = sample - mean
    c = min(bits, x.shape[1])
    axes = np.linalg.svd(x.T @ x)[0][:, :c]
    v = x @ axes
    out = []
    for k in range(rotations):
        r = np.linalg.qr(np.random.default_rng(seed + k).normal(size=(c, c)))[0]
        for _ in range(rounds):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(b.T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return mean, out


def unit(flat: np.ndarray, width: int) -> np.ndarray:
    x = flat.reshape(-1, width).astype(np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)  # keeps squares finite
    x = x / np.where(big > 0, big, 1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as unit vectors, short ones padded with zeros."""
    n = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (n == width).all():
        return unit(flat, width)
    x = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    x[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return unit(x.ravel(), width)


# ---------------------------------------------------------------- candidates

def _coded(model, width: int):
    """(node, codes): one 64-bit integer per rotation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, projections = model.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), width) - mean
            cols = []
            for p in projections:
                bit = (x @ p >= 0).astype(np.uint64)
                cols.append((bit << np.arange(bit.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in cols]],
                                             ["node", *[f"c{k}" for k in range(len(cols))]])
    return run


def _buckets(codes: DataFrame, rotations: int, bits: int, substring: int, probe: bool) -> DataFrame:
    """codes with one row per table: key = table number and substring; with
    ``probe`` also the keys at one bit's distance (kind 1)."""
    per = -(-bits // substring)
    keys = []
    for r in range(rotations):
        for s in range(per):
            n = min(substring, bits - s * substring)
            t = F.lit((r * per + s) << substring).cast("long")
            sub = F.shiftrightunsigned(F.col(f"c{r}"), s * substring).bitwiseAND(F.lit((1 << n) - 1))
            keys.append(F.struct(t.bitwiseOR(sub).alias("key"), F.lit(0).alias("kind")))
            if probe:
                keys.append(F.struct(t.bitwiseOR(sub).alias("key"), F.lit(1).alias("kind")))
                keys += [F.struct(t.bitwiseOR(sub.bitwiseXOR(F.lit(1 << i))).alias("key"), F.lit(1).alias("kind"))
                         for i in range(n)]
    return codes.select("*", F.explode(F.array(*keys)).alias("k")).select("*", "k.key", "k.kind").drop("k")


def _unit_pairs(rotations: int, most_bits: int):
    """Candidate pairs of units (a < b) among the entries of each key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        key, kind, owner, *codes = [np.concatenate([g[k] for g in got]) for k in range(3 + rotations)]
        order = np.lexsort((kind, key))
        key, kind, owner = key[order], kind[order], owner[order]
        codes = [c[order].view(np.uint64) for c in codes]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        found: list[np.ndarray] = []
        size = 0
        for at, to in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
            mid = at + int(np.searchsorted(kind[at:to], 1))
            if mid in (at, to):
                continue
            # one probe of a bucket at a time against the bucket's whole index block
            units, first = np.unique(owner[at:mid], return_index=True)
            if len(units) == 1 and (owner[mid:to] == units[0]).all():
                continue
            for q in range(mid, to):
                far = np.zeros(mid - at, dtype=np.int64)
                for c in codes:
                    far += np.bitwise_count(c[at:mid] ^ c[q])
                near = owner[at:mid][far <= most_bits]
                near = np.unique(near[near != owner[q]])
                if len(near):
                    pair = np.empty((len(near), 2), np.int64)
                    pair[:, 0], pair[:, 1] = np.minimum(near, owner[q]), np.maximum(near, owner[q])
                    found.append(pair)
                    size += len(near)
            if size > 300_000:
                yield _pairs(found)
                found, size = [], 0
        if found:
            yield _pairs(found)
    return run


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    p = np.unique(np.concatenate(found), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["a", "b"])


def _cosines(pairs: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """pairs (a, b, ...) with column ``cos``, null for different lengths."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    joined = (pairs.join(vectors.select(F.col("node").alias("a"), F.col("v").alias("va")), "a")
              .join(vectors.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b")
              .where(F.size("va") == F.size("vb")).select("a", "b", *rest, "va", "vb"))
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _matrix(b.column("va"), width), _matrix(b.column("vb"), width)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("a", "b", *rest)],
                                              pa.array(np.einsum("ij,ij->i", x, y))], ["a", "b", *rest, "cos"])

    return joined.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("a", "b", *rest)) + ", cos double")


# ------------------------------------------------------------------- operator

def near_duplicates(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id",
                    threshold: float = THRESHOLD, sample: int = SAMPLE, crowd: int = CROWD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row."""
    spark = rows.sparkSession
    theta = math.acos(threshold)
    half = math.cos(theta / 2)
    v = F.col(vector)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        v, lambda x: x != 0)
    ids = rows.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(NULL_ID)).alias("id"),
                      F.when(F.coalesce(sound, F.lit(False)), v).alias("v"))
    ids = ids.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    nodes = cut(ids.where("node is not null").groupBy("node").agg(
        F.any_value("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("id")))
    width, total = nodes.agg(F.max(F.size("v")), F.count("*")).first()
    plain = F.col("id")
    if not total:
        return ids.select(F.when(plain != NULL_ID, plain).alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
                          F.when(plain != NULL_ID, plain).alias("component_id"), F.lit(True).alias("kept"))
    learned = _matrix(pa.chunked_array(nodes.orderBy("node").limit(sample).select("v").toArrow().column(0))
                      .combine_chunks(), width)
    shared = spark.sparkContext.broadcast(itq(learned))
    bits = min(BITS, width)
    rot = [f"c{k}" for k in range(ROTATIONS)]
    codes = cut(nodes.select("node", "v").mapInArrow(
        _coded(shared, width), "node long, " + ", ".join(f"{c} long" for c in rot)))

    # balls: every node of a crowded bucket against the bucket's leader
    seats = _buckets(codes, ROTATIONS, bits, SUBSTRING, probe=False).select("key", "node")
    order = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("leader"))
    leaders = seats.groupBy("key").agg(F.count("*").alias("k"), F.min(order).alias("l")).where(F.col("k") > crowd).select(
        "key", "l.leader")
    offers = seats.join(leaders, "key").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    taken = _cosines(offers, nodes, width).where(F.col("cos") >= half + 1e-12)
    pick = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("unit"), F.col("cos").alias("cos")))
    balls = taken.groupBy(F.col("a").alias("node")).agg(pick.alias("p")).select("node", "p.unit", "p.cos")
    member = cut(nodes.select("node", "n", "id").join(balls, "node", "left").select(
        "node", "n", "id", F.coalesce("unit", "node").alias("unit"),
        F.coalesce(F.acos(F.least("cos", F.lit(1.0))), F.lit(0.0)).alias("angle")))
    units = cut(member.groupBy("unit").agg(F.sum("n").alias("w"), F.min("id").alias("id"), F.max("angle").alias("r"),
                                           F.count("*").alias("k")))

    entries = _buckets(codes.join(member.select("node", "unit"), "node"), ROTATIONS, bits, SUBSTRING, probe=True)
    pairs = (entries.select("key", "kind", "unit", *rot).repartition("key")
             .mapInArrow(_unit_pairs(ROTATIONS, MOST_BITS), "a long, b long").distinct())
    ra, rb = (units.select(F.col("unit").alias(c), F.col("r").alias("r" + c), F.col("k").alias("k" + c)) for c in "ab")
    judged = cut(_cosines(pairs, nodes, width).join(ra, "a").join(rb, "b").withColumn(
        "angle", F.acos(F.least("cos", F.lit(1.0)))))
    single = (F.col("ka") == 1) & (F.col("kb") == 1) & (F.col("ra") == 0) & (F.col("rb") == 0)
    spread = F.col("ra") + F.col("rb") + F.lit(1e-9)
    whole = judged.where(F.when(single, F.col("cos") >= threshold).otherwise(F.col("angle") + spread <= theta)).select("a", "b")
    some = judged.where(~single & (F.col("angle") + spread > theta) & (F.col("angle") - spread <= theta)).select("a", "b")
    of_a, of_b = (member.select(F.col("unit").alias(u), F.col("node").alias(x)) for u, x in (("ua", "a"), ("ub", "b")))
    mixed = some.select(F.col("a").alias("ua"), F.col("b").alias("ub")).join(of_a, "ua").join(of_b, "ub")
    part = cut(_cosines(mixed.select("a", "b", "ua", "ub"), nodes, width).where(F.col("cos") >= threshold))

    both = whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = units.select(F.col("unit").alias("b"), "w")
    by_unit = both.join(weight, "b").groupBy(F.col("a").alias("unit")).agg(F.sum("w").alias("more"))
    ends = part.select("a", "b").unionByName(part.select(F.col("b").alias("a"), F.col("a").alias("b")))
    count = nodes.select(F.col("node").alias("b"), "n")
    by_node = ends.join(count, "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("extra"))
    edges = whole.unionByName(part.select(F.col("ua").alias("a"), F.col("ub").alias("b")))
    known = cut(components(edges))
    labelled = units.join(known, F.col("unit") == F.col("node"), "left").select(
        "unit", "w", "id", F.coalesce("component", "unit").alias("c"))
    least = labelled.groupBy("c").agg(F.min("id").alias("component"))
    done = (member.select("node", "unit").join(labelled.select("unit", "w", "c"), "unit").join(least, "c")
            .join(by_unit, "unit", "left").join(by_node, "node", "left")
            .select("node", (F.col("w") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("extra", F.lit(0)))
                    .cast("long").alias("n_links"), "component"))
    out = ids.drop("v").join(done, "node", "left").select(
        "id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("c"))
    return out.select(F.when(plain != NULL_ID, plain).alias("vec_id"), "n_links",
                      F.when(F.col("c") != NULL_ID, F.col("c")).alias("component_id"),
                      (F.col("c") == plain).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
