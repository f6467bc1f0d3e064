"""Exact integer vectors in column blocks, for operators that deal the
dimensions of vectors to tasks.

A vector component x becomes floor(scale * x), exactly. Chunks of at most
``CHUNK`` vectors are cut into column blocks; one written row holds one block
of one chunk as packed integers of the smallest type that fits. Arithmetic is
in float64 while every intermediate result stays below 2**53 (such sums are
exact integers), in int64 below 2**62, and in Python integers beyond.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tokenflow.llm.common import written

CHUNK = 4_096
LONG_MAX = (1 << 63) - 1


def whole(vector: Column) -> Column:
    """The vector is not null and holds no null or non-finite component."""
    x = vector.cast("array<double>")
    return F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


# ------------------------------------------------------------------ integers

def largest(*arrays: np.ndarray) -> int:
    return max((int(abs(f(a))) for a in arrays if a.size for f in (np.min, np.max)), default=0)


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles; ``scale`` is a power of two, so that the
    product is exact unless it overflows."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    flat = [int(b) if np.isfinite(b) else int(a) * scale for a, b in zip(x.ravel().tolist(), y.ravel().tolist())]
    out = np.empty(len(flat), dtype=object)
    out[:] = flat
    return out.reshape(x.shape)


def exact(bound: int, *arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in a type that holds integers up to ``bound`` exactly."""
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
    return [a if a.dtype == kind else _widened(a, kind) for a in arrays]


def _widened(a: np.ndarray, kind) -> np.ndarray:
    if kind is not object:
        return a.astype(kind)
    out = np.empty(a.size, dtype=object)
    out[:] = [int(v) for v in a.ravel().tolist()]
    return out.reshape(a.shape)


def whole_numbers(a: np.ndarray) -> np.ndarray:
    return a if a.dtype == object else a.astype(np.int64)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b without overflow."""
    return whole_numbers(np.add(*exact(largest(a) + largest(b), a, b)))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(rows, entries) squared Euclidean distances of integer vectors."""
    bound = 4 * max(x.shape[1], 1) * largest(x, entries) ** 2
    x, e = exact(bound, x, entries)
    if x.dtype == np.float64:
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ e.T) + (e * e).sum(axis=1)
    else:
        d = np.stack([((x - row) ** 2).sum(axis=1) for row in e], axis=1)
    return whole_numbers(d)


def sums(x: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the rows of each group, and how many they are."""
    (wide,) = exact(largest(x) * max(len(x), 1), x)
    if wide.dtype == object:
        total = np.stack([wide[group == k].sum(axis=0) if (group == k).any() else _widened(np.zeros(x.shape[1]), object)
                          for k in range(groups)])
    else:
        total = (group == np.arange(groups)[:, None]).astype(wide.dtype) @ wide
    return whole_numbers(total), np.bincount(group, minlength=groups)


def add_sums(a, b):
    return add(a[0], b[0]), a[1] + b[1]


def floor_means(old: np.ndarray, total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """floor(total / count) by row; rows of no member stay as they were."""
    mean = total // np.maximum(count, 1)[:, None]
    if mean.dtype != old.dtype:
        mean, old = _widened(mean, object), _widened(old, object)
    return np.where(count[:, None] > 0, mean, old)


def long(values: np.ndarray) -> list[int]:
    """Values as longs; those beyond the largest long become the largest."""
    return [min(v, LONG_MAX) for v in values.tolist()]


def digits(values: np.ndarray) -> str:
    return ",".join(str(int(v)) for v in values.ravel().tolist())


# -------------------------------------------------------------------- blocks

def pack(x: np.ndarray) -> tuple[str, bytes]:
    if x.dtype == object:
        return "O", pickle.dumps(x.tolist())
    m = largest(x)
    kind = next(k for k, top in (("i1", 1 << 7), ("i2", 1 << 15), ("i4", 1 << 31), ("i8", 1 << 63)) if m < top)
    return kind, x.astype(f"<{kind}").tobytes()


def unpack(row) -> np.ndarray:
    """The integers of one written block, (vectors, columns)."""
    if row.kind == "O":
        out = np.empty((row.n, row.width), dtype=object)
        out[:] = pickle.loads(bytes(row.data))
        return out
    return np.frombuffer(row.data, dtype=f"<{row.kind}").reshape(row.n, row.width).astype(np.int64)


def dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones padded with zeros."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    x[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return x


def blocks(df: DataFrame, vector: str, scale: int, edges: list[int], name: str) -> DataFrame:
    """Written column blocks of ``df``, one row per (chunk, block):
    ``chunk, block, n, width, kind, data`` and, in block 0 only, ``rows`` with
    all other columns of the chunk's vectors. Block b holds the columns
    ``edges[b]`` up to ``edges[b + 1]``. Chunk numbers are fixed by the write,
    so a lost executor changes nothing that follows."""
    others = [c for c in df.columns if c != vector]
    kept = df.select(F.struct(*[F.col(c) for c in others]).alias("row"), F.col(vector).cast("array<double>").alias("vector"))
    fields = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("n", T.IntegerType()),
        T.StructField("width", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("data", T.BinaryType()),
        T.StructField("rows", T.ArrayType(kept.schema["row"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                n = part.num_rows
                x = floors(dense(part.column(1), edges[-1]), scale)
                packed = [pack(x[:, a:b]) for a, b in zip(edges, edges[1:])]
                k = len(packed)
                offsets = pa.array([0, *[n] * k], pa.int32())
                rows = pa.ListArray.from_arrays(offsets, part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([n] * k, pa.int32()),
                     pa.array(np.diff(edges).tolist(), pa.int32()), pa.array([p[0] for p in packed]),
                     pa.array([p[1] for p in packed], pa.binary()), rows], names=fields.names)
                number += 1

    return written(kept.mapInArrow(run, fields), name)


def members(table: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per vector: ``row`` (its other columns) and its answers.
    ``answers`` has one row per chunk with an array per answer."""
    own = table.where("block = 0").select("chunk", "rows")
    names = [c for c in answers.columns if c != "chunk"]
    return own.join(answers, "chunk").select(F.inline(F.arrays_zip(F.col("rows").alias("row"), *names)))
