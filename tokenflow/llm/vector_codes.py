"""Vector code compression: product codes by an integer Walsh-Hadamard search.

Vectors become exact integers and are cut into equal parts; every part position
has a codebook of ``entries`` entries, refined by Lloyd rounds with exact floor
means. The nearest entry of a part is found in the Walsh-Hadamard domain: part
and entries are padded with zeros to a power of two p and transformed by the
matrix of +1 and -1, which multiplies every squared distance by exactly p. The
squared differences of the coefficients are added in sequency order (few sign
changes first, where neighbouring components that go together gather), and an
entry is dropped as soon as its sum so far exceeds the whole sum of the entry
that led after the first coefficients. All sums are integers; the distance is
the last sum divided by p, without remainder.

A task holds one part position of one chunk (``column_blocks``) and needs that
position's codebook only; the sums of a position come from ``reduceByKey``. The
driver holds the codebooks, ``entries`` times the number of columns.

Defined results: vectors that are null or hold null or non-finite components
are left out; all others are padded with zeros to one length, the longest
length rounded up to whole parts (an empty vector is all zeros); the starts are
the smallest ids, nulls last, of equal ids the smaller vector first; with fewer
vectors than ``entries`` there are as many entries as vectors; sums beyond a
long are given as the largest long; an empty table gives an empty result; the
columns named in ``keep`` come back in the struct ``kept`` (without any: the id),
whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenflow.llm import column_blocks as B
from tokenflow.llm.common import shuffle_partitions, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4_096
#: an aggregate of more groups than this is joined by a shuffle
SMALL_GROUPS = 100_000


@lru_cache(maxsize=8)
def walsh(n: int) -> np.ndarray:
    """(p, n) Walsh-Hadamard matrix in sequency order for inputs of n columns,
    which stand for p, the next power of two, columns (the others are zero)."""
    h = np.ones((1, 1), dtype=np.int64)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    changes = (h[:, 1:] != h[:, :-1]).sum(axis=1)
    return h[np.argsort(changes)][:, :n]


def encode(x: np.ndarray, book: np.ndarray, lead: int = 2) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, squared distance, terms added): integer rows
    ``x`` against the entries of ``book``; ties go to the lower index."""
    n, width = x.shape
    h = walsh(max(width, 1))[:, :width]
    p = len(h)
    m = largest = B.largest(x, book)
    bound = 4 * p * max(width, 1) * m * m + 2 * p * max(largest, 1)
    kind = np.int64 if bound < 1 << 62 else object
    part, entry = x.astype(kind) @ h.T.astype(kind), book.astype(kind) @ h.T.astype(kind)
    first = min(lead, p)
    near = ((part[:, None, :first] - entry[None, :, :first]) ** 2).sum(axis=2)
    best = ((part - entry[near.argmin(axis=1)]) ** 2).sum(axis=1)
    row, index = np.nonzero(near <= best[:, None])
    total = near[row, index]
    terms = near.size * first + n * p
    for j in range(first, p):
        total = total + (part[row, j] - entry[index, j]) ** 2
        terms += len(row)
        alive = total <= best[row]
        row, index, total = row[alive], index[alive], total[alive]
    starts = np.searchsorted(row, np.arange(n))  # the leader of each row is still there
    least = np.minimum.reduceat(total, starts) if n else total
    hit = np.flatnonzero(total == least[row])
    _, at = np.unique(row[hit], return_index=True)
    return index[hit[at]], least // p, terms


class Codes(NamedTuple):
    rows: DataFrame  # id, kept (struct), codes, error
    books: np.ndarray  # (parts, entries, columns of a part) integers


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (),
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of all whole vectors; at most 256 entries a codebook."""
    spark = df.sparkSession
    ok = df.where(B.whole(F.col(vector_col))).select(
        F.col(id_col).alias("id"), F.struct(*(keep or (id_col,))).alias("kept"),
        F.col(vector_col).cast("array<double>").alias("vector"))
    longest = ok.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        none = ok.select("id", "kept", F.array(F.lit(0)).alias("codes"), F.lit(0).cast("long").alias("error")).where("false")
        return Codes(none, np.zeros((parts, 0, 0), np.int64))
    width = -(-longest // parts)
    starts = [r.vector for r in ok.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()]
    padded = np.array([v + [0.0] * (parts * width - len(v)) for v in starts], dtype=np.float64).reshape(len(starts), parts * width)
    books = list(B.floors(padded, scale).reshape(len(starts), parts, width).transpose(1, 0, 2))
    dealt = B.blocks(ok, "vector", scale, [k * width for k in range(parts + 1)], "code-blocks")
    shards = dealt.drop("rows").rdd
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(books)

        def summed(r):
            x, book = B.unpack(r), now.value[r.block]
            return r.block, B.sums(x, encode(x, book)[0], len(book))

        updated = (shards.map(summed).reduceByKey(B.add_sums, parts)
                   .map(lambda s: (s[0], B.floor_means(now.value[s[0]], *s[1]))).collectAsMap())
        books = [updated[k] for k in range(parts)]
    now = spark.sparkContext.broadcast(books)

    def coded(r):
        index, error, _ = encode(B.unpack(r), now.value[r.block])
        codes = np.zeros((r.n, parts), dtype=np.uint8)
        codes[:, r.block] = index
        return r.chunk, (codes, error)

    def both(a, b):
        return a[0] + b[0], B.add(a[1], b[1])

    done = shards.map(coded).reduceByKey(both, shuffle_partitions(spark))
    answers = spark.createDataFrame(done.map(lambda a: (a[0], a[1][0].tolist(), B.long(a[1][1]))),
                                    "chunk long, codes array<array<int>>, error array<long>")
    rows = B.members(dealt, answers).select("row.id", "row.kept", "codes", "error")
    return Codes(written(rows, "codes"), np.stack(books))


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The integer vectors that (n, parts) codes stand for."""
    return np.concatenate([books[k][codes[:, k]] for k in range(len(books))], axis=1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress(table(spark, sf_dir, "embeddings"), keep=("label",))
    rows = found.rows.select(
        F.col("id").alias("vec_id"), F.col("kept.label").alias("label"),
        F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"), "error")
    total = F.sum(F.col("error").cast("decimal(20,0)"))
    per = written(rows.groupBy(F.col("label").alias("of")).agg(
        F.least(total, F.lit(B.LONG_MAX).cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    small = per.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS
    digest = hashlib.sha256(B.digits(found.books).encode()).hexdigest()
    return (rows.join(F.broadcast(per) if small else per, F.col("label").eqNullSafe(F.col("of")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
