"""Best-fit packing of token sequences by linear grouping.

1. Tokenise: every document gives its ids plus the end id; a document longer
   than a sequence is cut into whole sequences, the first piece may be shorter.
2. Count pieces per length. A length is at most the capacity, so this table has
   at most ``capacity`` rows, whatever the input; only it reaches the driver.
3. Plan on that table, once per setting of ``GROUPINGS``; the plan with the
   fewest sequences is taken. Pieces above ``small`` tokens are sorted and split into
   ``groups`` groups of equal cardinality, every length is rounded up to the
   largest of its group, and the few sizes that remain are packed by
   configurations (column generation: the linear program over configurations,
   priced by a knapsack). Real lengths then take the place of the rounded ones,
   and small pieces go best-fit into the room left, tightest first.
4. Substitute documents: the plan says, for each length, which ranks go to which
   sequence and offset. Ranks come from counts per (length, hash bucket) and
   the order inside a bucket, so no length, however common, meets in one task.

Defined results: null text counts as empty (one piece: the end id); a very
long text gives many pieces; equal rows are packed each for itself; an empty
table gives an empty result; columns of the input other than those named are
not carried into pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tokenflow.llm.common import cut, doc_key, table, task_env, tokenizer_path

CAPACITY, END_ID = 1024, 2
#: (groups, small): pieces above ``small`` are grouped and configured, the others
#: go best-fit. Each setting is planned, the one with the fewest sequences is taken
GROUPINGS = ((128, 128), (32, 512))
VOCABULARY = "byte_bpe_50k"

# ---------------------------------------------------------------- tokenising

#: texts of these characters are split alike by both libraries' patterns
_PLAIN = re.compile("[\t\n\r -~¡-ɏ–-…€]*")
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


@lru_cache(maxsize=2)
def _encoders(name: str):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    task_env()
    slow = Tokenizer.from_file(tokenizer_path(f"{name}.json"))
    with open(tokenizer_path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return slow, fast


def encode(text: str, name: str = VOCABULARY) -> list[int]:
    """Ids of a text as the vocabulary's ``tokenizers`` file gives them. Plain
    texts go through the same vocabulary's rank file, which is about five
    times faster and gives equal ids; all others through ``tokenizers``."""
    slow, fast = _encoders(name)
    if len(text) < 1_000_000 and _PLAIN.fullmatch(text):
        if SPECIAL not in text:
            return fast.encode_ordinary(text)
        out: list[int] = []
        for k, part in enumerate(text.split(SPECIAL)):
            out += ([SPECIAL_ID] if k else []) + fast.encode_ordinary(part)
        return out
    return slow.encode(text, add_special_tokens=False).ids


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be short."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
           end_id: int = END_ID, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked
    for, the ids themselves."""
    id_type = docs.schema[doc_id].dataType
    schema = "piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, cols = [], [[] for _ in range(5)]
            for row, t in enumerate(b.column(1).to_pylist()):
                ids = np.array([*encode(t or "", vocabulary), end_id], dtype="<u4")
                for k, (s, n) in enumerate(pieces_of(len(ids), capacity)):
                    part = ids[s:s + n]
                    take.append(row)
                    for c, v in zip(cols, (k, s, n, zlib.crc32(part.tobytes()), part.astype("i4") if with_ids else None)):
                        c.append(v)
            out = [b.column(0).take(pa.array(take, pa.int64())), pa.array(cols[0], pa.int32()),
                   *[pa.array(c, pa.int64()) for c in cols[1:4]]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(cols[4], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return src.mapInArrow(run, f"doc_id {id_type.simpleString()}, {schema}")


# ------------------------------------------------------------------ planning

@dataclass
class Run:
    """``n`` sequences from ``first`` on that hold the same lengths."""
    first: int
    n: int
    used: int


class Plan:
    """Placements (length, rank0, rank1, sequence0, offset): rank r of a length
    goes to sequence0 + r - rank0 at ``offset``."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int, small: int):
        self.capacity = capacity
        self.left = {l: n for l, n in counts.items() if n}
        self.next_rank = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.runs: list[Run] = []
        self.sequences = 0
        large = {l: n for l, n in self.left.items() if l > small}
        if large:
            self._configured(large, groups)
            self._greedy({l: self.left[l] for l in large})
        self._best_fit(sorted((l for l in self.left if l <= small), reverse=True))
        self._greedy({l: n for l, n in self.left.items() if l <= small})

    def _place(self, length: int, n: int, first: int, offset: int) -> None:
        r = self.next_rank[length]
        self.rows.append((length, r, r + n, first, offset))
        self.next_rank[length] += n
        self.left[length] -= n

    def _open(self, lengths: list[int], n: int) -> None:
        used = 0
        for l in lengths:
            self._place(l, n, self.sequences, used)
            used += l
        self.runs.append(Run(self.sequences, n, used))
        self.sequences += n

    def _configured(self, large: dict[int, int], groups: int) -> None:
        total = sum(large.values())
        each = -(-total // groups)
        sizes: list[int] = []
        members: list[list[list[int]]] = []  # per group: [length, count], longest first
        room = 0
        for l in sorted(large, reverse=True):
            n = large[l]
            while n:
                if not room:
                    room = each
                    if not sizes or sizes[-1] != l:
                        sizes.append(l)
                        members.append([])
                m = min(n, room)
                if members[-1] and members[-1][-1][0] == l:
                    members[-1][-1][1] += m
                else:
                    members[-1].append([l, m])
                n, room = n - m, room - m
        demand = np.array([sum(c for _, c in g) for g in members], dtype=float)
        for config, times in configurations(np.array(sizes), demand, self.capacity):
            self._substitute(config, int(times + 1e-9), members)

    def _substitute(self, config: np.ndarray, times: int, members: list[list[list[int]]]) -> None:
        """Real lengths for ``times`` sequences of one configuration."""
        if not times:
            return
        slots = []
        for g in np.flatnonzero(config):
            for _ in range(int(config[g])):
                need, got = times, []
                while need:
                    l, n = members[g][0]
                    m = min(n, need)
                    got.append((l, m))
                    members[g][0][1] -= m
                    need -= m
                    if not members[g][0][1]:
                        members[g].pop(0)
                slots.append(got)
        while slots[0]:
            n = min(s[0][1] for s in slots)
            self._open([s[0][0] for s in slots], n)
            slots = [([(s[0][0], s[0][1] - n)] if s[0][1] > n else []) + s[1:] for s in slots]

    def _greedy(self, counts: dict[int, int]) -> None:
        """What is left over: the longest first, each sequence filled up with
        the longest that fit, as often as the counts allow at once."""
        counts = {l: n for l, n in counts.items() if n}
        while counts:
            room, lengths, times = self.capacity, [], None
            for l in sorted(counts, reverse=True):
                k = min(room // l, counts[l])
                if k:
                    lengths += [l] * k
                    room -= k * l
                    times = counts[l] // k if times is None else min(times, counts[l] // k)
            self._open(lengths, times)
            for l in lengths:
                counts[l] -= times
            counts = {l: n for l, n in counts.items() if n}

    def _best_fit(self, lengths: list[int]) -> None:
        by_room: dict[int, list[Run]] = {}
        for r in self.runs:
            by_room.setdefault(self.capacity - r.used, []).append(r)
        for l in lengths:
            for room in sorted(r for r in by_room if r >= l):
                todo, by_room[room] = by_room.pop(room), []
                k = room // l
                for at, r in enumerate(todo):
                    n = self.left[l]
                    if not n:
                        by_room[room] += todo[at:]
                        break
                    full = min(r.n, n // k)
                    parts = [(full, k), (1, n % k)] if full < r.n else [(full, k)]
                    first = r.first
                    for m, each in parts:
                        if m and each:
                            for j in range(each):
                                self._place(l, m, first, r.used + j * l)
                            by_room.setdefault(room - each * l, []).append(Run(first, m, r.used + each * l))
                            first += m
                    if first < r.first + r.n:
                        by_room[room].append(Run(first, r.first + r.n - first, r.used))
                if not by_room[room]:
                    del by_room[room]
                if not self.left[l]:
                    break


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000):
    """(configuration, times) of an optimal fractional packing of ``demand``
    pieces of few ``sizes``: column generation, priced by a knapsack over the
    capacity. Times are fractional; callers round down."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(m))
        column, worth = _knapsack(sizes, prices, capacity)
        if worth <= 1 + 1e-6:
            break
        d = np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        basis[:, out] = column
    return [(basis[:, j], x[j]) for j in range(m)]


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        v = np.where(sizes <= c, best[np.maximum(c - sizes, 0)] + prices, -1.0)
        k = int(np.argmax(v))
        best[c], last[c] = (v[k], k) if v[k] > best[c - 1] else (best[c - 1], -1)
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            column[last[c]] += 1
            c -= int(sizes[last[c]])
    return column, float(best[capacity])


# ------------------------------------------------------------------- packing

def pack(items: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"),
         capacity: int = CAPACITY, groupings: tuple[tuple[int, int], ...] = GROUPINGS) -> DataFrame:
    """``items`` (rows that were written once: they are read three times) with
    sequence_id and offset. Lengths must lie in 1..capacity."""
    key = F.md5(F.concat_ws("|", *[doc_key(F.col(c)) for c in order]))
    x = items.withColumn("_b", F.substr(key, F.lit(1), F.lit(3)))
    buckets = x.groupBy(length, "_b").agg(F.count("*").alias("_n"))  # <= 4,096 a length
    before = Window.partitionBy(length).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = buckets.select(F.col(length).alias("_l"), F.col("_b").alias("_bb"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(length, "_b").orderBy(*order)
    ranked = (x.withColumn("_in", F.row_number().over(inside) - 1)
              .join(offs, (F.col(length) == F.col("_l")) & (F.col("_b") == F.col("_bb")))
              .withColumn("_r", F.col("_off") + F.col("_in")))
    counts = {int(r[0]): int(r[1]) for r in items.groupBy(length).count().collect()}  # <= capacity rows
    rows = min((Plan(counts, capacity, *g) for g in groupings), key=lambda p: p.sequences).rows
    plan = items.sparkSession.createDataFrame(
        pd.DataFrame(rows, columns=["_pl", "r0", "r1", "s0", "off"]).astype("int64").sort_values(["_pl", "r0"])
        if rows else [], "_pl long, r0 long, r1 long, s0 long, off long")
    # one row per length with its placements in rank order: at most `capacity` rows, broadcast
    by_length = plan.groupBy("_pl").agg(F.array_sort(F.collect_list(F.struct("r0", "r1", "s0", "off"))).alias("_ps"))
    found = F.expr("get(filter(_ps, p -> p.r0 <= _r and _r < p.r1), 0)")
    return (ranked.join(F.broadcast(by_length), F.col(length) == F.col("_pl"))
            .withColumn("_p", found)
            .select(*[F.col(f"`{c}`") for c in items.columns],
                    (F.col("_p.s0") + F.col("_r") - F.col("_p.r0")).alias("sequence_id"),
                    F.col("_p.off").alias("offset")))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, doc_ids, ids (at most ``capacity``) of packed pieces that
    carry their ids."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("r")).select(
        "sequence_id", F.col("r.doc_id").alias("doc_ids"), F.flatten("r.ids").alias("ids"))


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_ids: bool = True,
                   **kw) -> DataFrame:
    """Packed pieces of ``docs`` (tokenised once, in the shared folder)."""
    return pack(cut(pieces(docs, text, doc_id, with_ids=with_ids)), **kw)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
