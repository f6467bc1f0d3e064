"""Language-model scoring by context-tree weighting.

The model predicts the bytes of the lower-cased (A-Z) text and an end byte.
Each byte is 8 binary decisions; for each decision the Krichevsky-Trofimov
estimates of all contexts of 0 to ``DEPTH`` preceding bytes are mixed with the
weights of context-tree weighting, fitted on the training documents (``ctw``).
A context that training lacks leaves its weight to the next shorter one.

How it runs:

1. Every input partition counts its distinct grams (``DEPTH`` bytes of context
   plus the next byte, an integer) and word hashes; one exchange by key adds
   them up. This is the model's size: it grows with the distinct grams and
   words of the input, never with one partition's length.
2. The grams are grouped into subtrees by their two most recent context bytes;
   each subtree is weighted by itself, the two levels above (65,536 x 255 nodes
   at most) on the driver; a second pass gives log10 p of every gram.
3. Documents are dealt by id hash into blocks of about ``BLOCK`` bytes. A
   block's distinct words are joined with the global counts and come back as
   the block's dictionary, so the vocabulary is never broadcast. Gram
   probabilities are broadcast while there are at most ``BROADCAST_GRAMS``
   (12 bytes each); beyond that they travel in the block dictionaries as well.
   Both ways give the same scores.

Word identity is a 63-bit hash. Defined results: null text is empty and scores
its end only; a text without words has one token (the end); without training
rows every probability is 1/2 per bit and N is 0; repeated rows are scored
alike, each counted in training; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokenflow.llm import ctw
from tokenflow.llm.common import doc_key, table, written

#: bytes of context; a gram and a row number share 64 bits, so at most 5
DEPTH, TOP = 5, 2
BLOCK = 24_000_000
CHUNK = 1_000_000
#: distinct keys of single chunks that a counting task holds before it merges them
PENDING = 1_500_000
BROADCAST_GRAMS = 8_000_000

WORD = 1 << 63  # keys from here on are words, below it grams
END, BYTES = WORD, WORD + 1
_SIGN = np.uint64(1 << 63)


def held_out(doc_id: Column, k: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % k == rest, F.lit(False))


# ---------------------------------------------------------------- in a task

def _signed(keys: np.ndarray) -> np.ndarray:
    """uint64 keys as the long column that sorts alike."""
    return (keys ^ _SIGN).view(np.int64)


def _keys(column: np.ndarray) -> np.ndarray:
    return column.astype(np.int64).view(np.uint64) ^ _SIGN


def _chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """(first row, lower-cased texts) of about ``size`` bytes, nulls empty."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(texts):
        done = ends[row - 1] if row else 0
        to = min(max(int(np.searchsorted(ends, done + size, side="right")), row + 1), row + 60_000)
        yield row, texts.slice(row, to - row)
        row = to


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the length of each text."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None:
        return np.empty(0, np.uint8), sizes
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], sizes


def _grams(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all texts (each with its end byte 0) and how many each has."""
    data, sizes = _bytes(texts)
    n = len(sizes)
    wide = np.zeros(len(data) + n * (depth + 1), dtype=np.uint8)
    at = np.repeat(depth + np.arange(n) * (depth + 1), sizes)
    wide[np.arange(len(data)) + at] = data
    starts = np.cumsum(sizes + depth + 1) - (sizes + depth + 1)
    real = np.ones(len(wide), dtype=bool)
    for k in range(depth):
        real[starts + k] = False
    return ctw.grams_of(wide, depth)[real[depth:]], sizes + 1


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    if len(_powers.table) < n:
        with np.errstate(over="ignore"):
            _powers.table = np.multiply.accumulate(np.append(np.uint64(1), np.full(2 * n, _ODD, np.uint64)))
    return _powers.table


_powers.table = np.empty(0, np.uint64)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Key of every word in order (a polynomial of random byte values, mixed),
    and the number of words of each text."""
    data, sizes = _bytes(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(sizes), np.int64)
    word = ~_IS_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = np.cumsum(sizes)
    heads = (ends - sizes)[sizes > 0]
    begins[heads] = word[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(sizes), np.int64)
    spans = np.diff(np.append(starts, len(data)))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    body = data[starts[0]:]
    with np.errstate(over="ignore"):
        value = np.where(word[starts[0]:], _RANDOM[body] * _powers(int(spans.max()))[at], np.uint64(0))
        keys = mix(np.add.reduceat(value, starts - starts[0])) | np.uint64(WORD)
    return keys, np.diff(np.searchsorted(starts, np.append(0, ends)))


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts]) if parts else np.empty(0, np.uint64)
    n = np.concatenate([c for _, c in parts]) if parts else np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _counter(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            train = ~b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, texts in _chunks(b.column(0)):
                mine = train[row:row + len(texts)]
                g, per = _grams(texts, depth)
                of_train = np.repeat(mine, per)
                parts.append(tuple(np.unique(g[of_train], return_counts=True)))
                rest = np.unique(g[~of_train])
                parts.append((rest, np.zeros(len(rest), np.int64)))
                keys, count = _words(texts)
                of_train = np.repeat(mine, count)
                parts.append(tuple(np.unique(keys[of_train], return_counts=True)))
                rest = np.unique(keys[~of_train])
                parts.append((rest, np.zeros(len(rest), np.int64)))
                parts.append((np.array([END, BYTES], np.uint64), np.array([mine.sum(), per.sum()])))
                if sum(len(k) for k, _ in parts[1:]) > PENDING:
                    parts = [_add(parts)]
        keys, n = _add(parts)
        yield from _rows(_signed(keys), n.astype(np.int64))
    return run


def _rows(keys: np.ndarray, values: np.ndarray, names=("key", "n"), step: int = 500_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(keys), step):
        yield pa.RecordBatch.from_arrays([pa.array(keys[k:k + step]), pa.array(values[k:k + step])], list(names))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]
    keys, n = _add(parts)
    yield from _rows(keys.view(np.int64), n.astype(np.int64))


# ----------------------------------------------------------------- the model

def counts(docs: DataFrame, text: str, train: Column, depth: int = DEPTH) -> DataFrame:
    """(key, n): training count of every distinct gram and word of all texts."""
    parts = docs.select(F.col(text).alias("text"), (~train).alias("held")).mapInArrow(
        _counter(depth), "key long, n long")
    return written(parts.repartition("key").mapInArrow(_summed, "key long, n long"), "counts")


def _subtree_column(depth: int) -> Column:
    """The ``TOP`` most recent context bytes of a gram key."""
    return F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 8 * (depth - TOP + 1))


def probabilities(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, lp): log10 probability of the next byte for every gram."""
    spark = grams.sparkSession
    rows = grams.withColumn("subtree", _subtree_column(depth))

    def load(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys = _keys(t.column("key").to_numpy())
        order = np.argsort(keys, kind="stable")
        return keys[order], t.column("n").to_numpy()[order].astype(float)

    def roots(t: pa.Table) -> pa.Table:
        found, _ = ctw.subtree(*load(t), depth, TOP, False)
        bit = np.repeat(np.arange(8), [len(r[0]) for r in found])
        return pa.table({"bit": bit.astype(np.int32), "node": np.concatenate([r[0] for r in found]).astype(np.int64),
                         **{c: np.concatenate([r[i] for r in found]) for i, c in ((1, "n0"), (2, "n1"), (3, "pw"))}})

    # at most 65,536 contexts x 255 nodes, whatever the input
    top = rows.groupby("subtree").applyInArrow(roots, "bit int, node long, n0 double, n1 double, pw double").toArrow()
    bits = top.column("bit").to_numpy()
    node, n0, n1, pw = (top.column(c).to_numpy() for c in ("node", "n0", "n1", "pw"))
    by_bit = []
    for bit in range(8):
        at = np.flatnonzero(bits == bit)
        at = at[np.argsort(node[at], kind="stable")]
        by_bit.append((node[at].astype(np.uint64), n0[at], n1[at], pw[at]))
    shared = spark.sparkContext.broadcast(ctw.Top(by_bit, TOP))

    def predict(t: pa.Table) -> pa.Table:
        keys, n = load(t)
        _, ones = ctw.subtree(keys, n, depth, TOP, True)
        return pa.table({"key": _signed(keys), "lp": shared.value.log10(keys, ones, depth)})

    return written(rows.groupby("subtree").applyInArrow(predict, "key long, lp double"), "grams")


# ------------------------------------------------------------------- scoring

class _Table:
    """Sorted keys with values; absent keys give ``missing``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values, self.missing = keys[order], values[order], missing

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), self.missing)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], self.missing)


def _by_row(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(per)), per), weights=values, minlength=len(per))


def score(docs: DataFrame, text: str, doc_id: str, train: Column, depth: int = DEPTH,
          broadcast_grams: int = BROADCAST_GRAMS, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    total = counts(docs, text, train, depth)
    word = F.col("key") >= 0  # the sign bit is flipped: words come last
    is_bytes = F.col("key") == int(_signed(np.array([BYTES], np.uint64))[0])
    c = total.where(word & ~is_bytes)
    n_train, v_train = c.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    size = total.where(is_bytes).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    grams = probabilities(total.where(~word), depth)
    shared = None
    if grams.count() <= broadcast_grams:
        t = grams.toArrow()
        keys, lp = _keys(t.column("key").to_numpy()), t.column("lp").to_numpy()
        order = np.argsort(keys, kind="stable")
        shared = spark.sparkContext.broadcast((keys[order], lp[order].astype(np.float32)))
    blocks = max(1, math.ceil(size / block))
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (~train).alias("held"),
                       F.pmod(F.xxhash64(doc_key(F.col(doc_id))), F.lit(blocks)).cast("int").alias("block"))

    def needed(t: pa.Table) -> pa.Table:
        """The distinct keys of a block."""
        found = [np.array([END], np.uint64)]
        for _, texts in _chunks(t.column("text").combine_chunks()):
            found.append(_words(texts)[0])
            if shared is None:
                found.append(np.unique(_grams(texts, depth)[0]))
        keys = np.unique(np.concatenate(found))
        return pa.table({"block": pa.array(np.full(len(keys), t.column("block")[0].as_py(), np.int32)),
                         "key": _signed(keys)})

    values = c.where("n > 0").select("key", F.col("n").cast("double").alias("value"))
    if shared is None:
        values = values.unionByName(grams.select("key", F.col("lp").cast("float").cast("double").alias("value")))
    dictionary = held.groupby("block").applyInArrow(needed, "block int, key long").join(values, "key").select(
        "block", "key", "value")
    all_tokens = float(n_train + v_train + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, value = _keys(right.column("key").to_numpy()), right.column("value").to_numpy()
        is_word = keys >= np.uint64(WORD)
        known = _Table(keys[is_word], value[is_word], 0.0)
        lp = (_Table(keys[~is_word], value[~is_word].astype(np.float32), math.log10(1 / 256)) if shared is None
              else _Table.__new__(_Table))
        if shared is not None:
            lp.keys, lp.values, lp.missing = *shared.value, math.log10(1 / 256)
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        end = known(np.array([END], np.uint64))[0]
        for _, texts in _chunks(left.column("text").combine_chunks()):
            g, per = _grams(texts, depth)
            # gram and row in one integer: one sort brings equal grams together
            g = (g << np.uint64(16)) | np.repeat(np.arange(len(per), dtype=np.uint64), per)
            g.sort()
            row = (g & np.uint64(65535)).astype(np.int64)
            g >>= np.uint64(16)
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            value = np.repeat(lp(g[first]), np.diff(np.append(first, len(g))))
            out["score"].append(np.bincount(row, weights=value, minlength=len(per)))
            keys, words = _words(texts)
            n = known(keys)
            out["n_tokens"].append(words + 1)
            out["n_known"].append(_by_row((n > 0).astype(float), words) + (end > 0))
            out["base_score"].append(_by_row(np.log10((n + 1) / all_tokens), words) + math.log10((end + 1) / all_tokens))
        n = left.num_rows
        cols = {k: np.concatenate(v) if v else np.empty(0) for k, v in out.items()}
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held"),
                         "n_tokens": cols["n_tokens"].astype(np.int64), "n_known": cols["n_known"].astype(np.int64),
                         "train_tokens": pa.array(np.full(n, n_train, np.int64)),
                         "base_score": cols["base_score"], "score": cols["score"]})

    kind = docs.schema[doc_id].dataType.simpleString()
    return held.groupby("block").cogroup(dictionary.groupby("block")).applyInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
             "score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), "text", "doc_id", ~held_out(F.col("doc_id")))
