"""Toxicity by a factorization machine over hashed terms.

A text's terms are the 64-bit hashes of its distinct lower-cased runs of letters
and digits (words) and of the first 4 and 5 letters of longer words. Its score is the logistic function of

    bias + sum of w[i] + sum over pairs i < j of <v[i], v[j]>

over the terms i of the text: the linear part of single terms and, with a
vector of ``FACTORS`` numbers per term, of every pair of terms, so that two
terms that are harmless alone can count together. The pair sum is half of
|sum of v|^2 - sum of |v|^2 and costs one pass over the terms.

A term is part of the machine if its presence and the label go together: the
log-likelihood ratio of the two in the sample is at least ``EVIDENCE``. Words of
every text would otherwise add up to more than the few that decide. The
weights w are learned by follow-the-regularised-leader steps with an L1
penalty, the vectors v by AdaGrad steps with an L2 penalty.

Training reads a bounded sample of the labelled rows (``TRAIN_DOCS`` documents
and ``TRAIN_TERMS`` terms, whole documents in the order of a hash); the model is
at most as large and is all that is broadcast. Scoring reads every text whole.

Defined results: null or empty texts and texts without a known term score the
bias; without labelled rows every score is 0 (one class only: near that class);
rows without a label, null ids and held-out rows are never read for training; a
document with several label rows counts once per row; repeated rows are scored
alike; other columns are carried through, but for one named as the result
(``toxicity``), which is replaced.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokenflow.llm.common import table, written

TRAIN_DOCS, TRAIN_TERMS = 15_000, 6_000_000
FACTORS, EVIDENCE = 8, 14.0
STEMS = (4, 5)
EPOCHS, BATCH, SEED = 12, 32, 13
THRESHOLD = 0.3


def held_out(doc_id: Column, k: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % k == rest, F.lit(False))


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text: its words, and the stems (first
    letters) of longer words under a hash of their own."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"))

    def stems(n: int) -> Column:
        longer = F.filter(words, lambda w: F.length(w) > n)
        return F.transform(longer, lambda w: F.xxhash64(F.lit(n), F.substring(w, 1, n)))

    return F.array_distinct(F.concat(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)),
                                     *[stems(n) for n in STEMS]))


# --------------------------------------------------------------------- model

class Machine(NamedTuple):
    keys: np.ndarray  # sorted term hashes
    weight: np.ndarray
    factor: np.ndarray  # (terms, FACTORS)
    bias: float

    def scores(self, found: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Scores of ``docs`` texts whose terms are ``found``, each of text ``doc``."""
        z = np.full(docs, self.bias)
        if len(self.keys) and len(found):
            at = np.searchsorted(self.keys, found)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == found
            at, doc = at[hit], doc[hit]
            z += np.bincount(doc, self.weight[at], docs)
            for v in self.factor.T:
                z += 0.5 * (np.bincount(doc, v[at], docs) ** 2 - np.bincount(doc, v[at] ** 2, docs))
        return logistic(z)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _by_term(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(n))
    return np.add.reduceat(values[order], starts, axis=0)


def evidence(index: np.ndarray, sizes: np.ndarray, label: np.ndarray, n: int) -> np.ndarray:
    """Log-likelihood ratio of each term's presence and the label (G squared)."""
    with_term = np.bincount(index, minlength=n).astype(float)
    toxic = np.bincount(index, np.repeat(label, sizes), n)
    docs, all_toxic = float(len(label)), float(label.sum())

    def part(seen, expected):
        return seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300))

    rest, clean = docs - with_term, docs - all_toxic
    return 2 * (part(toxic, with_term * all_toxic / docs) + part(with_term - toxic, with_term * clean / docs)
                + part(all_toxic - toxic, rest * all_toxic / docs) + part(clean - with_term + toxic, rest * clean / docs))


def fit(found: np.ndarray, sizes: np.ndarray, label: np.ndarray, least: float = EVIDENCE, epochs: int = EPOCHS, rate: float = 0.2,
        l1: float = 0.05, l2: float = 1e-3, factors: int = FACTORS, seed: int = SEED) -> Machine:
    """The machine of documents given as their term hashes one after another,
    the number of terms of each, and labels 0 or 1."""
    if not len(label):
        return Machine(np.empty(0, np.int64), np.empty(0), np.empty((0, factors)), -500.0)
    keys, index = np.unique(found, return_inverse=True)
    chosen = evidence(index, sizes, label, len(keys)) >= least
    doc = np.repeat(np.arange(len(label)), sizes)[chosen[index]]
    index = (np.cumsum(chosen) - 1)[index[chosen[index]]]
    keys = keys[chosen]
    starts = np.searchsorted(doc, np.arange(len(label) + 1))
    r = np.random.default_rng(seed)
    n, bias_at = len(keys) + 1, len(keys)  # the bias is a term of every document
    w, z, g2 = np.zeros(n), np.zeros(n), np.zeros(n)
    v, v2 = r.normal(scale=0.05, size=(n, factors)), np.zeros((n, factors))
    v[bias_at] = 0
    penalty = np.append(np.full(n - 1, l1), 0.0)
    for _ in range(epochs):
        order = r.permutation(len(label))
        for b in range(0, len(order), BATCH):
            part = order[b:b + BATCH]
            own = [np.append(index[starts[d]:starts[d + 1]], bias_at) for d in part]
            first = np.append(0, np.cumsum([len(x) for x in own])[:-1])
            of = np.repeat(np.arange(len(part)), [len(x) for x in own])
            used, place = np.unique(np.concatenate(own), return_inverse=True)
            vu = v[used]
            total = np.add.reduceat(vu[place], first)
            pairs = 0.5 * (total ** 2 - np.add.reduceat(vu[place] ** 2, first)).sum(axis=1)
            error = logistic(np.add.reduceat(w[used][place], first) + pairs) - label[part]
            gw = np.bincount(place, error[of], len(used))
            z[used] += gw - (np.sqrt(g2[used] + gw ** 2) - np.sqrt(g2[used])) / rate * w[used]
            g2[used] += gw ** 2
            zu, pu = z[used], penalty[used]
            w[used] = np.where(np.abs(zu) <= pu, 0.0, -(zu - np.sign(zu) * pu) * rate / (1 + np.sqrt(g2[used])))
            gv = _by_term(place, error[of][:, None] * (total[of] - vu[place]), len(used)) + l2 * vu
            gv[used == bias_at] = 0
            v2[used] += gv ** 2
            v[used] = vu - rate / 4 * gv / np.sqrt(v2[used] + 1e-4)
    return Machine(keys, w[:-1], v[:-1], float(w[bias_at]))


# ------------------------------------------------------------------ operator

def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
                  limit: int = TRAIN_DOCS, most_terms: int = TRAIN_TERMS) -> DataFrame:
    """(key, label, terms) of a bounded sample of the labelled documents."""
    known = labels.select(F.col(doc_id).alias("of"), F.col(label).cast("double").alias("label")).where("of IS NOT NULL AND label IN (0, 1)")
    first = F.md5(F.col("of").cast("string"))
    chosen = known.orderBy(first, "of", "label").limit(limit)  # at most ``limit`` rows: proven size
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("of"))
    picked = written(rows.select(F.xxhash64("of", "text", "label").alias("key"), "label", terms(F.col("text")).alias("terms")), "toxicity-train")
    n, size = picked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    if n > limit:  # ids that stand for several documents
        picked = picked.orderBy("key").limit(limit)
    if size > most_terms:
        sizes = picked.select("key", F.size("terms").alias("n")).orderBy("key").collect()  # at most ``limit`` rows
        upto = int(np.searchsorted(np.cumsum([r.n for r in sizes]), most_terms, side="right"))
        picked = picked.where(F.col("key") < sizes[upto].key) if upto < len(sizes) else picked
    return picked


def learn(rows: DataFrame, **options) -> Machine:
    got = rows.toArrow().sort_by("key").combine_chunks()
    lists = got["terms"].combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return fit(lists.flatten().to_numpy(zero_copy_only=False), sizes, got["label"].to_numpy(), **options)


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` plus the score ``out`` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def judge(found: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(found).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(found)), sizes)
        return pa.array(shared.value.scores(found.flatten().to_numpy(zero_copy_only=False), doc, len(found)))

    return docs.withColumn(out, judge(terms(F.col(text))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = learn(training_rows(docs, labels.where(~held_out(F.col("doc_id")))))
    out = score(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), machine, out="score")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
