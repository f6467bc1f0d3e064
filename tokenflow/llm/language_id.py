"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton,
which recognises exactly the substrings of the sample. A text is parsed
against each language: the longest match from the current place is one phrase,
then the next one starts; a symbol that the sample lacks is a phrase of its
own. Phrases per symbol estimate the cross entropy of the text under the
language (Ziv and Merhav); the language that needs the fewest wins.

Texts are parsed whole: lower-cased, every run of other characters than
letters is one space, and the symbols are cut into lanes of ``LANE`` symbols
that walk the automata in step, so a very long text is many lanes, not a long
loop. The samples (``TRAIN_DOCS`` documents and ``TRAIN_CHARS`` symbols a
language at most, chosen by the hash of the id) are all that is broadcast:
``TRAIN_CHARS`` characters per language, independent of the input.

Defined results: null text and text without a letter give ``und`` and score 0;
equal scores go to the first language by name; without labelled rows every
text is ``und``; labels and texts of held-out rows are never read for training;
repeated rows are judged alike; other columns are carried through.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tokenflow.llm.common import table

TRAIN_DOCS, TRAIN_CHARS = 96, 50_000
LANE = 512
#: symbols parsed at once in a task: bounds its memory
BLOCK = 3_000_000
UNKNOWN = "und"


def held_out(doc_id: Column, k: int = 5, rest: int = 0) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % k == rest, F.lit(False))


# ----------------------------------------------------------------- automaton

class SuffixAutomaton:
    """Smallest automaton of all substrings: ``next[state][symbol]``."""

    def __init__(self, symbols: np.ndarray):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols.tolist():
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = copy
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
            last = new


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """1 for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 32 for every run of non-letters,
    one 32 before and after."""
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cp = np.where(_letters()[cp], cp, 32)
    return cp[np.append(True, (cp[1:] != 32) | (cp[:-1] != 32))]


class Model:
    """Automata of all languages in one table: entry (state, symbol) is the
    place of the next state's row, 0 where there is none."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [lang for lang, _ in samples]
        texts = [symbols(text) for _, text in samples]
        known = np.unique(np.concatenate(texts)) if texts else np.empty(0, np.uint32)
        self.width = len(known) + 1  # symbol 0: in no sample
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.code[known] = np.arange(1, self.width)
        rows, self.roots = [], []
        offset = 1  # row 0 is nowhere
        for t in texts:
            edges = SuffixAutomaton(self.code[t]).next
            block = np.zeros((len(edges), self.width), dtype=np.int32)
            for s, e in enumerate(edges):
                if e:
                    block[s, list(e)] = np.array(list(e.values())) + offset
            rows.append(block)
            self.roots.append(offset * self.width)
            offset += len(edges)
        self.table = np.concatenate([np.zeros((1, self.width), np.int32), *rows]).ravel() * np.int32(self.width)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(languages, texts) phrases per symbol."""
        sizes = np.array([len(t) for t in texts])
        owner = np.repeat(np.arange(len(texts)), -(-sizes // LANE))
        ends = np.cumsum(sizes)
        starts = np.concatenate([np.arange(e - n, e, LANE) for e, n in zip(ends, sizes)])
        stops = np.minimum(starts + LANE, ends[owner])
        order = np.argsort(starts - stops, kind="stable")  # longest lanes first
        starts, lens = starts[order], (stops - starts)[order]
        flat = np.append(self.code[np.concatenate(texts)], np.zeros(LANE, np.int32))
        grid = np.ascontiguousarray(flat[starts[:, None] + np.arange(LANE)].T)
        roots = np.array(self.roots, dtype=np.int32)[:, None]
        state = np.zeros((len(roots), len(starts)), dtype=np.int32)  # nowhere: the next symbol opens a phrase
        count = np.zeros(state.shape, dtype=np.int32)
        active = np.searchsorted(-lens, -np.arange(LANE), side="left")  # lanes longer than t
        for t in range(int(lens.max(initial=0))):
            n = int(active[t])
            sym = grid[t, :n]
            go = self.table[state[:, :n] + sym]
            stuck = go == 0
            count[:, :n] += stuck
            state[:, :n] = np.where(stuck, self.table[roots + sym], go)
        out = np.zeros((len(self.languages), len(texts)))
        for k in range(len(self.languages)):
            out[k] = np.bincount(owner[order], weights=count[k], minlength=len(texts))
        return out / np.maximum(sizes, 1)

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang = [UNKNOWN] * len(texts)
        score = np.zeros(len(texts))
        if not self.languages:
            return lang, score
        block: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if not block:
                return
            p = self.phrases([s for _, s in block])
            best = p.argmin(axis=0)
            ranked = np.sort(p, axis=0)
            second = ranked[1] if len(ranked) > 1 else np.inf * np.ones(p.shape[1])
            sure = np.where(np.isinf(second), 1.0, second / (ranked[0] + np.where(np.isinf(second), 1, second)))
            for (row, _), b, s in zip(block, best, sure):
                lang[row], score[row] = self.languages[b], s
            block.clear()

        size = 0
        for row, text in enumerate(texts):
            s = symbols(text) if text else None
            if s is None or not (s != 32).any():
                continue
            block.append((row, s))
            size += len(s)
            if size >= BLOCK:
                flush()
                size = 0
        flush()
        return lang, score


@lru_cache(maxsize=1)
def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(samples)


# ------------------------------------------------------------------ operator

def samples(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
            docs: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> tuple[tuple[str, str], ...]:
    """(language, text) with at most ``docs`` documents and ``chars``
    characters a language. Picked by id hash without moving texts: the limit
    per language is applied inside the tasks first."""
    x = labelled.select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    x = x.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    w = Window.partitionBy("lang").orderBy(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    ids = x.select("lang", "id").withColumn("k", F.row_number().over(w)).where(F.col("k") <= docs)
    picked = (x.join(F.broadcast(ids.withColumnsRenamed({"lang": "l2", "id": "i2"})),
                     F.col("id").eqNullSafe(F.col("i2")) & (F.col("lang") == F.col("l2")))
              .select("lang", "k", F.substr("text", F.lit(1), F.lit(chars)).alias("text")))
    joined = picked.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("t")).select(
        "lang", F.substr(F.array_join("t.text", " "), F.lit(1), F.lit(chars)).alias("text"))
    return tuple(sorted((r[0], r[1]) for r in joined.collect()))


def identify(docs: DataFrame, learned: tuple[tuple[str, str], ...], text: str = "text") -> DataFrame:
    """``docs`` plus struct ``language`` (lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    @F.pandas_udf("lang_pred string, score double")
    def judge(t: pd.Series) -> pd.DataFrame:
        lang, score = _model(shared.value).judge([x if isinstance(x, str) else None for x in t])
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.withColumn("language", judge(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = samples(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), known)
    return out.select("doc_id", "held_out", "language.lang_pred", "language.score")
