"""N-gram Jaccard join with set-relation skipping.

Documents are sets of 5-word shingles; two link when their Jaccard similarity
is at least 0.8. The result is the component of every document, so links inside
a component that is already known are never looked for.

1. One pass counts shingles that repeat inside an input partition. The most
   frequent (``HOT`` at most, with the bound that keeps them so few) are
   broadcast with their size class: every set is ordered rare shingles first.
2. A second pass indexes the prefix of each set that any partner must hit
   (n - ceil(0.8 n) + 1 shingles) with the set's size and the position. Equal
   sets count once, by their smallest id.
3. Index-level skipping: a list is sorted by size and position. A set skips
   everything behind the first partner that is too large, and partners whose
   position leaves too few shingles to reach the threshold. Lists of up to
   ``SHORT`` entries give all remaining pairs, longer ones only the pairs with
   their ``LEADERS`` leaders.
4. Pairs are verified in tiles of sets that hang together. Verified links make
   components.
5. Sets that share long lists are gathered in clusters. Pairs inside a component
   need no answer any more, so only sets outside a cluster's largest component
   ask, and their links to other components are all that is returned.
6. Answer-level skipping, in both kinds of tiles: the answers of a set that is
   much like a leader are derived from the leader's answers, minus what the set
   lacks plus what it has more, so only the lists of the difference are read.

Exactness: each pair at or above the threshold shares a prefix shingle and
passes both bounds, so it is verified, or both sets are in one cluster and
either connected already or compared there.
Scale: postings are dealt by shingle and never sorted as a whole; a long list
gives rows in proportion to its length; tiles hold about ``TILE`` sets a side;
links and components stay in tables.

Defined results: null text, empty text and text without words have no shingle
and link with nothing; fewer than five words are one shingle; rows of one id
are one node, each with its own n_shingles; a null id is a node of its own and
counts as the smallest; an empty table gives an empty result; other columns
are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenflow.llm.common import cut, narrowed, table, written
from tokenflow.llm.graph import components
from tokenflow.llm.lm_scoring import _add, _chunks, _words, mix

WIDTH = 5
#: similarity of at least NUM / DEN
NUM, DEN = 4, 5
HOT, SHORT, LEADERS, TILE = 1_000_000, 64, 3, 4096
#: ids up to this many are broadcast (8 bytes each), beyond it joined by shuffle
BROADCAST_IDS = 2_000_000
NULL_ID = -(1 << 63)

_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each (already lower-cased) text."""
    keys, count = _words(texts)
    out = []
    with np.errstate(over="ignore"):
        m = mix(keys)
        h = m[:max(len(m) - width + 1, 0)].copy()
        for k in range(1, width):
            h = mix(h * _P + m[k:k + len(h)])
        at = 0
        for c in count.tolist():
            if c >= width:
                out.append(np.unique(h[at:at + c - width + 1]))
            elif c:
                x = m[at:at + 1] + np.uint64(c)
                for k in range(1, c):
                    x = mix(x * _P + m[at + k:at + k + 1])
                out.append(x)
            else:
                out.append(np.empty(0, np.uint64))
            at += c
    return out


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128-bit identity of a set, as two signed integers."""
    import xxhash
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _needed(a, b):
    """Smallest overlap of sizes a and b that reaches the threshold."""
    return -(-NUM * (a + b) // (NUM + DEN))


def _prefix(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


# ------------------------------------------------------------------- scanning

def _scan(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text).alias("text"))


def _sets(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    ids = b.column(0).to_numpy()
    for row, texts in _chunks(b.column(1)):
        yield ids[row:row + len(texts)], shingle_sets(texts)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document rows (kind 0: id, set key, size) and the shingles that repeat
    among the different sets of this partition (kind 1: shingle, count)."""
    parts, seen = [], set()

    def rows(kind, a, b, c, n):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, np.int32)), *[pa.array(np.asarray(x, np.int64)) for x in (a, b, c, n)]],
            ["kind", "a", "b", "c", "n"])

    for batch in batches:
        for ids, sets in _sets(batch):
            keys = [_set_key(s) for s in sets]
            yield rows(0, ids, [k[0] for k in keys], [k[1] for k in keys], [len(s) for s in sets])
            fresh = [s for s, k in zip(sets, keys) if k not in seen and not seen.add(k)]
            if fresh:
                u, n = np.unique(np.concatenate(fresh), return_counts=True)
                parts.append((u, n))
    u, n = _add(parts)
    u, n = u[n > 1], n[n > 1]
    zero = np.zeros(len(u), np.int64)
    if len(u):
        yield rows(1, u.view(np.int64), zero, zero, n)


def _hot(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles and their size class (log2 of the count), at most
    ``most``: the smallest class from which on there are so few."""
    total = counted.groupBy("a").agg(F.sum("n").alias("n")).withColumn("k", F.floor(F.log2("n")).cast("int"))
    total = cut(total.where("k >= 2"))
    by_class = sorted((r[0], r[1]) for r in total.groupBy("k").count().collect())  # at most 63 rows
    while sum(n for _, n in by_class) > most:
        by_class.pop(0)
    if not by_class:
        return np.empty(0, np.uint64), np.empty(0, np.int8)
    t = total.where(F.col("k") >= by_class[0][0]).select("a", "k").toArrow()
    keys = t.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], t.column(1).to_numpy()[order].astype(np.int8)


def _postings(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, classes = hot.value
        best: dict[tuple[int, int], int] = {}  # smallest id that was sent, per set
        for batch in batches:
            for ids, sets in _sets(batch):
                token, doc, size, pos, ident = [], [], [], [], []
                order = np.argsort(ids, kind="stable")  # of equal sets the smallest id of the chunk
                for k in order.tolist():
                    s = sets[k]
                    n = len(s)
                    if not n:
                        continue
                    name = _set_key(s)
                    if name in best and best[name] <= ids[k]:
                        continue
                    best[name] = ids[k]
                    p = _prefix(n)
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                        cls = np.where(keys[at] == s, classes[at], 0)
                        if cls.any():
                            s = s[np.argsort(cls, kind="stable")]
                    token.append(s[:p])
                    doc.append(np.full(p, ids[k]))
                    size.append(np.full(p, n))
                    pos.append(np.arange(p))
                    ident.append(np.full(p, name[0]))
                if token:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(doc).astype(np.int64)),
                         pa.array(np.concatenate(size).astype(np.int32)), pa.array(np.concatenate(pos).astype(np.int32)),
                         pa.array(np.concatenate(ident).astype(np.int64))], ["token", "doc", "size", "pos", "ident"])
    return run


# ----------------------------------------------------------- candidate search

def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return starts, np.append(starts[1:], len(x))


def _reaches(size_a, pos_a, size_b, pos_b):
    """Position bound: enough shingles are left behind both positions."""
    return 1 + np.minimum(size_a - 1 - pos_a, size_b - 1 - pos_b) >= _needed(size_a, size_b)


def _rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)),
                                       pa.array(b.astype(np.int64))], ["kind", "a", "b"])


def _search(short: int):
    """Lists of a partition: pairs (kind 0) of short lists and of the leaders of
    long ones, and (kind 1) which set is in a list led by which.

    A list is sorted by size and position. Sets look at later entries one step
    after the other, all lists at once; the first partner that is too large ends
    a set's list (all blocks behind it are skipped), a partner without room at
    its position is passed over."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        token, doc, size, pos, ident = (np.concatenate([g[k] for g in got]) for k in range(5))
        order = np.argsort(token, kind="stable")
        starts, ends = _runs(token[order])
        many = np.repeat(ends - starts > 1, ends - starts)
        token, doc, size, pos, ident = (x[order[many]] for x in (token, doc, size, pos, ident))
        order = np.lexsort((doc, ident, pos, size, token))
        token, doc, size, pos, ident = (x[order] for x in (token, doc, size, pos, ident))
        # equal sets are next to each other: once, by the smallest id
        fresh = np.append(True, (token[1:] != token[:-1]) | (size[1:] != size[:-1]) | (pos[1:] != pos[:-1])
                          | (ident[1:] != ident[:-1]))[:len(token)]
        token, doc = token[fresh], doc[fresh]
        size, pos = size[fresh].astype(np.int64), pos[fresh].astype(np.int64)
        starts, ends = _runs(token)
        length = np.repeat(ends - starts, ends - starts)
        stop = np.repeat(ends, ends - starts)
        here = np.flatnonzero(length <= short)
        step = 1
        while len(here):
            here = here[here + step < stop[here]]
            there = here + step
            near = size[there] * NUM <= size[here] * DEN
            here, there = here[near], there[near]
            good = _reaches(size[here], pos[here], size[there], pos[there]) & (doc[here] != doc[there])
            if good.any():
                x, y = doc[here[good]], doc[there[good]]
                yield _rows(0, np.minimum(x, y), np.maximum(x, y))
            step += 1
        for at, to in zip(starts[ends - starts > short].tolist(), ends[ends - starts > short].tolist()):
            d, n, q = doc[at:to], size[at:to], pos[at:to]
            lead = np.argsort(mix(d.view(np.uint64)), kind="stable")[:LEADERS]
            yield _rows(1, np.full(len(d), d[lead[0]]), d)
            for k in lead.tolist():
                small, large = np.minimum(n, n[k]), np.maximum(n, n[k])
                good = (large * NUM <= small * DEN) & _reaches(n, q, n[k], q[k]) & (d != d[k])
                yield _rows(0, np.minimum(d[good], d[k]), np.maximum(d[good], d[k]))
    return run


# --------------------------------------------------------------- verification

def _verify(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links among the pairs of a tile. ``left``: tile, a, b; ``right``: tile,
    doc, shingles (of one set per id, or several if rows share the id)."""
    a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
    docs = right.column("doc").to_numpy()
    sets = [np.asarray(s) for s in right.column("shingles").to_pylist()]
    of: dict[int, list[int]] = {}
    for k, d in enumerate(docs.tolist()):
        of.setdefault(d, []).append(k)
    words, flat = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.empty(0), np.empty(0))
    ends = np.cumsum([len(s) for s in sets])
    sets = [flat[e - len(s):e] for s, e in zip(sets, ends)]
    count = np.bincount(flat, minlength=len(words)) if len(words) else np.empty(0)
    # the leader holds the most common shingles of the tile
    lead = int(np.argmax([count[s].sum() / max(len(s), 1) for s in sets])) if sets else 0
    mark = np.zeros(len(words), dtype=np.int64)
    diffs = []
    if sets:
        mark[sets[lead]] = 1
    for s in sets:
        more = s[mark[s] == 0]
        lack = np.setdiff1d(sets[lead], s, assume_unique=True)
        if len(more) + len(lack) < len(s):
            diffs.append((True, more, lack))
        else:
            diffs.append((False, s, s[:0]))
    keep_a, keep_b = [], []
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, int)
    for at, to in zip(starts.tolist(), [*starts[1:].tolist(), len(a)]):
        partner, owner = [], []
        for d in b[at:to].tolist():
            for k in of.get(d, ()):
                partner.append(k)
                owner.append(d)
        if not partner:
            continue
        rel = np.array([diffs[k][0] for k in partner])
        plus = [diffs[k][1] for k in partner]
        minus = [diffs[k][2] for k in partner]
        size = np.array([len(sets[k]) for k in partner])
        linked = np.zeros(len(partner), dtype=bool)
        for p in of.get(int(a[at]), ()):
            mark[:] = 0
            mark[sets[p]] = 1
            with_lead = int(mark[sets[lead]].sum())
            over = np.where(rel, with_lead, 0) + _sums(mark, plus) - _sums(mark, minus)
            linked |= over >= _needed(len(sets[p]), size)
        keep_a += [int(a[at])] * int(linked.sum())
        keep_b += [d for d, yes in zip(owner, linked) if yes]
    return pa.table({"a": pa.array(keep_a, pa.int64()), "b": pa.array(keep_b, pa.int64())})


def _sums(mark: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(parts).astype(np.int64)
    ends = np.cumsum([len(p) for p in parts])
    total = np.append(0, np.cumsum(mark[flat]))
    return total[ends] - total[ends - [len(p) for p in parts]]


def _parts(c, n):
    """Part of an id among ``n``."""
    return F.pmod(F.xxhash64(c), n)


def _build(scan: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, shingles) of the documents in ``ids`` only."""
    some = scan.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, sets in _sets(b):
                rows = [k for k, s in enumerate(sets) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[rows]), pa.array([sets[k].view(np.int64) for k in rows], pa.list_(pa.int64()))],
                    ["doc", "shingles"])

    return some.select("doc", "text").mapInArrow(run, "doc long, shingles array<long>")


def _links(pairs: DataFrame, scan: DataFrame, tile: int) -> DataFrame:
    """Verified links (a, b) of candidate pairs (a, b). Pairs that hang together
    are verified in one tile, so a set is sent once; only a component of more
    than ``tile`` sets is cut into parts."""
    pairs = cut(pairs)
    n = pairs.count()
    pairs = narrowed(pairs, n)
    label = cut(narrowed(components(pairs), 2 * n))
    parts = label.groupBy("component").agg(F.ceil(F.count("*") / F.lit(float(tile))).cast("long").alias("k"))
    placed = (pairs.join(label.withColumnRenamed("node", "a"), "a").join(parts, "component")
              .withColumn("p", _parts("a", F.col("k"))).withColumn("q", _parts("b", F.col("k")))
              .select("a", "b", F.xxhash64("component", F.least("p", "q"), F.greatest("p", "q")).alias("tile")))
    placed = cut(narrowed(placed, n))
    need = placed.select("tile", F.col("a").alias("doc")).unionByName(
        placed.select("tile", F.col("b").alias("doc"))).distinct()
    sets = _build(scan, label.select(F.col("node").alias("doc"))).join(need, "doc").select(
        F.col("tile").alias("at"), "doc", "shingles")
    return cut(placed.groupby("tile").cogroup(sets.groupby("at")).applyInArrow(_verify, "a long, b long"))


def _across(t: pa.Table) -> pa.Table:
    """Links between components among the sets of a tile: every query against
    all data sets. Counts of shared shingles are merged from the data's lists;
    a query that is like the last leader starts from the leader's counts and
    merges only the lists of the shingles in which they differ."""
    sets = [np.asarray(s) for s in t.column("shingles").to_pylist()]
    comp, query = t.column("comp").to_numpy(), t.column("query").to_numpy(zero_copy_only=False)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    sets = [flat[e - n:e] for e, n in zip(ends.tolist(), sizes.tolist())]
    data = np.flatnonzero(~query)
    rows = np.repeat(np.arange(len(data)), sizes[data])
    shingle = np.concatenate([sets[k] for k in data]) if len(data) else np.empty(0, np.int64)
    order = np.argsort(shingle, kind="stable")
    rows, bounds = rows[order], np.searchsorted(shingle[order], np.arange(flat.max(initial=0) + 2))

    def merged(part: np.ndarray) -> np.ndarray:
        lists = [rows[bounds[x]:bounds[x + 1]] for x in part.tolist()]
        return np.bincount(np.concatenate(lists), minlength=len(data)) if lists else np.zeros(len(data), np.int64)

    found = set()
    lead, base = None, None
    in_lead = np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)
    for k in np.flatnonzero(query).tolist():
        s = sets[k]
        count = None
        if lead is not None:
            more = s[~in_lead[s]]
            lack = np.setdiff1d(lead, s, assume_unique=True)
            if len(more) + len(lack) < len(s) // 2:
                count = base + merged(more) - merged(lack)
        if count is None:
            count = merged(s)
            if lead is not None:
                in_lead[lead] = False
            lead, base = s, count
            in_lead[lead] = True
        hit = (count >= _needed(len(s), sizes[data])) & (comp[data] != comp[k])
        found.update((int(comp[k]), int(c)) for c in np.unique(comp[data][hit]))
    a, b = zip(*sorted(found)) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _cross_links(members: DataFrame, known: DataFrame, scan: DataFrame, tile: int) -> DataFrame:
    """Links (a, b) between components inside the clusters of sets that share
    long lists. Sets of a cluster's largest component are data only (their
    pairs are connected already); all others are queries against all sets."""
    n = members.count()
    cluster = cut(narrowed(components(narrowed(members, n)), 2 * n))
    labelled = cluster.select(F.col("node").alias("doc"), F.col("component").alias("cluster")).join(
        known, F.col("doc") == F.col("node"), "left").select(
        "doc", "cluster", F.coalesce("component", "doc").alias("comp"))
    each = labelled.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    main = each.groupBy("cluster").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("k"))
    main = main.select("cluster", F.col("m.comp").alias("main"), F.col("k"), (F.col("k") - F.col("m.n")).alias("q")).where("q > 0")
    rows = labelled.join(main, "cluster").withColumn("query", F.col("comp") != F.col("main"))
    rows = rows.withColumn("dp", F.ceil(F.col("k") / F.lit(float(tile)))).withColumn("qp", F.ceil(F.col("q") / F.lit(float(tile))))
    whole = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    data = rows.select("doc", "comp", "cluster", F.lit(False).alias("query"), _parts("doc", F.col("dp")).alias("x"),
                       F.explode(whole("qp")).alias("y"))
    asks = rows.where("query").select("doc", "comp", "cluster", "query", F.explode(whole("dp")).alias("x"),
                                      _parts("doc", F.col("qp")).alias("y"))
    placed = cut(data.unionByName(asks).select("doc", "comp", "query", F.xxhash64("cluster", "x", "y").alias("tile")))
    placed = narrowed(placed, placed.count())
    sets = _build(scan, placed.select("doc").distinct())
    return placed.join(sets, "doc").groupby("tile").applyInArrow(_across, "a long, b long")


# ------------------------------------------------------------------- operator

def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot: int = HOT,
                    short: int = SHORT, tile: int = TILE) -> DataFrame:
    """(doc, n_shingles, component): one row per row of ``docs``; null ids are
    ``NULL_ID`` here."""
    spark = docs.sparkSession
    scan = _scan(docs, text, doc_id)
    first = cut(scan.mapInArrow(_first_pass, "kind int, a long, b long, c long, n long"))
    shared = spark.sparkContext.broadcast(_hot(first.where("kind = 1"), hot))
    postings = scan.mapInArrow(_postings(shared), "token long, doc long, size int, pos int, ident long")
    found = cut(postings.repartition("token").mapInArrow(_search(short), "kind int, a long, b long").distinct())
    found = narrowed(found, found.count())
    links = _links(found.where("kind = 0").select("a", "b"), scan, tile)
    known = components(links)
    known = cut(narrowed(known, 2 * links.count()))
    more = _cross_links(found.where("kind = 1").select("a", "b"), known, scan, tile)
    known = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    members = first.where("kind = 0").select(F.col("a").alias("doc"), "b", "c", F.col("n").alias("n_shingles"))
    # equal sets and equal ids: one node, the smallest id
    reps = members.where("n_shingles > 0").groupBy("b", "c").agg(F.min("doc").alias("rep"))
    same = members.where("n_shingles > 0").join(reps, ["b", "c"]).select("doc", "rep").distinct()
    twice = same.groupBy("doc").agg(F.count("*").alias("k")).where("k > 1").select("doc")
    joined = known.select(F.col("node").alias("a"), F.col("component").alias("b"))
    if not twice.isEmpty():  # ids that stand for several texts tie their sets together
        joined = components(joined.unionByName(same.select(F.col("doc").alias("a"), F.col("rep").alias("b")))).select(
            F.col("node").alias("a"), F.col("component").alias("b"))
    out = members.join(reps, ["b", "c"], "left").withColumn("rep", F.coalesce("rep", "doc"))
    return out.join(joined.withColumnsRenamed({"a": "_n", "b": "_c"}), F.col("rep") == F.col("_n"), "left").select(
        "doc", "n_shingles", F.coalesce("_c", "rep").alias("component"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its component; of rows that
    are near copies under null or repeated ids, the one with the smallest (id,
    text hash) stays. Rows without shingles are nobody's copies."""
    out = cut(near_duplicates(docs, text, doc_id))
    drop = out.groupBy("doc").agg(F.min("component").alias("component")).where("doc <> component").select(
        F.col("doc").alias("__dropped"))
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    kept = docs.join(drop, key == F.col("__dropped"), "left_anti")
    if out.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return kept
    # each row a node of its own; written, so that all passes see the same row numbers
    rows = written(kept.withColumn("__row", F.monotonically_increasing_id()), "rows")
    order = F.struct(key.alias("id"), F.xxhash64(text).alias("th"), F.col("__row").alias("row"))
    each = cut(near_duplicates(rows, text, "__row").where("n_shingles > 0").select("doc", "component").join(
        rows.select("__row", order.alias("o")), F.col("doc") == F.col("__row")))
    first = each.groupBy("component").agg(F.min("o").alias("o")).select(F.col("o.row").alias("__first"))
    again = each.join(first, F.col("doc") == F.col("__first"), "left_anti").select(F.col("doc").alias("__dropped"))
    return rows.join(again, F.col("__row") == F.col("__dropped"), "left_anti").drop("__row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(back("doc").alias("doc_id"), "n_shingles", back("component").alias("component_id"))
