"""Line dedup: later copies of repeated line runs go, by suffix array.

A run is a sequence of consecutive lines of one document. A run of at least
``min_words`` words that occurs earlier (by doc_id, then line) is deleted
wherever it occurs again; the union of all such runs is what each document
loses, so runs of lines that documents share are found even if their
neighbours differ. A line that goes always has an earlier copy that stays.

Limit: the unit is the whole line, equal in every byte. A shared passage that
starts or ends inside a line loses only its inner lines, if these have
``min_words`` words, and a passage inside one line stays. In documents of
sf0.1, 16 benchmark passages of 50 words or more stand in two or more
documents (38 places, none flush with line borders); at 27 of the 38 a line
that the passage touches occurs once in the table.

How:

1. Lines become 128-bit ids. A line that occurs once ends every run, so only
   stretches of repeated lines go on, and of those only the ones with
   ``min_words`` words. Equal stretches (whole copied documents) enter once,
   by their first copy; the later copies are repeated runs as they stand.
2. Prefix doubling: the name of the block of 2^k lines at a place is made of
   the names of its halves; equal names are one bucket of the suffix array
   sorted by 2^k lines.
3. Refinement from the longest blocks down: suffixes of one bucket whose next
   2^k lines agree split off as a deeper bucket and leave their first suffix
   behind as representative. The buckets that result are the longest-common-
   prefix intervals of the suffix array; there are fewer than two entries per
   suffix in all of them, and each suffix is in exactly one as other than the
   first: its longest earlier match.
4. Blocks with enough words are merged per document and cut out.

Hot lines: counting and splitting are partial aggregates joined back on
(bucket, name), which adaptive execution splits when skewed; no bucket is ever
collected. Windows are per document only.

Defined results: null text stays null, empty text stays empty; blank lines
have no words but belong to runs; rows equal in id and text are one document
and get equal results; rows with one id and different texts are ordered by
text hash; ids may be null (they come first); an empty table gives an empty
result; other columns are carried through, one named
``line_dedup`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from tokenflow.llm.common import SPACE, cut, table

MIN_WORDS = 50


def _names(prefix: str = "") -> list:
    return [F.col(f"{prefix}a"), F.col(f"{prefix}b")]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, th, ln, a, b, w): one row per line of each distinct (id, text)."""
    one = docs.select(F.col("_id").alias("doc"), F.col("_th").alias("th"), F.col("_text").alias("text")).where(
        "text is not null and text <> ''")
    words = (f"if(trim(BOTH '{SPACE}' FROM x) = '', 0, "
             f"size(split(trim(BOTH '{SPACE}' FROM x), '[\\\\x20\\\\x09-\\\\x0D]+')))")
    arr = F.expr(f"transform(split(text, '\\n'), x -> struct(xxhash64(x) as a, xxhash64(1, x) as b, {words} as w))")
    return one.select("doc", "th", F.posexplode(arr).alias("ln", "x")).select(
        "doc", "th", "ln", "x.a", "x.b", "x.w")


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc, th, ln, arr, words): maximal runs of lines that occur twice or
    more, with at least ``min_words`` words; arr holds (a, b, w) per line."""
    lines = cut(lines.distinct())  # equal rows are one document
    # written, so that the join has an exchange on both sides and a hot line can be split
    often = cut(lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"))
    seen = lines.join(often, ["a", "b"])
    w = Window.partitionBy("doc", "th").orderBy("ln")
    runs = seen.withColumn("g", F.col("ln") - F.row_number().over(w))
    return (runs.groupBy("doc", "th", "g")
            .agg(F.array_sort(F.collect_list(F.struct("ln", "a", "b", "w"))).alias("arr"), F.sum("w").alias("words"))
            .where(F.col("words") >= min_words)
            .select("doc", "th", F.col("arr.ln")[0].alias("ln"),
                    F.transform("arr", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"),
                                                         x["w"].cast("long").alias("w"))).alias("arr"), "words"))


def _doubled(first: DataFrame, levels: int) -> DataFrame:
    """Adds ``lv``: per level k the names and words of all blocks of 2^k lines."""
    x = first.withColumn("l0", F.col("arr"))
    for k in range(levels):
        h, here = 1 << k, f"l{k}"
        other = f"get({here}, i + {h})"
        x = x.withColumn(f"l{k + 1}", F.expr(
            f"case when size({here}) > {h} then transform(slice({here}, 1, size({here}) - {h}), (x, i) -> struct("
            f"xxhash64(x.a, x.b, {other}.a, {other}.b) as a, xxhash64(1, x.a, x.b, {other}.a, {other}.b) as b, "
            f"x.w + {other}.w as w)) else cast(array() as array<struct<a: bigint, b: bigint, w: bigint>>) end"))
    return x.select("doc", "th", "ln", F.array(*[F.col(f"l{k}") for k in range(levels + 1)]).alias("lv"))


def _matches(first: DataFrame) -> DataFrame:
    """(doc, th, ln, len, w): the longest earlier match of every suffix."""
    longest = first.agg(F.max(F.size("arr"))).first()[0] or 1
    levels = int(longest).bit_length() - 1
    names = cut(_doubled(first, levels))
    place = F.struct("doc", "th", "ln").alias("p")
    items = names.select("doc", "th", F.posexplode(F.get("lv", F.lit(0))).alias("i", "x"), "ln").select(
        "doc", "th", (F.col("ln") + F.col("i")).alias("ln"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("w"),
        F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for k in range(levels, -1, -1):
        block = names.select("doc", "th", "ln", F.posexplode(F.get("lv", F.lit(k))).alias("i", "x")).select(
            F.col("doc").alias("bd"), F.col("th").alias("bt"), (F.col("ln") + F.col("i")).alias("bl"),
            F.col("x.a").alias("xa"), F.col("x.b").alias("xb"), F.col("x.w").alias("xw"))
        at = (F.col("doc").eqNullSafe(F.col("bd")) & (F.col("th") == F.col("bt"))
              & (F.col("ln") + F.col("len") == F.col("bl")))
        now = cut(items.join(block, at, "left").drop("bd", "bt", "bl"))
        groups = cut(now.where("xa is not null").groupBy("a", "b", "xa", "xb")
                     .agg(F.count("*").alias("n"), F.min(place).alias("p")).where("n > 1").drop("n")
                     .withColumnsRenamed({"a": "ga", "b": "gb", "xa": "gxa", "xb": "gxb"}))
        on = ((F.col("a") == F.col("ga")) & (F.col("b") == F.col("gb"))
              & (F.col("xa") == F.col("gxa")) & (F.col("xb") == F.col("gxb")))
        stay = F.struct("len", "w", "a", "b")
        deeper = F.struct((F.col("len") + (1 << k)).alias("len"), (F.col("w") + F.col("xw")).alias("w"),
                          F.xxhash64(F.lit(k), *_names(), "xa", "xb").alias("a"),
                          F.xxhash64(F.lit(~k), *_names(), "xa", "xb").alias("b"))
        out = (F.when(F.col("p").isNull(), F.array(stay))
               .when(F.struct("doc", "th", "ln").eqNullSafe(F.col("p")), F.array(stay, deeper))
               .otherwise(F.array(deeper)))
        items = now.join(groups, on, "left").select("doc", "th", "ln", F.explode(out).alias("o")).select(
            "doc", "th", "ln", "o.len", "o.w", "o.a", "o.b")
    items = cut(items.where("len > 0"))
    firsts = cut(items.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("p")).where("n > 1").select(
        F.col("a").alias("ga"), F.col("b").alias("gb"), "p"))
    return (items.join(firsts, (F.col("a") == F.col("ga")) & (F.col("b") == F.col("gb")))
            .where(~F.struct("doc", "th", "ln").eqNullSafe(F.col("p"))).select("doc", "th", "ln", "len", "w"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, th, runs): per document the merged, disjoint, sorted line ranges
    (from, to exclusive) that repeat earlier text. ``docs``: _id, _th, _text."""
    runs = cut(_stretches(_lines(docs), min_words))
    key = [F.xxhash64("arr").alias("ka"), F.xxhash64(F.lit(1), "arr").alias("kb")]
    keyed = runs.select("*", *key)
    firsts = cut(keyed.groupBy("ka", "kb").agg(F.min(F.struct("doc", "th", "ln")).alias("p")).withColumnsRenamed(
        {"ka": "fa", "kb": "fb"}))
    split = cut(keyed.join(firsts, (F.col("ka") == F.col("fa")) & (F.col("kb") == F.col("fb")))
                .withColumn("is_first", F.struct("doc", "th", "ln").eqNullSafe(F.col("p")))
                .select("doc", "th", "ln", "arr", "is_first"))
    whole = split.where("not is_first").select("doc", "th", "ln", (F.col("ln") + F.size("arr")).alias("to"))
    found = _matches(split.where("is_first")).where(F.col("w") >= min_words).select(
        "doc", "th", "ln", (F.col("ln") + F.col("len")).alias("to"))
    blocks = whole.unionByName(found)
    by_doc = Window.partitionBy("doc", "th").orderBy("ln", "to")
    before = F.max("to").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = blocks.withColumn("new", (before.isNull() | (before < F.col("ln"))).cast("int")).withColumn(
        "g", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return (islands.groupBy("doc", "th", "g").agg(F.min("ln").alias("from"), F.max("to").alias("to"))
            .groupBy("doc", "th").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs")))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated runs cut out of the text column, plus struct
    ``line_dedup`` (n_lines, n_removed, runs)."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_id"),
                       F.col(text).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"))
    runs = repeated_runs(held, min_words).withColumnsRenamed({"doc": "_d", "th": "_t"})
    out = held.join(runs, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left")
    kept = F.expr("case when runs is null then _text else array_join(filter(split(_text, '\\n'), "
                  "(x, i) -> not exists(runs, r -> r.from <= i and i < r.to)), '\\n') end")
    n_lines = F.expr("case when _text is null or _text = '' then 0 else "
                     "length(_text) - length(translate(_text, '\\n', '')) + 1 end").cast("long")
    removed = F.expr("coalesce(aggregate(runs, 0L, (s, r) -> s + r.to - r.from), 0L)").cast("long")
    return out.select("_row", kept.alias("_kept"), F.struct(
        n_lines.alias("n_lines"), removed.alias("n_removed"),
        F.coalesce("runs", F.expr("cast(array() as array<struct<from: int, to: int>>)")).alias("runs")).alias("_info")
    ).select(*[F.col("_kept").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns
               if c != "line_dedup"], F.col("_info").alias("line_dedup"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "line_dedup.n_lines", "line_dedup.n_removed")
