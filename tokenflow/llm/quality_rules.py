"""Quality rules by weak supervision (native: DataFrame and SQL functions only).

Every rule looks at counts of one text and votes *bad*, *good* or abstains.
No rule decides alone: expectation-maximisation over the vote patterns of the
whole table estimates, for each rule, how often it casts each vote on good
and on bad texts (its accuracy) and the share of good texts; the posterior
probability of being good is the verdict.

The EM never sees single documents: votes are aggregated to at most
3^7 = 2,187 patterns with their counts (map-side combine, so a hot source is
nothing special), the iterations run inside one SQL expression over that one
row, and the posterior per pattern (<= 2,187 rows, a proven bound) is
broadcast back.

Defined results: null text counts as empty; an empty text has zero counts,
``base_failed`` true and ``kept`` false; an empty table gives an empty result;
other columns are carried through, one named
``quality`` is replaced by the verdict in ``judge``; repeated rows are judged alike, each in its row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokenflow.llm.common import SPACE, UPPER, table, words, written

SYMBOLS = "#*$%&|<>"
BAD, ABSTAIN, GOOD = 0, 1, 2
EM_ROUNDS = 25
#: Dirichlet prior of (bad, abstain, good) votes per class, as heavy as the
#: class's own texts. A bad text usually breaks one rule and passes the others,
#: so passing says little; a rule is right about a good text unless the table
#: shows otherwise. Both classes start equally likely.
PRIOR = {"good": (0.001, 0.1, 0.899), "bad": (0.3, 0.1, 0.6)}


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds."""
    name: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "n_symbols >= 0.2 * n_words", "n_symbols <= 0.02 * n_words"),
    Rule("capitals", "n_upper >= 0.4 * word_chars", "n_upper <= 0.15 * word_chars"),
    Rule("repeats", "n_repeat_words >= 0.3 * n_words", "n_repeat_words <= 0.1 * n_words"),
    Rule("lines", "n_dup_lines >= 3 and n_dup_lines >= 0.3 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words",
         "word_chars between 3 * n_words and 12 * n_words"),
    Rule("vocabulary", "n_distinct < 0.15 * n_words and n_words < 5000", "n_distinct >= 0.3 * n_words"),
    Rule("length", "n_words < 20", "n_words >= 80"),
)


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of the whole text as a struct ``_c``.

    Repeated 3-word windows are found by sorting the window hashes of the
    text: equal neighbours are the repeated windows. The words that they
    cover are counted by position; a text with many repeated windows takes
    the sort by (hash, position) instead of membership tests, so no text costs
    more than n log n.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    a = docs.withColumn("_w", words(F.col(text))).withColumn(
        "_l", F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE, "") != ""))
    a = a.withColumn("_h", F.expr(
        "slice(transform(_w, (x, i) -> xxhash64(x, get(_w, i + 1), get(_w, i + 2))), 1, "
        "greatest(size(_w) - 2, 0))"))
    a = a.withColumn("_s", F.sort_array("_h"))
    a = a.withColumn("_d", F.expr("array_distinct(filter(_s, (x, i) -> i > 0 and x = get(_s, i - 1)))"))
    few = "filter(transform(_h, (x, i) -> if(array_contains(_d, x), i, -1)), x -> x >= 0)"
    a = a.withColumn("_o", F.expr(
        "case when size(_d) <= 16 then null else "
        "sort_array(transform(_h, (x, i) -> struct(x as h, i as i))) end"))
    many = ("transform(filter(_o, (x, k) -> x.h = get(_o, k - 1).h or x.h = get(_o, k + 1).h), x -> x.i)")
    a = a.withColumn("_p", F.expr(
        f"case when size(_d) = 0 then cast(array() as array<int>) when size(_d) <= 16 then {few} else {many} end"))
    bare = F.translate(t, SPACE, "")
    a = a.withColumn("_n", F.length(bare))
    return a.withColumn("_c", F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.col("_n").cast("long").alias("word_chars"),
        (F.col("_n") - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("size(array_distinct(flatten(transform(_p, i -> array(i, i + 1, i + 2)))))")
        .cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.col("_n") - F.length(F.translate(bare, UPPER, ""))).cast("long").alias("n_upper"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
    )).drop("_w", "_l", "_h", "_s", "_d", "_o", "_p", "_n")


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    return F.array(*[F.expr(f"case when {r.bad} then {BAD} when {r.good} then {GOOD} else {ABSTAIN} end")
                     for r in rules])


def posteriors(counted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = EM_ROUNDS) -> DataFrame:
    """(_v votes, p_good): at most 3^len(rules) rows, from all rows of ``counted``.

    EM for two classes with class-conditional vote probabilities (a rule may
    be right on good texts and blind to most bad ones) and the Dirichlet
    ``PRIOR``. Start: a text with any bad vote is bad with 0.9, any other good
    with 0.9.
    """
    r = len(rules)
    one = counted.groupBy("_v").count().agg(
        F.array_sort(F.collect_list(F.struct(F.col("_v").alias("v"), F.col("count").alias("n")))).alias("pats"))
    cells = f"sequence(0, {3 * r - 1})"
    total = "aggregate(qs, 0D, (a, x) -> a + x.n * {q})"
    cell = ("transform(" + cells + ", k -> ln((aggregate(qs, ({t} + 1D) * get({p}, k % 3), (a, x) -> a + "
            "if(get(x.v, k div 3) = k % 3, x.n * {q}, 0D))) / (2D * {t} + 1D)))")
    prior = {k: "array(" + ", ".join(f"{x}D" for x in v) + ")" for k, v in PRIOR.items()}

    def m_step(qs: str) -> str:
        good, bad = "x.q", "(1D - x.q)"
        body = (f"struct({cell.format(q=good, t='tg', p=prior['good'])} as g, "
                f"{cell.format(q=bad, t='tb', p=prior['bad'])} as b)")
        body = f"transform(array({total.format(q=bad)}), tb -> {body})[0]"
        body = f"transform(array({total.format(q=good)}), tg -> {body})[0]"
        return f"transform(array({qs}), qs -> {body})[0]"

    def e_step(s: str) -> str:
        odds = (f"aggregate(sequence(0, {r - 1}), 0D, (a, j) -> a + get({s}.g, 3 * j + get(p.v, j)) "
                f"- get({s}.b, 3 * j + get(p.v, j)))")
        return (f"transform(pats, p -> struct(p.v as v, cast(p.n as double) as n, "
                f"1D / (1D + exp(-greatest(-500D, least(500D, {odds})))) as q))")

    first = (f"transform(pats, p -> struct(p.v as v, cast(p.n as double) as n, "
             f"if(array_contains(p.v, {BAD}), 0.1D, 0.9D) as q))")
    fitted = one.withColumn("st", F.expr(m_step(first))).withColumn(
        "st", F.expr(f"aggregate(sequence(1, {rounds}), st, (st, it) -> {m_step(e_step('st'))})"))
    return fitted.select(F.explode(F.expr(e_step("st"))).alias("x")).select(
        F.col("x.v").alias("_v"), F.col("x.q").alias("p_good"))


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` plus ``quality``: a struct of the counts,
    ``base_failed``, ``p_good`` and ``kept``. The counted rows are written once
    (shared folder) and read by the EM and by the verdict."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    counted = text_counts(docs.select(row, F.col(f"`{text}`").alias("_text")), "_text")
    out = _verdict(counted.select("_row", "_c"), threshold)
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "quality"], "quality")


def _verdict(counted: DataFrame, threshold: float) -> DataFrame:
    """(_row, quality) from (_row, _c)."""
    flat = written(counted.select("*", "_c.*").withColumn("_v", votes()).withColumn("_f", base_failed())
                   .select("_row", "_c", "_v", "_f"), "quality")
    joined = flat.join(F.broadcast(posteriors(flat)), "_v", "left")
    kept = ~F.col("_f") & (F.col("p_good") >= threshold)
    return joined.select("_row", F.struct("_c.*", F.col("_f").alias("base_failed"), "p_good",
                                          kept.alias("kept")).alias("quality"))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    counted = text_counts(docs.select(row, F.col(f"`{text}`").alias("_text")), "_text").select("_row", "_c")
    return _verdict(counted, 0.5).where("quality.kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = text_counts(docs.select(F.struct("doc_id").alias("_row"), "text")).select("_row", "_c")
    out = _verdict(counted, 0.5)
    q = "quality."
    return out.select("_row.doc_id", q + "n_words", q + "word_chars", q + "n_symbols", q + "n_dup_lines",
                      q + "n_repeat_words", q + "base_failed", q + "kept", F.round(q + "p_good", 6).alias("p_good"))
