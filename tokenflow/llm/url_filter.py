"""URL filters by mined association rules (native: DataFrame, SQL and Spark ML's
FP-growth only).

Stated (host, path) rules decide the urls that they fit; the longest one wins.
Those decided urls are the labelled rows: the url tokens of every page, with
the verdict where it is known, are the transactions of FP-growth. Frequent
combinations that hold a verdict become rules ``tokens -> verdict``; support,
confidence among the labelled urls and the labelled share prune them. Urls that no
stated rule fits are matched against the mined rules through an inverted index
(token -> rule): a rule matches when as many of its tokens are found as it has.

Urls are first reduced to their distinct token sets, so a host with a third of
all pages costs one row per token set, not per page.

Defined results: a null url or one without ``://`` has empty host and path, no
tokens and the verdict ``default``; ties between mined rules go to the higher
confidence, then support, then the longer and alphabetically first token set;
repeated rows get the same verdict in their own row; an empty table gives an
empty result (nothing is mined); other columns are carried through, one named
``url_verdict`` is replaced.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokenflow.llm.common import ascii_lower, cut, table

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.75
#: least share of a token set's urls that is labelled: no rule is carried over
#: from a few labelled urls to many unlike them
MIN_LABELLED = 0.5
LABEL = "verdict="


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or
    the end, A-Z lower-cased; path up to ``?``, ``#`` or the end."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def stated_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest stated rule that fits, else null."""
    fits = []
    for h, p, verdict in rules:
        on = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(F.when(on, F.struct(F.lit(len(h + p)).alias("len"), F.lit(h + p).alias("rule"),
                                        F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits, F.lit(None)) if len(fits) == 1 else F.greatest(*fits)


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Sorted set of url tokens: top domain, domain, first host label, words of
    the name, first path segment (digits as ``#``), names of the parameters."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    name = F.get(labels, n - 3)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "\\?([^#]*)", 1)
    segment = F.regexp_replace(F.get(F.split(path, "/"), F.lit(1)), "[0-9]+", "#")
    found = F.concat(
        F.array(F.concat(F.lit("tld="), F.get(labels, n - 1)),
                F.when(n >= 2, F.concat(F.lit("domain="), F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), "."))),
                F.when(n >= 4, F.concat(F.lit("sub="), F.get(labels, F.lit(0)))),
                F.when(segment != "", F.concat(F.lit("dir="), segment))),
        F.transform(F.filter(F.split(F.coalesce(name, F.lit("")), "-"), lambda x: x != ""),
                    lambda x: F.concat(F.lit("name="), x)),
        F.transform(F.filter(F.split(query, "&"), lambda x: x != ""),
                    lambda x: F.concat(F.lit("param="), F.get(F.split(x, "="), F.lit(0)))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))))


def mine(urls: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         min_labelled: float = MIN_LABELLED) -> DataFrame:
    """(rule_id, tokens, verdict, support, confidence) of all rules that pass
    the bounds, from rows (tokens array, verdict or null)."""
    items = urls.where(F.size("tokens") > 0).select(F.when(F.col("verdict").isNull(), F.col("tokens")).otherwise(
        F.concat("tokens", F.array(F.concat(F.lit(LABEL), F.col("verdict"))))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    total = items.count()
    sets = model.freqItemsets.select(
        F.array_sort(F.filter("items", lambda x: ~x.startswith(LABEL))).alias("tokens"),
        F.get(F.filter("items", lambda x: x.startswith(LABEL)), F.lit(0)).alias("label"), "freq")
    body = sets.where(F.col("label").isNull()).select("tokens", F.col("freq").alias("all_freq"))
    both = sets.where(F.col("label").isNotNull() & (F.size("tokens") > 0))
    labelled = both.groupBy("tokens").agg(F.sum("freq").alias("labelled"))
    conf = F.col("freq") / F.col("labelled")
    return (both.join(body, "tokens").join(labelled, "tokens")
            .where((conf >= min_confidence) & (F.col("labelled") >= min_labelled * F.col("all_freq")))
            .select(F.xxhash64(F.array_join("tokens", " "), "label").alias("rule_id"), "tokens",
                    F.substr("label", F.lit(len(LABEL) + 1)).alias("verdict"),
                    (F.col("freq") / F.lit(float(max(total, 1)))).alias("support"), conf.alias("confidence")))


def match(token_sets: DataFrame, mined: DataFrame) -> DataFrame:
    """(tokens, verdict, mined_rule) of the best matching mined rule for every
    distinct token set that some rule matches."""
    index = mined.select("rule_id", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    hits = (token_sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
            .groupBy("tokens", "rule_id").agg(F.count("*").alias("n"), F.first("need").alias("need"))
            .where("n = need").select("tokens", "rule_id"))
    best = F.max(F.struct("confidence", "support", F.size("r.tokens").alias("size"),
                          F.array_join("r.tokens", " ").alias("mined_rule"), "r.verdict")).alias("b")
    return (hits.alias("t").join(mined.alias("r"), "rule_id").groupBy(F.col("t.tokens").alias("tokens")).agg(best)
            .select("tokens", "b.verdict", "b.mined_rule"))


def judge(pages: DataFrame, url: str = "url", rules=RULES, default: str = "allow",
          min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """All columns of ``pages`` plus the struct ``url_verdict`` (host, path,
    rule, verdict, mined_rule)."""
    host, path = split_url(F.col(url))
    held = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), host.alias("_host"),
                        path.alias("_path"), F.col(url).alias("_url"))
    held = held.withColumn("_rule", stated_rule(F.col("_host"), F.col("_path"), rules)).withColumn(
        "_tokens", tokens(F.col("_host"), F.col("_path"), F.col("_url")))
    mined = cut(mine(held.select(F.col("_tokens").alias("tokens"), "_rule.verdict"), min_support, min_confidence))
    open_sets = held.where("_rule is null and size(_tokens) > 0").select(F.col("_tokens").alias("tokens")).distinct()
    found = match(open_sets, mined).select(F.col("tokens").alias("_tokens"), F.col("verdict").alias("_mv"), "mined_rule")
    out = held.join(found, "_tokens", "left")
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in pages.columns if c != "url_verdict"], F.struct(
        F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", "_mv", F.lit(default)).alias("verdict"),
        F.when(F.col("_rule").isNull(), F.col("mined_rule")).alias("mined_rule")).alias("url_verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    v = "url_verdict."
    return judge(pages).select("page_id", v + "host", v + "path", v + "rule", v + "verdict", v + "mined_rule")
