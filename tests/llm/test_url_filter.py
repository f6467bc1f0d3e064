import collections
import itertools

import pyspark.sql.functions as F

from tokenflow.llm import url_filter as U

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[cut:]
    end = min((tail.index(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def stated(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://A.Com/x", "https://www.example.com/en/1", "https://m.example.com/en/1?x=1#y",
        "http://example.net/es/", "http://x.net?es/", "http://com", "http://com/", "http://notcom/", "ftp://é.NET/fr/é#q",
        "a://b://c.com/d", "http://evilexample.com/en/", "http:///en/", "http://x.org/a?utm_source=1&b", "http://x.com\n/y"]


def test_split_and_stated_rules_equal_brute_force(spark):
    d = spark.createDataFrame(list(enumerate(URLS)), SCHEMA)
    for r in U.judge(d).collect():
        v = r.url_verdict
        assert (v.host, v.path) == split(r.url), r.url
        rule, verdict = stated(v.host, v.path)
        assert v.rule == rule and (v.verdict == verdict if rule else v.verdict in ("allow", "block"))


def brute_rules(rows, support, confidence, labelled):
    """All token combinations by enumeration."""
    n, by = collections.Counter(), collections.Counter()
    for tokens, verdict in rows:
        for k in range(1, len(tokens) + 1):
            for c in itertools.combinations(sorted(tokens), k):
                n[c] += 1
                if verdict:
                    by[(c, verdict)] += 1
    least = support * len(rows)
    frequent = {k: m for k, m in by.items() if m >= least}
    known = collections.Counter()
    for (c, _), m in frequent.items():
        known[c] += m
    return {(c, v) for (c, v), m in frequent.items() if m >= confidence * known[c] and known[c] >= labelled * n[c]}


def test_mined_rules_equal_enumeration(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()
    host, path = U.split_url(F.col("url"))
    d = spark.read.parquet(f"{SF}/pages.parquet").select(U.tokens(host, path, F.col("url")).alias("tokens"),
                                                         U.stated_rule(host, path).getField("verdict").alias("verdict"))
    got = {(tuple(r.tokens), r.verdict) for r in U.mine(d, 0.02, 0.75, 0.5).collect()}
    plain = [(r.tokens, r.verdict) for r in d.collect()]
    assert len(rows) == len(plain) and got and got == brute_rules(plain, 0.02, 0.75, 0.5)


def test_mined_rules_reach_unlabelled_urls(spark):
    rows = [(i, f"http://casino{i}.spam.net/es/{i}") for i in range(40)] + [(100 + i, f"http://www.good.com/a/{i}") for i in range(40)]
    rows += [(200, "http://other.spam.net/xx/1"), (201, None)]
    v = {r.page_id: r.url_verdict for r in U.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert v[200].rule is None and v[200].verdict == "block" and v[200].mined_rule
    assert v[201].verdict == "allow" and v[100].rule == "com/"


def test_edges_and_native_plan(spark):
    d = spark.createDataFrame(list(enumerate(URLS)), SCHEMA)
    assert U.judge(d.limit(0)).count() == 0
    clash = d.withColumn("host", F.lit(1)).withColumn("url_verdict", F.lit(2)).withColumn("_tokens", F.lit(3))
    out = U.judge(clash.union(clash))
    assert out.count() == 2 * len(URLS) and out.columns.count("url_verdict") == 1
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
