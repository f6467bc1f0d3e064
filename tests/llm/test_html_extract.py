import pyspark.sql.functions as F

from tokenflow.llm import html_extract as H

SCHEMA = "page_id long, url string, html string"


def text(page, rules=None):
    return H.main_text(page, rules)


def test_article_without_the_rest():
    page = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>'
            '<nav><a href="/">Home</a></nav><header class="site-header"><h1>Site</h1></header><!-- <p>ad</p> -->'
            '<div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One\n <b>two</b>&nbsp;three<br>four</p>'
            '<form><p>Your mail</p></form><aside><p>Side</p></aside><ul><li>a<li>b</ul><div class="share-buttons">Share</div>'
            '<section id="comments"><p>Great!</p></section></article><div id="cookie-notice">Cookies</div><footer>F</footer></body></html>')
    assert text(page) == "Head & line\nOne two three four\na\nb"


def test_broken_markup():
    assert text("<article><p><b>Bold.<br><p>Next &lt;x&gt; &#233; 1 < 2") == "Bold.\nNext <x> é 1 < 2"
    assert text("<article><p>a<script>x") == "a"
    assert text("<p>plain <i>text") == "plain text"
    assert text("just text") == "just text"
    assert text("") == "" and text(None) == ""
    assert text('<article><p title="a > b">q</p><p class=menu>m</p>') == "q"


def test_repeats_become_groups_and_mismatches_optional():
    assert H.collapse("p # /p p # /p p # /p div".split()) == ["(p # /p)+", "div"]
    assert H.collapse("ul li # /li li # /li /ul ul li # /li li # /li /ul".split()) == ["(ul (li # /li)+ /ul)+"]
    w = H.align("div h1 # /h1 (p # /p)+ /div".split(" ")[:4] + ["(p # /p)+", "/div"], "div p # /p /div".split())
    assert w == ["div", "h1?", "#?", "/h1?", "(p # /p)+", "/div"]


def page(k, body):
    return (f'<html><body><div id="top"><p>My site</p><p><a href="/">go</a></p></div><div class="c1"><div class="c2">'
            f'<h2>Title {k}</h2>{body}</div></div><div class="z9"><p>All about us and our great site, same on all pages.</p>'
            f'</div></body></html>')


def pages(n):
    return [(k, f"http://a.org/{k}", page(k, "".join(f"<p>Sentence {j} of page {k}.</p>" for j in range(k % 4 + 1)))) for k in range(n)]


def want(k):
    return "\n".join([f"Title {k}"] + [f"Sentence {j} of page {k}." for j in range(k % 4 + 1)])


def test_wrapper_finds_the_article_without_article_tags(spark):
    d = spark.createDataFrame(pages(12), SCHEMA)
    for kw in ({}, {"broadcast_bytes": 0}):
        got = {r.page_id: r.main_text for r in H.extract(d.repartition(4), **kw).collect()}
        assert got == {k: want(k) for k in range(12)}
    w = H.wrappers(d).collect()
    assert len(w) == 1
    tokens = H.json.loads(w[0].wrapper)["tokens"]
    assert any(t.rstrip("?").endswith(")+") for t in tokens)


def test_whole_table(spark):
    import html
    import re
    sf = "/root/testdata/sf0.01"
    src = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = H.query(spark, sf).collect()
    assert len(out) == len(src)
    for r in out:
        a = re.search(r"<article>(.*?)</article>", src[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", a)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_edge_rows(spark):
    long = "<article>" + "<p>word word</p>" * 20_000
    d = spark.createDataFrame([(1, None, None), (2, "x", ""), (3, "http://a/b", long), (3, "http://a/b", long)], SCHEMA)
    out = H.extract(d.withColumn("host", F.lit("h")).withColumn("main_text", F.lit("old")))
    got = [(r.page_id, len(r.main_text)) for r in out.collect()]
    assert sorted(got) == [(1, 0), (2, 0), (3, 199_999), (3, 199_999)] and out.columns.count("main_text") == 1
    assert H.extract(d.limit(0)).count() == 0


def answers(spark, htmls):
    d = spark.createDataFrame([(k, f"http://a.org/{k}", h) for k, h in enumerate(htmls)], SCHEMA)
    got = [{r.page_id: r.main_text for r in H.extract(d.repartition(3), **kw).collect()} for kw in ({}, {"broadcast_bytes": 0})]
    assert got[0] == got[1]
    return [got[0][k] for k in range(len(htmls))]


def paras(k, n):
    return [f"Sentence {j} of page {k}, with words of its own." for j in range(n)]


def marked(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_wrapper_decides_inside_and_outside_article_elements(spark):
    def one(k):
        return (f'<div class="q1"><p>Welcome to our site</p></div><article><h1>T {k}</h1><div class="q2"><p>Read this on our app.</p>'
                f'</div>{marked(paras(k, k % 3 + 1))}<p>Thanks for reading, come back soon.</p></article><div class="q3"><p>Made by us</p></div>')

    def teaser(k):
        return f'<article><p>Card {k}</p></article><div class="q4"><h2>T {k}</h2>{marked(paras(k, 4))}</div>'

    got = answers(spark, [one(k) for k in range(9)] + [teaser(k) for k in range(9, 11)])
    assert got[:9] == ["\n".join([f"T {k}"] + paras(k, k % 3 + 1)) for k in range(9)]
    assert got[9:] == ["\n".join([f"Card {k}", f"T {k}"] + paras(k, 4)) for k in (9, 10)]


def test_long_template_texts_go_too(spark):
    legal = [f"Legal paragraph {c} " + "of many words " * 12 for c in "abcde"]
    got = answers(spark, [f'<div class="q1"><h2>T {k}</h2>{marked(paras(k, 6))}</div><div class="q2">{marked(legal)}</div>' for k in range(8)])
    assert got == ["\n".join([f"T {k}"] + paras(k, 6)) for k in range(8)]


def test_pages_of_another_layout_keep_their_text(spark):
    htmls = [f'<div class="q1"><p>Our site</p></div><div class="content">{marked(paras(k, 3))}</div>' for k in range(8)]
    htmls += [f'<div class="q1"><p>Our site</p></div><div class="story">{marked(paras(k, 2))}</div>' for k in (8, 9)]
    htmls += [f'<div class="q1"><p>Our site</p></div><div class="huge">{marked(paras(10, 300))}</div>']
    assert answers(spark, htmls) == ["\n".join(paras(k, 3 if k < 8 else 2 if k < 10 else 300)) for k in range(11)]


def test_heading_and_lead_beside_the_body(spark):
    htmls = [f'<div class="c"><h1>T {k}</h1><p>Lead of {k}.</p><div class="body">{marked(paras(k, 9))}</div></div>' for k in range(5)]
    assert answers(spark, htmls) == ["\n".join([f"T {k}", f"Lead of {k}."] + paras(k, 9)) for k in range(5)]


def test_names_are_whole_tokens_and_spare_the_article():
    for names in ("layout has-sidebar", "content no-sidebar", "with-comments-open", "page-without-ads"):
        assert text(f'<div class="{names}"><article><p>Text</p></article></div>') == "Text"
        assert text(f'<div class="{names}"><p>Text</p></div>') == "Text"
    assert text('<div class="widget"><article><p>Text</p></article></div><div class="ad">Buy</div>') == "Text"
    assert text('<div class="banner"><h1>Head</h1><p>Text</p></div><p>x</p>') == "Head\nText\nx"
    for names in ("sidebar", "main-nav", "share-buttons", "adBox", "ad ad-1", "cookie-notice", "related-posts"):
        assert text(f'<article><p>Text</p></article><div class="{names}"><article>Other</article></div>') == "Text"
        assert text(f'<p>Text</p><div class="{names}"><p>Other, longer than the text</p></div>') == "Text"


def test_copies_of_a_page_are_no_template(spark):
    page = f'<div class="q1"><h2>Head</h2><div class="q2"><p>{paras(0, 1)[0]}</p></div></div>'
    assert answers(spark, [page] * 5) == [f"Head\n{paras(0, 1)[0]}"] * 5
    dated = [f'<div class="q1"><h2>Head</h2>{marked(paras(0, 4))}<i>{k} views</i></div>' for k in range(5)]
    assert answers(spark, dated) == ["\n".join(["Head"] + paras(0, 4) + [f"{k} views"]) for k in range(5)]


def test_links_go_with_menus_only(spark):
    def links(k, n):
        return "".join(f'<li><a href="/{j}">Go to {k} {j}</a></li>' for j in range(n))

    htmls = [f'<div class="q0"><ul>{links(100 + k, 4)}</ul></div><div class="q1">{marked(paras(k, 2))}<p><a href="/x">Source {k}</a></p>'
             f'<ul>{links(k, 3)}</ul></div>' for k in range(4)]
    for some in (htmls, htmls[:1]):
        assert answers(spark, some) == ["\n".join(paras(k, 2) + [f"Source {k}"] + [f"Go to {k} {j}" for j in range(3)])
                                        for k in range(len(some))]
