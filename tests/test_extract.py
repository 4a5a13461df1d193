"""Page extraction (E1-E9) on inline pages."""

from pyspark.sql import functions as F

from papyra.functions import html as H
from papyra.functions.dates import normalise_date
from papyra.functions.urls import urljoin
from papyra.operators.extract import listing_links, page_articles, page_paragraphs

PAGE = """<html><head><script>var t="</p>";</script><style>p{}</style></head><body>
<div class="article-info"><span class="date">23.02.2026</span><span class="category">Corporate</span></div>
<h1>The  &amp; title</h1><div class="teaser clear">+++ Big news +++</div>
<article><h1>The  &amp; title</h1><!-- <p>hidden</p> --><p><b>Head<br><p>First para.</p><p>  </p><p>Second<br>line</p></article>
</body></html>"""
NO_P = "<html><body><h1>T</h1><article>Line one<div>Line two</div></article></body></html>"
NO_BODY = "<html><body><h1>T</h1><span class='date'>31.02.2026</span></body></html>"


def test_page_articles(spark):
    pages = spark.createDataFrame([(1, "https://h/a/b", PAGE), (2, "https://h/", NO_P), (3, "https://h/", NO_BODY)],
                                  "page_id bigint, url string, html string")
    rows = {r["page_id"]: r for r in page_articles(pages).collect()}
    r = rows[1]
    assert r["title"] == "The & title"
    assert r["date_raw"] == "20260223" and r["category"] == "Corporate" and r["teaser"] == "+++ Big news +++"
    assert r["text_kind"] == "array" and r["paragraphs"] == ["Head", "First para.", "Second line"]
    assert rows[2]["text_kind"] == "string" and rows[2]["paragraphs"] is None
    assert rows[2]["body_text"] == "Line one\nLine two"
    assert rows[3]["text_kind"] is None and rows[3]["paragraphs"] is None
    assert rows[3]["date_raw"] is None and rows[3]["date_malformed"] == 1
    paras = page_paragraphs(page_articles(pages)).where("page_id = 1").orderBy("pos").collect()
    assert [p["pos"] for p in paras] == [0, 1, 2]


def test_dates(spark):
    df = spark.createDataFrame([("1.2.2026",), ("23.02.2026",), ("31.02.2026",), (None,)], "d string")
    assert [r[0] for r in df.select(normalise_date(F.col("d"))).collect()] == ["20260201", "20260223", None, None]


def test_urljoin_matches_python(spark):
    from urllib.parse import urljoin as py_urljoin
    base = "https://www.example.com/global/article?x=1#f"
    hrefs = ["https://h/x", "//h/x", "/x", "x", "a/b.html", "?q=2", "#top", "/a/./b", "../up", "/a/b/../c",
             "/a/b/c/d/e/f/../../../../../x", "/search?q=/a/../b#/c/./d", "../../../../z", "a/..", "."]
    df = spark.createDataFrame([(base, h) for h in hrefs], "base string, href string")
    got = [r[0] for r in df.select(urljoin(F.col("base"), F.col("href"))).collect()]
    assert got == [py_urljoin(base, h) for h in hrefs]


def test_listing_newsfeed_profile(spark):
    listing = """<div>
    <article class="newsfeed x" data-id="T0001"><div class="text"><h3><a href="/global/article/detail/T0001">One</a></h3></div></article>
    <article class="newsfeed" data-id="T0002"><div class="text"><h3>No link</h3></div></article>
    <article class="newsfeed" data-id="T0003"><div class="text"><h3><a href="//cdn.h/x">Three</a></h3></div></article>
    <article class="newsfeed" data-id="T0004"><div class="text"><h3><a href="rel">Four</a></h3></div></article>
    </div>"""
    pages = spark.createDataFrame([(1, "https://www.h.com/global/article", listing)], "page_id bigint, url string, html string")
    got = listing_links(pages, H.NEWSFEED_LISTING, max_n=3).orderBy("pos").collect()
    assert [(r["pos"], r["article_id"], r["title"], r["link"]) for r in got] == [
        (0, "T0001", "One", "https://www.h.com/global/article/detail/T0001"),
        (2, "T0003", "Three", "https://cdn.h/x")]


def test_nav_links_fixture(spark):
    from tests.conftest import SF001
    from papyra.sources.readers import read_table
    from urllib.parse import urljoin as py_urljoin
    links = listing_links(read_table(spark, SF001, "pages", "page_id", "url", "html")).toPandas()
    pages = read_table(spark, SF001, "pages", "page_id", "url").toPandas().set_index("page_id")["url"]
    assert len(links) > 0
    assert all(py_urljoin(pages[p], h) == l for p, h, l in zip(links.page_id, links.href, links.link))


def test_selector_list_document_order(spark):
    prof = H.PageProfile(teaser=(".lead", ".teaser"), date=("time", ".date"))
    pages = spark.createDataFrame(
        [(1, "u", '<div class="teaser">T2</div><p class="lead">T1</p><span class="date">1.2.2026</span>'
                  '<time>3.4.2026</time><article><p>x</p></article>'),
         (2, "u", '<div class="teaser">only</div><span class="date">5.6.2026</span><article><p>x</p></article>')],
        "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["teaser"], r["date_raw"]) for r in page_articles(pages, prof).collect()}
    assert got == {1: ("T2", "20260201"), 2: ("only", "20260605")}


def test_newsroom_profile_compound_class(spark):
    html = ('<div class="article-info"><time>9.10.2025</time></div><div class="teaser">plain</div>'
            '<div class="clear teaser">both</div><div id="article-text"><p>a</p><p>b</p></div>')
    pages = spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")
    r = page_articles(pages, H.NEWSROOM_PROFILE).first()
    assert r["teaser"] == "plain" and r["date_raw"] == "20251009" and r["paragraphs"] == ["a", "b"]


def test_nested_unclosed_and_scoped(spark):
    rows = [(1, '<nav><a class="category">Nav</a><time>1.1.2020</time></nav><div class="article-info">'
                '<span class="category">C</span><div class="date">2.3.2024</div></div>'
                '<div class="teaser"><b>Big</b> news <div>of</div> today</div>'
                "<div id='article-text'><div><p>a<br>b</p></div>outside<p>c</p></div><p>after</p>"),
            (2, '<div id="article-text"><p>open body<p>second')]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in page_articles(pages, H.NEWSROOM_PROFILE).collect()}
    assert (got[1]["teaser"], got[1]["category"], got[1]["date_raw"]) == ("Big news of today", "C", "20240302")
    assert got[1]["paragraphs"] == ["a b", "c"] and got[2]["paragraphs"] == ["open body", "second"]


def test_links_of_all_containers(spark):
    html = ("<nav><li><a href='/a?x=1&amp;y=2'>A</a></li><!-- <li><a href='/no'>no</a></li> --></nav>"
            '<nav><li>none</li><li><a class="x" href="b">B</a></li></nav>')
    pages = spark.createDataFrame([(1, "https://h/d/", html)], "page_id bigint, url string, html string")
    got = [(r["pos"], r["title"], r["link"]) for r in listing_links(pages).orderBy("pos").collect()]
    assert got == [(0, "A", "https://h/a?x=1&y=2"), (2, "B", "https://h/d/b")]


def test_entities(spark):
    texts = ["&eacute; &#8211; &#x20AC; &amp;lt; &lt;&amp;", "&bogus; &#0; a & b", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(H.decode_entities(F.col("t"))).collect()] == ["é – € &lt; <&", "&bogus; &#0; a & b", "plain"]
