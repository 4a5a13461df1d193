"""Element intervals and the scalar fold: nesting, stray and unclosed tags, many tags."""

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.functions import html as H
from papyra.operators.elements import element_intervals
from papyra.operators.extract import listing_links, page_articles


def by_stack(html, tag):
    """(start, inner, inner_end, level) in document order, by a stack."""
    found, stack = [], []
    for m in re.finditer(rf"(?is)</?{tag}\b[^>]*>?", html):
        if not m[0].startswith("</"):
            stack.append(len(found))
            found.append([m.start(), m.end(), len(html), len(stack)])
        elif stack:
            found[stack.pop()][2] = m.start()
    return [tuple(x) for x in found]


def _intervals(spark, pages, tag):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string")
    got = {}
    for r in element_intervals(df, tag).collect():
        got.setdefault(r["page_id"], []).append((r["pre"], r["start"], r["inner"], r["inner_end"], r["level"]))
    return [[x[1:] for x in sorted(got.get(i, []))] for i in range(len(pages))]


def test_intervals_of_odd_pages(spark):
    pages = ["", "no tags", "<div>a</div>", "</div><div>x", "<div><div>a</div>b</div>c<DIV class='q'>d</DIV>",
             "<divx>no</divx><div>é\U0001F600</div>", "<div></div></div></div><div><div></div>", "<div/><p></p></div >",
             "x" * 50_000 + "<div>" + "y" * 50_000 + "</div>"]
    assert _intervals(spark, pages, "div") == [by_stack(p, "div") for p in pages]
    assert element_intervals(spark.createDataFrame([(1, None)], "page_id bigint, html string"), "div").count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<p>", "</p>", "<p class='a'>", "x", "<b>", "</P>", "<pre>"]), max_size=14), max_size=6))
def test_intervals_equal_a_stack(spark, pages):
    pages = ["".join(p) for p in pages] or [""]
    assert _intervals(spark, pages, "p") == [by_stack(p, "p") for p in pages]


def test_many_nested_tags(spark):
    """Ten thousand nested elements: every interval right, and four times the tags take nowhere near sixteen times as long."""
    def page(n):
        return '<div class="teaser">' + "<div>" * n + "core" + "</div>" * n + "end</div>after"

    took = []
    for n in (2_500, 10_000):
        df = spark.createDataFrame([(1, "u", page(n))], "page_id bigint, url string, html string")
        spark_first = df.select(H.inline_text(H.block_with_class(F.col("html"), "teaser")).alias("t"))
        assert spark_first.first()["t"] == "core end"
        t = time.perf_counter()
        assert spark_first.first()["t"] == "core end"
        took.append(time.perf_counter() - t)
    assert took[1] < 8 * took[0] + 1
    assert _intervals(spark, [page(10_000)], "div") == [by_stack(page(10_000), "div")]


def test_nested_newsfeed_entries(spark):
    html = ('</article><article class="newsfeed" data-id="1"><article class="note">n</article><div class="text"><h3><a href="/1">One</a>'
            '</h3></div></article><article class="xnewsfeed" data-id="no"><div class="text"><h3><a href="/x">No</a></h3></div></article>'
            '<article data-id="2" class="a newsfeed"><div class="text"><h3>none</h3></div><article class="newsfeed" data-id="3">'
            '<div class="text"><h3><a href="3">Three</a></h3></div></article></article>'
            '<article class="newsfeed" data-id="4"><div class="text"><h3><a href="//h/4">Four</a></h3></div>')
    pages = spark.createDataFrame([(1, "https://h/d/", html), (2, "https://h/", "<p>none</p>")], "page_id bigint, url string, html string")
    got = [(r["pos"], r["article_id"], r["title"], r["link"]) for r in listing_links(pages, H.NEWSFEED_LISTING).orderBy("pos").collect()]
    # an entry without a link of its own shows the one nested in it
    assert got == [(0, "1", "One", "https://h/1"), (1, "2", "Three", "https://h/d/3"), (2, "3", "Three", "https://h/d/3"),
                   (3, "4", "Four", "https://h/4")]


def test_fold_keeps_text_outside_tags(spark):
    html = "<article>a<ARTICLE>b</article >c</Article>d</article><h1>T</h1>"
    r = page_articles(spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")).first()
    assert r["body_text"] == "a\nb\nc" and r["title"] == "T"
