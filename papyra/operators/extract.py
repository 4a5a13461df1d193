"""Extraction of article records from stored HTML pages.

One distributed job over the page table instead of one DOM parse per page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions import html as H
from papyra.functions.dates import malformed_date, normalise_date
from papyra.functions.urls import urljoin


def page_articles(pages: DataFrame, profile: H.PageProfile = H.DEFAULT_PROFILE,
                  strict_dates: bool = False) -> DataFrame:
    """One article record per page.

    Columns: page_id, url, title, date_raw (yyyyMMdd), date_malformed, category,
    teaser, text_kind ('array' | 'string' | null), paragraphs ARRAY<STRING>,
    body_text (string fallback when the container has no paragraphs).
    """
    # staged projections: the cleaned page and the body are each computed once
    # per row (an expression referenced by several fields would otherwise be
    # inlined into each of them)
    staged = pages.select("page_id", "url", H.strip_noise(F.col("html")).alias("_h"))
    html = F.col("_h")
    container = H.body_container(html, profile)
    # the title heading belongs to the header, not to the body text
    body = F.regexp_replace(F.col("_container"), f"(?is)<{profile.title_tag}\\b.*?</{profile.title_tag}>", "")
    info = H.block_with_class(html, profile.info_class) if profile.info_class else html
    staged = staged.select("page_id", "url", "_h", info.alias("_info"), container.alias("_container"))
    staged = staged.select(
        "page_id", "url",
        H.nullif_empty(H.inline_text(H.block(html, profile.title_tag))).alias("title"),
        H.first_match(F.col("_info"), profile.date).alias("_date"),
        H.first_match(F.col("_info"), profile.category).alias("category"),
        H.first_match(html, profile.teaser).alias("teaser"),
        F.col("_container").isNotNull().alias("_has_body"),
        body.alias("_body"))
    staged = staged.withColumn("_has_p", F.col("_body").rlike("(?i)<p(\\s[^>]*)?>"))
    body = F.col("_body")
    has_p = F.col("_has_p")
    # get_text("\n", strip=True): every text piece between tags, stripped, non-empty
    pieces = F.filter(F.transform(F.split(body, H.TAG_RE), H.inline_text), lambda p: p != "")
    fallback = H.nullif_empty(F.array_join(pieces, "\n"))
    has_body = F.col("_has_body")
    out = staged.select(
        "page_id", "url", "title",
        normalise_date(F.col("_date")).alias("date_raw"),
        malformed_date(F.col("_date")).alias("date_malformed"),
        "category", "teaser",
        F.when(~has_body, F.lit(None).cast("string"))
         .when(has_p, F.lit("array")).otherwise(F.lit("string")).alias("text_kind"),
        F.when(has_body & has_p, H.paragraphs(body)).alias("paragraphs"),
        F.when(has_body & ~has_p, fallback).alias("body_text"),
    )
    if strict_dates:
        out = out.withColumn("date_raw", F.when(F.col("date_malformed") == 1,
                                                F.raise_error(F.lit("malformed article date")))
                             .otherwise(F.col("date_raw")))
    return out


def page_paragraphs(articles: DataFrame) -> DataFrame:
    """One row per (page, paragraph position)."""
    return articles.select("page_id", F.posexplode("paragraphs").alias("pos", "paragraph")) \
        .withColumn("pos", F.col("pos").cast("bigint"))


def _listed_elements(pages: DataFrame, listing: H.ListingProfile) -> DataFrame:
    """(page_id, url, pos, entry): the elements whose opening tag matches, in document order, each up to its own end."""
    from papyra.operators.elements import element_intervals
    clean = pages.select("page_id", "url", H.strip_noise(F.col("html")).alias("html"))
    found = element_intervals(clean, listing.entry_tag).where(F.col("open_tag").rlike(listing.entry_re))
    spans = found.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pre", "start", "inner_end"))).alias("spans"))
    span = F.posexplode("spans").alias("pos", "span")
    return clean.join(spans, "page_id").select("page_id", "url", "html", span).select(
        "page_id", "url", "pos", F.substring("html", F.col("span.start") + 1, F.col("span.inner_end") - F.col("span.start"))
        .alias("entry"))


def listing_links(pages: DataFrame, listing: H.ListingProfile = H.NAV_LISTING,
                  base_url: str | None = None, max_n: int | None = None) -> DataFrame:
    """Entries of each listing page with their resolved link.

    ``pos`` counts every entry of all containers, including those without a
    link (which are dropped), so positions have gaps; with ``max_n`` only the
    first entries are processed (E4). Comments and scripts are removed first.
    The base URL is the page's own URL unless ``base_url`` is given.
    """
    if listing.entry_tag:
        e = _listed_elements(pages, listing)
    else:
        containers = F.regexp_extract_all(H.strip_noise(F.col("html")), F.lit(listing.container_re), 1)
        entries = F.flatten(F.transform(containers, lambda c: F.regexp_extract_all(c, F.lit(listing.entry_re), 1)))
        e = pages.select("page_id", "url", F.posexplode(entries).alias("pos", "entry"))
    if max_n is not None:
        e = e.where(F.col("pos") < max_n)
    # stage the extracted href: urljoin refers to it in many branches
    staged = e.where(F.col("entry").rlike(listing.link_re)).select(
        "page_id", "url", "pos", "entry",
        F.trim(H.decode_entities(F.regexp_extract(F.col("entry"), listing.link_re, 2))).alias("href"))
    base = F.lit(base_url) if base_url else F.col("url")
    cols = [
        "page_id", F.col("pos").cast("bigint").alias("pos"),
        H.inline_text(F.regexp_extract(F.col("entry"), listing.link_text_re, 2)).alias("title"),
        "href",
        urljoin(base, F.col("href")).alias("link"),
    ]
    if listing.id_re:
        cols.append(H.nullif_empty(F.regexp_extract(F.col("entry"), listing.id_re, 1)).alias("article_id"))
    return staged.select(*cols)
