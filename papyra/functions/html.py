"""Regex-based HTML field extraction as native column expressions.

Stored pages are often malformed (unclosed ``<p>``, ``</p>`` inside scripts),
so script/style/comment blocks are removed first and elements are followed to
their own closing tags by a fold over the tags of their name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# HTML (ASCII) whitespace; used to collapse runs inside extracted text.
HTML_WS_RUN = "[ \\t\\n\\r\\f]+"
TAG_RE = "<[^>]*>"
NOISE_BLOCKS_RE = "(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->"
PARAGRAPH_OPEN_RE = "(?i)<p(?:\\s[^>]*)?>"


def tag_re(tag: str) -> str:
    """Regex of an opening tag."""
    return f"<{tag}\\b[^>]*>"


def class_re(css_class: str) -> str:
    """Regex of an opening tag with all classes of a selector such as ``teaser.clear``; group 1 is the tag's name."""
    classes = "".join(f"(?=[^\"']*(?<![\\w-]){c}(?![\\w-]))" for c in css_class.split("."))
    return f"<(\\w+)\\b[^>]*\\bclass\\s*=\\s*[\"']{classes}[^\"']*[\"'][^>]*>"


def element_inner(html: Column, open_re: str, tag: Column) -> Column:
    """Inner HTML of the first element that ``open_re`` opens, up to its own closing tag (elements of the same name
    may be nested); the rest of the page if it is never closed, null if there is none."""
    rest = F.regexp_extract(html, f"(?is){open_re}(.*)$", len(_groups(open_re)) + 1)
    # the pieces between tags of this name; the fold carries a depth and a length only, so it is linear in the page
    pieces = F.split(rest, F.concat(F.lit("(?i)(?=<"), tag, F.lit("\\b|</"), tag, F.lit("\\b)")))
    opening, closing = F.concat(F.lit("<"), F.lower(tag)), F.concat(F.lit("</"), F.lower(tag))
    heads = F.transform(pieces, lambda p: F.struct(F.lower(F.substring(p, F.lit(1), F.length(tag) + 2)).alias("head"),
                                                   F.length(p).alias("size")))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))

    def step(acc, p):
        depth = acc["depth"] + F.when(F.startswith(p["head"], closing), -1).when(F.startswith(p["head"], opening), 1).otherwise(0)
        return F.when(acc["depth"] == 0, acc).otherwise(F.struct(
            depth.alias("depth"), F.when(depth == 0, acc["size"]).otherwise(acc["size"] + p["size"]).alias("size")))

    inner = F.substring(rest, F.lit(1), F.aggregate(heads, start, step)["size"])
    return F.when(F.regexp_like(html, F.lit(f"(?is){open_re}")), inner)


def _groups(pattern: str) -> list:
    return [m for m in re.finditer(r"(?<!\\)\((?!\?)", pattern)]


def block(html: Column, tag: str) -> Column:
    """Inner HTML of the first ``<tag ...>`` element (null when absent)."""
    return element_inner(html, tag_re(tag), F.lit(tag))


def block_with_class(html: Column, css_class: str) -> Column:
    """Inner HTML of the first element with all classes of ``css_class`` (null when absent)."""
    open_re = class_re(css_class)
    return element_inner(html, open_re, F.regexp_extract(html, f"(?is){open_re}", 1))


# named entities of HTML 4, from the standard library; "amp" is decoded last so that "&amp;lt;" becomes "&lt;"
_KNOWN = ",".join(f"{n}:{p:X}" for n, p in sorted({**name2codepoint, "apos": 39}.items()) if n != "amp")


def _decoded(text: Column) -> Column:
    known = F.str_to_map(F.lit(_KNOWN), F.lit(","), F.lit(":"))   # one literal, folded once
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"), 1))

    def replaced(acc: Column, e: Column) -> Column:
        number = F.when(F.lower(F.substring(e, 1, 2)) == "#x", F.substring(e, 3, 9)) \
            .when(F.startswith(e, F.lit("#")), F.conv(F.substring(e, 2, 9), 10, 16)).otherwise(F.try_element_at(known, e))
        value = F.conv(number, 16, 10).cast("bigint")
        ok = value.isNotNull() & (value > 0) & (value <= 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
        return F.when(ok, F.replace(acc, F.concat(F.lit("&"), e, F.lit(";")),
                                    F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32"))).otherwise(acc)

    return F.replace(F.aggregate(found, text, replaced), F.lit("&amp;"), F.lit("&"))


def decode_entities(c: Column) -> Column:
    """Numeric and named character references; unknown ones stay."""
    # bound as a lambda's argument, so that ``c`` is computed once however often it is referred to
    return F.transform(F.array(c), lambda x: F.when(F.contains(x, F.lit("&")), _decoded(x)).otherwise(x))[0]


def inline_text(fragment: Column) -> Column:
    """``get_text(" ", strip=True)``: tags removed, entities decoded, whitespace collapsed."""
    no_tags = F.regexp_replace(fragment, TAG_RE, " ")
    return F.trim(F.regexp_replace(decode_entities(no_tags), HTML_WS_RUN, " "))


def nullif_empty(c: Column) -> Column:
    # bound as a lambda's argument, so that ``c`` is computed once
    return F.transform(F.array(c), lambda x: F.when(x != "", x))[0]


def strip_noise(html: Column) -> Column:
    return F.regexp_replace(html, NOISE_BLOCKS_RE, "")


def paragraphs(container: Column) -> Column:
    """Non-empty texts of the ``p`` elements of a container; a line break inside one is a space. An unclosed ``p``
    ends at the next one."""
    pieces = F.split(container, PARAGRAPH_OPEN_RE)
    inner = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
                        lambda p: F.regexp_replace(p, "(?is)</p\\b.*$", ""))
    return F.filter(F.transform(inner, inline_text), lambda p: p != "")


@dataclass(frozen=True)
class PageProfile:
    """Where the fields of a stored article page live.

    Teaser, category and date take a selector list; the first match in
    document order wins (``".cls"`` = any element with that class, several
    classes joined by dots = all of them, ``"tag"`` = such an element).
    Category and date are looked for inside ``info_class`` if it is given. The
    default profile fits pages whose body is an ``<article>`` with an
    ``<h1>``; ``newsroom`` mirrors press-release pages with ``#article-text``.
    """
    title_tag: str = "h1"
    body_tag: str = "article"
    body_id: str | None = None
    info_class: str | None = None
    teaser: tuple[str, ...] = (".teaser",)
    category: tuple[str, ...] = (".category",)
    date: tuple[str, ...] = (".date", "time")


def first_match(html: Column, selectors: tuple[str, ...]) -> Column:
    """Text of the selectors' first match in document order (null when there is none or it is empty)."""
    found = []
    for sel in selectors:
        open_re = class_re(sel[1:]) if sel.startswith(".") else tag_re(sel)
        inner = block_with_class(html, sel[1:]) if sel.startswith(".") else block(html, sel)
        at = F.regexp_instr(html, F.lit(f"(?is){open_re}"))
        found.append(F.struct(F.when(at > 0, at).otherwise(0x7FFFFFFF).alias("at"), inline_text(inner).alias("text")))
    return nullif_empty(F.array_min(F.array(*found))["text"]) if found else F.lit(None).cast("string")


DEFAULT_PROFILE = PageProfile()
# The press article layout: body `#article-text`; teaser `.teaser.clear` or
# `.teaser`; category `.category`, date `.date` or `time`, both inside `.article-info`.
NEWSROOM_PROFILE = PageProfile(body_tag="div", body_id="article-text", info_class="article-info",
                               teaser=(".teaser.clear", ".teaser"), category=(".category",), date=(".date", "time"))


def body_container(html: Column, profile: PageProfile) -> Column:
    """Body container inner HTML (the rest of the page if it is not closed), or null if the page has none."""
    if not profile.body_id:
        return block(html, profile.body_tag)
    open_re = f"<{profile.body_tag}\\b[^>]*\\bid\\s*=\\s*[\"']{profile.body_id}[\"'][^>]*>"
    return element_inner(html, open_re, F.lit(profile.body_tag))


@dataclass(frozen=True)
class ListingProfile:
    """Where listing entries and their links live on a listing page.

    ``nav`` fits the stored pages' navigation lists; ``newsfeed`` is the press
    listing layout (``article.newsfeed`` with a ``data-id`` and an ``h3`` link).
    With ``entry_tag`` the entries are the elements of that name whose opening
    tag matches ``entry_re``, each up to its own end, nested ones included.
    """
    container_re: str = "(?is)<nav\\b[^>]*>(.*?)</nav>"
    entry_re: str = "(?is)<li\\b[^>]*>(.*?)</li>"
    link_re: str = "(?is)<a\\b[^>]*?\\bhref\\s*=\\s*([\"'])(.*?)\\1"            # group 2: the link
    link_text_re: str = "(?is)<a\\b[^>]*?\\bhref\\s*=\\s*([\"']).*?\\1[^>]*>(.*?)</a>"   # group 2: its text
    id_re: str | None = None
    entry_tag: str | None = None


NAV_LISTING = ListingProfile()
# The press listing layout: entries are `article.newsfeed` elements
# carrying a `data-id`, each linking through `div.text h3 a[href]`.
NEWSFEED_LISTING = ListingProfile(
    entry_tag="article",
    entry_re="(?is)^<article\\b[^>]*\\bclass\\s*=\\s*[\"'][^\"']*(?<![\\w-])newsfeed(?![\\w-])[^\"']*[\"'][^>]*>",
    link_re="(?is)<div\\b[^>]*class=[\"'][^\"']*\\btext\\b[^\"']*[\"'][^>]*>.*?<h3\\b[^>]*>.*?<a\\b[^>]*?\\bhref=([\"'])(.*?)\\1",
    link_text_re="(?is)<h3\\b[^>]*>.*?<a\\b[^>]*?\\bhref=([\"']).*?\\1[^>]*>(.*?)</a>",
    id_re="(?is)^<article\\b[^>]*data-id=[\"']([^\"']*)[\"']",
)
