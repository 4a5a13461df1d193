"""``urljoin(base, href)`` as a native column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
_AUTH = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_QUERY = "^[^?#]*(\\?[^#]*)"


def _remove_dot_segments(path: Column) -> Column:
    """RFC 3986 5.2.4 for an absolute path: one fold over its segments, whatever their number."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    folded = F.aggregate(
        F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    # a path that ends in a dot segment keeps its final slash
    kept = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def urljoin(base: Column, href: Column) -> Column:
    """The link that ``href`` means on the page ``base``; dot segments go from the path only."""
    scheme = F.regexp_extract(base, _SCHEME, 1)
    auth = F.regexp_extract(base, _AUTH, 1)
    path = F.regexp_extract(base, _PATH, 1)
    query = F.regexp_extract(base, _QUERY, 1)
    origin = F.concat(scheme, F.lit("://"), auth)
    base_dir = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "[^/]*$", "")
    own_path = F.regexp_extract(href, "^([^?#]*)", 1)
    rest = F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    return (
        F.when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, _remove_dot_segments(own_path), rest))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .when(href.startswith("#"), F.concat(origin, path, query, href))
        .when(href == "", base)
        .otherwise(F.concat(origin, _remove_dot_segments(F.concat(base_dir, own_path)), rest))
    )
