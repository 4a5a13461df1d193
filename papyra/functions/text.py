"""Column expressions for paragraph cleaning, teaser cleaning and answer extraction.

All are native Spark expressions (higher-order functions over arrays, regex
predicates), so they run inside the JVM without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip()/str.isspace() whitespace set (29 code points), generated
# by rule so Spark's btrim matches Python's strip exactly.
PY_WS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())

# The paragraph filters of the cleaning step, as Python regexes.
URL_PATTERN = r"http[s]?://|www\.\S+"
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_PATTERN = r"\+\d{1,3}"
# Teaser marker removed by the teaser cleaner; template markers.
TEASER_MARK = "+++"
TITLE_TAG, TEASER_TAG, TEXT_TAG = "<TITLE>: ", "<TEASER>: ", "<TEXT>: "

# Lexical token pattern used for vocabularies, LM counts and embedding lookup.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def _java_class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


def to_java_regex(py_pattern: str) -> str:
    """Python `re` pattern -> Java regex with Python's Unicode semantics.

    ``(?U)`` makes \\w, \\d, \\b Unicode-aware as in Python 3; \\S is spelled out
    as the complement of Python's whitespace set because Java's Unicode
    White_Space differs from str.isspace() on U+001C..U+001F.
    """
    p = py_pattern.replace(r"\S", f"[^{_java_class(PY_WS)}]")
    p = p.replace(r"\s", f"[{_java_class(PY_WS)}]")
    return "(?U)" + p


URL_RE = to_java_regex(URL_PATTERN)
EMAIL_RE = to_java_regex(EMAIL_PATTERN)
PHONE_RE = to_java_regex(PHONE_PATTERN)
WS_RUN_RE = f"[{_java_class(PY_WS)}]+"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` (Unicode whitespace, both ends)."""
    return F.btrim(c, F.lit(PY_WS))


def keep_paragraph(p: Column) -> Column:
    """A paragraph survives unless it holds a URL, e-mail or phone number."""
    return ~(p.rlike(URL_RE) | p.rlike(EMAIL_RE) | p.rlike(PHONE_RE))


def clean_paragraph(p: Column, ws_mode: str = "parity") -> Column:
    """C4 (parity): drop LF and CR, one pass of double->single space, strip.

    C12 (``ws_mode="collapse"``): every whitespace run becomes one space.
    """
    if ws_mode == "collapse":
        return py_strip(F.regexp_replace(p, WS_RUN_RE, " "))
    no_breaks = F.replace(F.replace(p, F.lit("\n"), F.lit("")), F.lit("\r"), F.lit(""))
    return py_strip(F.replace(no_breaks, F.lit("  "), F.lit(" ")))


def filter_paragraphs(arr: Column) -> Column:
    """C1-C3 over an array of paragraphs (null elements dropped)."""
    return F.filter(arr, lambda p: p.isNotNull() & keep_paragraph(p))


def clean_paragraphs(arr: Column, ws_mode: str = "parity") -> Column:
    """Filtered and cleaned paragraphs (emptied ones kept)."""
    return F.transform(filter_paragraphs(arr), lambda p: clean_paragraph(p, ws_mode))


def clean_text(arr: Column, ws_mode: str = "parity") -> Column:
    """Cleaned paragraphs merged with one space (empty pieces kept)."""
    return F.array_join(clean_paragraphs(arr, ws_mode), " ")


def clean_teaser(t: Column, ws_mode: str = "parity") -> Column:
    """Drop the marker, one double-space pass, strip; null and '' pass through."""
    if ws_mode == "collapse":
        body = py_strip(F.regexp_replace(F.replace(t, F.lit(TEASER_MARK), F.lit("")), WS_RUN_RE, " "))
    else:
        body = py_strip(F.replace(F.replace(t, F.lit(TEASER_MARK), F.lit("")), F.lit("  "), F.lit(" ")))
    return F.when(t.isNull() | (t == ""), t).otherwise(body)


def is_falsy_str(c: Column) -> Column:
    return c.isNull() | (c == "")


def template(title: Column, teaser: Column, text: Column) -> Column:
    """C11: the training-sample template; a null teaser prints as ``None``."""
    return F.concat(F.lit(TITLE_TAG), title, F.lit("\n" + TEASER_TAG),
                    F.coalesce(teaser, F.lit("None")), F.lit("\n" + TEXT_TAG), text)


def extract_answer(full_text: Column) -> Column:
    """V2: text after the *first* ``A:``, stripped, first line; else first line of the whole."""
    pos = F.instr(full_text, "A:")
    tail = F.when(pos > 0, full_text.substr(pos + 2, F.length(full_text) + 1)).otherwise(full_text)
    return F.element_at(F.split(py_strip(tail), "\n"), 1)


def tokens(text: Column) -> Column:
    """Lexical tokens of lower-cased text, in order (whole text)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)
