"""WARC derivatives: response records to linked metadata and plain-text conversion records.

``responses_of_pages`` gives stored pages the shape of WARC responses; ``derive`` turns every response into a metadata
record (``application/warc-fields``: status, source headers, title, language, outlinks) and a conversion record
(``text/plain``). All WARC headers of the response are fields of the metadata record (``warc-header-...``), beside its
HTTP headers. Both refer to the response by identifier, target and date, carry over its address headers, payload digest
and truncation, and hold the digest of their own block. Identifiers are uuids derived from the response's, so a rerun or a
retried task makes the same records. ``write_warc`` stores records as ``.warc.gz`` files (one gzip member a record)
and ``read_warc`` reads such bytes back.

A null or empty page is a response with an empty body: its conversion is empty and its metadata names no links. A
null url leaves the target headers out. Rows that repeat give the same records again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
CRLF = "\r\n"
# source headers that a derivative repeats
CARRIED = ("WARC-IP-Address", "WARC-Identified-Payload-Type", "WARC-Truncated")
DATE = "1970-01-01T00:00:00Z"  # stored pages have no capture time

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)"
                    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title|\Z)", re.S | re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w-]+)", re.I)
_BLANK = re.compile(r"[^\S\n]+")
BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th "
                   "thead title tr ul".split())


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(parts))}>"


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}{CRLF}" for k, v in headers)
    return f"WARC/1.1{CRLF}{head}Content-Length: {len(block)}{CRLF}{CRLF}".encode() + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of plain or gzipped WARC bytes."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP message (no header part: all body)."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split(CRLF)
    headers = [(k.strip(), v.strip()) for k, sep, v in (x.partition(":") for x in lines[1:]) if sep]
    return lines[0], headers, body


def body_text(headers: list[tuple[str, str]], body: bytes) -> str:
    """The body as text: content coding undone, charset from the headers or the page, else UTF-8."""
    named = {k.lower(): v for k, v in headers}
    coding = named.get("content-encoding", "").lower()
    if coding in ("gzip", "deflate"):
        try:
            body = gzip.decompress(body) if coding == "gzip" else zlib.decompress(body)
        except (OSError, EOFError, zlib.error):  # a damaged body is kept as it is
            pass
    found = _CHARSET.search(named.get("content-type", "")) or _CHARSET.search(body[:2048].decode("latin-1"))
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def page_parts(page: str, base: str | None) -> tuple[str, str, str, list[str]]:
    """(title, language, plain text, links) of a page; block elements break lines, scripts and comments go."""
    out: list[str] = []
    links: list[str] = []
    at = 0
    in_title = False
    for m in _TOKEN.finditer(page):
        if m.start() > at and not in_title:
            out.append(page[at:m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if name == "title":
            in_title = not m[2]
        if name in BLOCKS:
            out.append("\0")
        elif name == "a" and not m[2] and (h := _HREF.search(m[4])):
            href = html.unescape(next(x for x in h.groups() if x is not None)).strip()
            try:
                links.append(urljoin(base or "", href))
            except ValueError:
                links.append(href)
    if not in_title:
        out.append(page[at:])
    text = html.unescape("".join(x if x == "\0" else x.replace("\0", " ").replace("\n", " ") for x in out))
    lines = (_BLANK.sub(" ", x).strip() for x in text.replace("\n", " ").replace("\0", "\n").split("\n"))
    title, lang = _TITLE.search(page), _LANG.search(page)
    return (_BLANK.sub(" ", html.unescape(title[1]).replace("\n", " ")).strip() if title else "",
            lang[1].lower() if lang else "", "\n".join(x for x in lines if x), links)


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def derivatives(identifier: str, target: str | None, date: str, source: dict[str, str], block: bytes
                ) -> list[tuple[str, str, bytes, list[tuple[str, str]], dict]]:
    """[(type, record id, block, headers, facts)] of one response: its metadata and its conversion record."""
    status, headers, body = split_http(block)
    title, lang, text, links = page_parts(body_text(headers, body), target)
    fields = [("http-status", status.split(" ")[1] if status.count(" ") else "")]
    fields += [(f"warc-header-{k.lower()}", v) for k, v in source.items()]
    fields += [(f"http-header-{k.lower()}", v) for k, v in headers]
    fields += [("title", title), ("language", lang), *(("outlink", x) for x in links)]
    notes = "".join(f"{k}: {_one_line(v)}{CRLF}" for k, v in fields if v).encode("utf-8", "replace")
    named = {k.lower(): v for k, v in source.items()}  # names of headers have no case
    payload = named.get("warc-payload-digest") or digest(body)
    made = []
    for kind, media, content in (("metadata", "application/warc-fields", notes),
                                 ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        own = record_id(identifier, kind)
        head = [("WARC-Type", kind), ("WARC-Record-ID", own)]
        head += [("WARC-Target-URI", _one_line(target))] if target else []
        head += [("WARC-Date", date), ("WARC-Refers-To", identifier)]
        head += [("WARC-Refers-To-Target-URI", _one_line(target))] if target else []
        head += [("WARC-Refers-To-Date", date)]
        head += [(k, _one_line(named[k.lower()])) for k in CARRIED if named.get(k.lower())]
        head += [("WARC-Source-Payload-Digest", payload), ("WARC-Block-Digest", digest(content)), ("Content-Type", media)]
        made.append((kind, own, content, head, {"title": title, "lang": lang, "links": links, "payload": payload}))
    return made


def responses_of_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html",
                       date: str = DATE) -> DataFrame:
    """(source_key, identifier, target, date, source, block): stored pages as WARC responses."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                ids, blocks = [], []
                for k, u, h in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    body = (h or "").encode()
                    head = (f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
                            f"Content-Length: {len(body)}{CRLF}{CRLF}").encode()
                    ids.append(record_id("response", str(k), u or ""))
                    blocks.append(head + body)
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids), part.column(1).cast(pa.string()), pa.array([date] * n),
                     pa.array([[]] * n, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary())],
                    ["source_key", "identifier", "target", "date", "source", "block"])

    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(page).alias("h"))
    return rows.mapInArrow(run, f"source_key {dict(rows.dtypes)['k']}, identifier string, target string, date string, "
                                "source map<string,string>, block binary")


DERIVED = ("identifier string, kind string, record_id string, target string, date string, title string, lang string, "
           "links array<string>, source_payload_digest string, block_digest string, block binary, record binary")


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response (source_key, identifier, target, date, source, block): see ``DERIVED``."""
    kind = dict(responses.dtypes)["source_key"]
    names = ["source_key", *(x.split()[0] for x in DERIVED.split(", "))]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                rows = []
                for key, ident, target, date, source, block in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    made = derivatives(ident, target, date or DATE, dict(source or []), block or b"")
                    rows += [(key, ident, k, own, target, date, f["title"], f["lang"], f["links"], f["payload"],
                              digest(content), content, serialise(head, content)) for k, own, content, head, f in made]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], part.column(0).type), *(pa.array(c, pa.string()) for c in columns[1:8]),
                     pa.array(columns[8], pa.list_(pa.string())), *(pa.array(c, pa.string()) for c in columns[9:11]),
                     *(pa.array(c, pa.binary()) for c in columns[11:])], names)

    rows = responses.select("source_key", "identifier", "target", "date", "source", "block")
    return rows.mapInArrow(run, f"source_key {kind}, {DERIVED}")


def write_warc(records: DataFrame, uri: str, column: str = "record") -> DataFrame:
    """Write serialised records as one ``.warc.gz`` file a partition below ``uri``; returns (file, records, bytes).

    ``uri`` must be storage that all executors share (any file system of pyarrow.fs). A file is written under the
    partition's number, so a task that runs again replaces its file by the same one.
    """
    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        n = size = 0
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                for record in batch.column(0).to_pylist():
                    member = gzip.compress(record, mtime=0)
                    out.write(member)
                    n, size = n + 1, size + len(member)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())],
                                         ["file", "records", "bytes"])

    return records.select(column).mapInArrow(run, "file string, records long, bytes long")
