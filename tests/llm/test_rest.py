"""Decontamination, SentencePiece codec, nearest neighbours, WARC derivatives and the pipeline."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from papyra.llm import warc
from papyra.llm.ann import nearest
from papyra.llm.common import crc_mod
from papyra.llm.decontaminate import decontaminate
from papyra.llm.line_dedup import dedup_lines
from papyra.llm.sentencepieces import build_tokenizer, decode_ids, encode_texts, parse_model, read_model
from papyra.llm.warc import derive, read_warc, responses_of_pages, write_warc

from .helpers import LONG, SF, documents, linked_components, no_docs, odd_docs
from .test_dedup import keep_lines

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_hits(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[p:p + n]), set()).add(str(i) if i is not None else None)
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if ids := wins.get(tuple(w[p:p + n])):
                    hit.update(range(p, p + n))
                    found |= ids
        out.append((d, len(w), len(hit), sorted(found - {None})))
    return out


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short ITEM here"), (3, ""),
         (4, None), (None, "a lost line"), (5, "a a a a a a a a a a a a"), (5, "a a a a a a a a a a a a"), (6, "word")]


def key(rows):
    return sorted(rows, key=str)


def test_decontamination_brute_force(spark):
    rows = [(1, "x one two three four five six seven eight nine ten y " * 3), (2, "a " * 45 + "b " + "a " * 9),
            (3, "nothing short item here? SHORT item-here"), (4, None), (5, ""), (None, "a lost line, a lost line"),
            (6, "three four five six seven eight nine ten eleven twelve"), (6, "again word"), (7, "1 2 3 4 5 6 7 8 9 0"),
            (8, LONG + "one two three four five six seven eight nine ten")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontaminate(docs, items).collect()]
    assert key(got) == key(brute_hits(rows, ITEMS))


def test_decontamination_sf(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = documents(spark)
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontaminate(docs, bench).collect()]
    want = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert key(got) == key(want)


def test_decontamination_odd_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate(odd_docs(spark).withColumnRenamed("lang", "words"), items).count() == 11
    assert decontaminate(no_docs(spark), items).count() == 0
    assert decontaminate(odd_docs(spark), items.limit(0)).where("n_hit > 0").count() == 0


def test_tokens_match_the_sentencepiece_library(spark):
    import sentencepiece
    raw = read_model()
    reference = sentencepiece.SentencePieceProcessor(model_proto=raw)
    extra = spark.createDataFrame([(-1, "  two  spaces\n\nx "), (-2, " "), (-3, "\n"), (-4, "a</s>b <0x0A> ▁ c"),
                                   (-5, "\ttab 日本 \U0001F600")], "doc_id long, text string")
    odd = odd_docs(spark).selectExpr("doc_id + 1000000 as doc_id", "text")
    docs = documents(spark).select("doc_id", "text").union(extra).union(odd)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = encode_texts(docs, raw)
    for r in rows.collect():
        if r.doc_id is None:
            continue
        t = texts[r.doc_id]
        assert r.ids == (None if t is None else reference.encode(t)) and r.parity
        assert r.round_trip == ("▁" not in (t or ""))
    back = {r.doc_id: r.text for r in decode_ids(rows.select("doc_id", "ids"), raw).collect()}
    assert all(back[i] == t for i, t in texts.items() if i is not None and "▁" not in (t or ""))
    whole = build_tokenizer(parse_model(raw))
    assert whole.encode("  two  spaces", add_special_tokens=False).ids == reference.encode("  two  spaces")


def test_tokens_odd_rows(spark):
    raw = read_model()
    assert encode_texts(odd_docs(spark).withColumnRenamed("lang", "ids"), raw, ids=False).count() == 11
    assert encode_texts(no_docs(spark), raw).count() == 0


def brute_nearest(rows, every=50, k=5):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v) and np.any(np.array(v, float))]
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted((-(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), j) for j, w in good if j != i)[:k]
            out[i] = [j for _, j in near]
    return out


def test_nearest_recall_and_copies(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {}
    for r in nearest(spark.read.parquet(f"{SF}/embeddings.parquet")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_nearest(rows)
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))
    # a third of the rows are one vector
    copies = [(1000 + i, rows[0][1]) for i in range(250)]
    docs = spark.createDataFrame(rows + copies, "vec_id long, embedding array<float>")
    near = nearest(docs).where("query_id = 1000").orderBy("rank").collect()
    assert [r.vec_id for r in near] == [rows[0][0], 1001, 1002, 1003, 1004] and all(abs(r.score - 1) < 1e-12 for r in near)


def test_nearest_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, [nan, 1.0]), (200, [1.0, None]), (1, [2.0, 0.0]),
            (1, [2.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0]), (3, [1.0]), (4, [float("inf"), 1.0]), (250, [])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(docs).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]
    assert nearest(docs.limit(0)).count() == 0


PAGE = ('<!DOCTYPE html><html lang="EN"><head><title>A &amp; B</title><script>var x="<p>no</p>";</script></head>'
        "<body><!-- <a href='/no'>no</a> --><p>One<br>two  <b>three</b></p><a href='/x?a=1&amp;b=2'>link</a>"
        '<a href="http://o.example/">other</a></body></html>')


def test_warc_records(spark, tmp_path):
    rows = [(1, "http://h.example/d/", PAGE), (1, "http://h.example/d/", PAGE), (2, None, None), (None, "http://e/", ""),
            (3, "http://h.example/long", "<p>" + LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = derive(responses_of_pages(pages))
    got = made.collect()
    assert len(got) == 10
    for r in got:
        (head, block), = read_warc(bytes(r.record))
        assert block == bytes(r.block) and int(head["Content-Length"]) == len(block)
        assert head["WARC-Refers-To"] == r.identifier and head["WARC-Type"] == r.kind
        assert head["WARC-Block-Digest"] == r.block_digest == warc.digest(block)
        assert ("WARC-Target-URI" in head) == (r.target is not None)
    text = next(r for r in got if r.source_key == 1 and r.kind == "conversion")
    notes = next(r for r in got if r.source_key == 1 and r.kind == "metadata")
    assert bytes(text.block).decode() == "One\ntwo three\nlinkother" and text.title == "A & B" and text.lang == "en"
    assert notes.links == ["http://h.example/x?a=1&b=2", "http://o.example/"]
    assert b"outlink: http://o.example/\r\n" in bytes(notes.block)
    assert notes.source_payload_digest == warc.digest(PAGE.encode())
    files = write_warc(made, tmp_path.as_uri()).collect()
    stored = [x for f in files for x in read_warc((tmp_path / f["file"]).read_bytes() or b"")] if files else []
    assert sorted(h["WARC-Record-ID"] for h, _ in stored) == sorted(r.record_id for r in got)
    assert derive(responses_of_pages(pages.limit(0))).count() == 0


def test_warc_source_headers():
    block = (b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=latin-1\r\nX-A: b\r\n\r\n"
             + "<p>caf\xe9".encode("latin-1"))
    made = warc.derivatives("<urn:uuid:1>", "http://a/", "2020-01-01T00:00:00Z",
                            {"WARC-IP-Address": "1.2.3.4", "WARC-Payload-Digest": "sha1:X"}, block)
    (_, _, notes, head, _), (_, _, text, _, _) = made
    assert ("WARC-IP-Address", "1.2.3.4") in head and ("WARC-Source-Payload-Digest", "sha1:X") in head
    assert b"http-status: 404" in notes and b"http-header-x-a: b" in notes and text.decode() == "caf\xe9"


def test_warc_damaged_coding():
    made = warc.derivatives("<urn:uuid:1>", None, warc.DATE, {}, b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n<p>x")
    assert made[1][2] == b"x"


def test_pipeline_against_brute_force(spark):
    docs = documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = stages["line dedup"](spark, docs, SF).collect()
    lines = {i: t for i, t in keep_lines(rows).items() if t.strip(" ") or t == dict(rows)[i]}
    assert {r.doc_id: r.text for r in kept} == lines
    one = stages["n-gram Jaccard join"](spark, docs, SF).collect()
    assert {r.doc_id for r in one} == {i for i, c in linked_components(dict(rows)).items() if i == c}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stages["benchmark decontamination"](spark, docs, SF).collect()
    assert {r.doc_id for r in clean} == {d for d, _, n, _ in brute_hits(rows, bench) if not n}
    out = corpus_pipeline.run(spark, SF)
    got = out.collect()
    assert got and all(r.parity for r in got) and {r.doc_id for r in got} <= {i for i, _ in rows}
    assert all(hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() == r.ids_sha256 for r in got)


def test_pipeline_odd_rows(spark):
    docs = odd_docs(spark).selectExpr("*", "length(text) as n_chars", "'x' as n_words", "1 as _t")
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
        docs.count()
    empty = no_docs(spark).selectExpr("*", "length(text) as n_chars")
    for _, step in corpus_pipeline.STAGES:
        empty = step(spark, empty, SF)
        assert empty.count() == 0


@pytest.mark.parametrize("name", ["op2_line_dedup", "op10_benchmark_decontamination"])
def test_sql_agrees(spark, name):
    import duckdb

    from papyra.llm.queries import ORACLE, QUERIES
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    by = ["doc_id"]
    assert got.sort_values(by).values.tolist() == want.sort_values(by).values.tolist()


def test_crc(spark):
    df = spark.range(50).withColumn("m", crc_mod(F.col("id"), 7))
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 7 for r in df.collect())


def test_tokens_of_texts_with_markers(spark):
    """A literal U+2581 before a space or at the beginning makes one piece with it."""
    import sentencepiece
    raw = read_model()
    reference = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["foo▁  bar", "▁ 1", "▁", "▁▁  ▁ x", "a ▁ b▁\n▁ c", " ▁", "▂ x", "plain words"]
    rows = encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), raw).collect()
    assert len(rows) == len(texts) and all(r.ids == reference.encode(texts[r.doc_id]) and r.parity for r in rows)


def test_tokens_parity_is_of_whole_texts():
    """A wrong cut shows."""
    from papyra.llm.sentencepieces import Codec
    codec = Codec(read_model())
    data = np.frombuffer("foo▁  bar".encode(), np.uint8)
    offsets = np.array([0, len(data)])
    assert codec.agrees(data, offsets, np.array([19222, 259, 2843], np.int32), np.array([0, 3])).tolist() == [True]
    cut = np.array([19222, 28705, 28705, 2843], np.int32)
    assert codec.agrees(data, offsets, cut, np.array([0, 4])).tolist() == [False]


def test_warc_all_source_headers():
    source = {"WARC-Truncated": "length", "WARC-Warcinfo-ID": "<urn:uuid:9>", "WARC-Block-Digest": "sha1:B",
              "warc-ip-address": "1.2.3.4", "WARC-Payload-Digest": "sha1:X"}
    made = warc.derivatives("<urn:uuid:1>", "http://a/", warc.DATE, source, b"HTTP/1.1 200 OK\r\n\r\n<p>x")
    for _, _, content, head, facts in made:
        assert ("WARC-Truncated", "length") in head and ("WARC-IP-Address", "1.2.3.4") in head
        assert dict(head)["WARC-Block-Digest"] == warc.digest(content) and facts["payload"] == "sha1:X"
    lines = made[0][2].decode().split("\r\n")
    assert {f"warc-header-{k.lower()}: {v}" for k, v in source.items()} <= set(lines)


def test_pipeline_near_duplicates_by_row(spark):
    """Rows that repeat an id, rows without an id, equal rows."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (2, a + " more", "en", "s", 1), (2, b, "en", "s", 1), (3, c, "en", "t", 1),
            (3, c, "en", "s", 1), (None, a + " end", "en", "s", 1), (None, "one alone", "en", "s", 1),
            (None, "One  alone", "en", "s", 1), (4, "", "en", "s", 1), (4, "", "en", "s", 1), (None, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted((tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    one = [r for r in left if (r[1] or "").lower().split() == ["one", "alone"]]
    assert len(one) == 1 and one[0] in rows
    assert [r for r in left if r not in one] == sorted(
        [rows[0], rows[2], rows[4], rows[8], rows[9], rows[10]], key=str)


CLASHES = ["_t", "_id", "_covered", "_lines", "_mid", "_mt", "_h", "_hid", "_ht", "_text", "_words", "_sid", "_st", "_n", "_c0", "_c1",
           "at", "pos", "fp", "n", "window", "covered", "words", "n_lines", "n_removed", "n_spans", "n_words", "n_hit", "item_ids"]


def test_extra_columns_with_the_names_of_the_operators(spark):
    """Every internal and output name as a column of the documents: same results, own values kept."""
    from papyra.llm.decontaminate import ADDED as HITS
    from papyra.llm.line_dedup import ADDED as LINES
    docs = documents(spark).limit(60).select("doc_id", "text")
    clash = docs.select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in CLASHES])
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for added, run in ((LINES, dedup_lines), (HITS, lambda d: decontaminate(d, bench))):
        want = {r.doc_id: r for r in run(docs).collect()}
        got = run(clash).collect()
        assert len(got) == len(want)
        for r in got:
            assert all(r[c] == want[r.doc_id][c] for c in ["text", *added])
            assert all(r[f"_own_{c}" if c in added else c] == f"{c}-{r.doc_id}" for c in CLASHES)
    step = dict(corpus_pipeline.STAGES)["benchmark decontamination"]
    wide = documents(spark).limit(60)
    more = wide.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    assert sorted(r.doc_id for r in step(spark, more, SF).collect()) == sorted(r.doc_id for r in step(spark, wide, SF).collect())
