"""DuckDB restatements of the registered queries (the correctness oracle).

Each query is built from shared CTE snippets that restate the fixture views of
``papyra.plans.views``. RE2 (DuckDB) regexes are ASCII-only; the fixtures hold
no input where that differs from the Unicode-aware Spark patterns.
"""

from __future__ import annotations

from papyra import DEFAULT_MODELS, DEFAULT_SEED
from papyra.functions.text import EMAIL_PATTERN, PHONE_PATTERN, PY_WS, URL_PATTERN

PYWS_SQL = "(" + "||".join(f"chr({ord(c)})" for c in PY_WS) + ")"
NL = "chr(10)"

MODELS_SQL = " UNION ALL ".join(f"SELECT '{m}' AS model, {i}::BIGINT AS model_pos"
                                for i, m in enumerate(DEFAULT_MODELS))

CTE = {}

CTE["articles"] = f"""
articles AS (
  SELECT doc_id AS idx, CAST(doc_id AS VARCHAR) AS article_id, l[1] AS title,
         CASE WHEN len(l) > 2 THEN l[2] END AS teaser,
         CASE WHEN len(l) > 2 THEN list_slice(l, 3, len(l))
              WHEN len(l) = 2 THEN [l[2]] ELSE []::VARCHAR[] END AS text
  FROM (SELECT doc_id, string_split(text, {NL}) AS l FROM documents)
)"""

_KEEP = " AND ".join(f"NOT regexp_matches(p, '{pattern}')" for pattern in (URL_PATTERN, EMAIL_PATTERN, PHONE_PATTERN))
_CLEAN_P = f"trim(replace(replace(replace(p, {NL}, ''), chr(13), ''), '  ', ' '), {PYWS_SQL})"
_CLEAN_T = (f"CASE WHEN teaser IS NULL OR teaser = '' THEN teaser "
            f"ELSE trim(replace(replace(teaser, '+++', ''), '  ', ' '), {PYWS_SQL}) END")

CTE["assessed"] = f"""
cleaned AS (
  SELECT idx, article_id, title, teaser, text, {_CLEAN_T} AS teaser_clean,
         array_to_string(list_transform(list_filter(text, lambda p: p IS NOT NULL AND {_KEEP}),
                                        lambda p: {_CLEAN_P}), ' ') AS text_clean
  FROM articles
),
assessed AS (
  SELECT *, CASE WHEN idx IS NULL OR idx = 0 THEN 'idx'
                 WHEN article_id IS NULL OR article_id = '' THEN 'article_id'
                 WHEN title IS NULL OR title = '' THEN 'title'
                 WHEN text_clean IS NULL OR text_clean = '' THEN 'text' END AS omit_reason
  FROM cleaned
)"""

CTE["samples"] = f"""
samples AS (
  SELECT idx, article_id,
         '<TITLE>: ' || title || {NL} || '<TEASER>: ' || coalesce(teaser_clean, 'None') || {NL}
         || '<TEXT>: ' || text_clean AS x
  FROM assessed WHERE omit_reason IS NULL
)"""

CTE["models"] = f"""
models AS ({MODELS_SQL})"""

DEPS = {"assessed": ["articles"], "samples": ["assessed"]}


def with_ctes(*names: str) -> str:
    order: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    return "WITH " + ",".join(CTE[n] for n in order) + "\n"


def sql(names, body: str) -> str:
    return with_ctes(*names) + body


ORACLE: dict[str, str] = {}

ORACLE["training_samples"] = sql(["samples"], "SELECT idx, article_id, x FROM samples")

ORACLE["clean_articles"] = sql(["assessed"], """
SELECT idx, article_id, teaser_clean, text_clean, len(text)::BIGINT AS n_paragraphs
FROM assessed""")

ORACLE["omission_report"] = sql(["assessed"], """
SELECT coalesce(omit_reason, 'kept') AS reason, count(*)::BIGINT AS n FROM assessed GROUP BY 1""")

# ---- C1-C4 paragraph report, C12 collapse mode ---------------------------------------
_URL = "'http[s]?://|www\\.\\S+'"
_EMAIL = "'\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b'"
_PHONE = "'\\+\\d{1,3}'"
RE2_WS_RUN = "'[" + "".join(f"\\x{{{ord(c):x}}}" for c in PY_WS) + "]+'"

ORACLE["clean_paragraphs"] = sql(["articles"], f"""
SELECT idx, len(text)::BIGINT AS n_in,
  len(list_filter(text, lambda p: regexp_matches(p, {_URL})))::BIGINT AS n_url,
  len(list_filter(text, lambda p: NOT regexp_matches(p, {_URL}) AND regexp_matches(p, {_EMAIL})))::BIGINT AS n_email,
  len(list_filter(text, lambda p: NOT regexp_matches(p, {_URL}) AND NOT regexp_matches(p, {_EMAIL})
                                  AND regexp_matches(p, {_PHONE})))::BIGINT AS n_phone,
  len(kept)::BIGINT AS n_kept,
  len(list_filter(kept, lambda p: p = ''))::BIGINT AS n_emptied,
  coalesce(list_sum(list_transform(kept, lambda p: length(p))), 0)::BIGINT AS kept_chars
FROM (SELECT idx, text, list_transform(list_filter(text, lambda p: p IS NOT NULL AND {_KEEP}),
                                      lambda p: {_CLEAN_P}) AS kept FROM articles)""")

_COLLAPSE_P = f"trim(regexp_replace(p, {RE2_WS_RUN}, ' ', 'g'), {PYWS_SQL})"
_COLLAPSE_T = (f"CASE WHEN teaser IS NULL OR teaser = '' THEN teaser "
               f"ELSE trim(regexp_replace(replace(teaser, '+++', ''), {RE2_WS_RUN}, ' ', 'g'), {PYWS_SQL}) END")
ORACLE["clean_collapse_ws"] = sql(["articles"], f"""
SELECT idx, article_id,
       '<TITLE>: ' || title || {NL} || '<TEASER>: ' || coalesce(tc, 'None') || {NL} || '<TEXT>: ' || xc AS x
FROM (SELECT *, {_COLLAPSE_T} AS tc,
             array_to_string(list_transform(list_filter(text, lambda p: p IS NOT NULL AND {_KEEP}),
                                            lambda p: {_COLLAPSE_P}), ' ') AS xc FROM articles)
WHERE NOT (idx IS NULL OR idx = 0 OR article_id IS NULL OR article_id = '' OR title IS NULL
           OR title = '' OR xc IS NULL OR xc = '')""")

# ---- S1 raw JSONL scan ------------------------------------------------------------------
ORACLE["raw_text_kinds"] = f"""
SELECT CASE WHEN n > 2 THEN 'ARRAY<STRING>' WHEN n = 2 THEN 'STRING' ELSE 'VOID' END AS text_kind,
       count(*)::BIGINT AS n
FROM (SELECT len(string_split(text, {NL})) AS n FROM documents) GROUP BY 1"""
ORACLE["raw_samples"] = ORACLE["training_samples"]

# ---- E1-E9 page extraction --------------------------------------------------------------
_ENT = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&#8211;", "–"),
        ("&euro;", "€"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _inline(x: str) -> str:
    s = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for a, b in _ENT:
        s = f"replace({s}, '{a}', '{b}')"
    return f"trim(regexp_replace({s}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


def _block(x: str, tag: str) -> str:
    return f"regexp_extract({x}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1)"


def _nullif(x: str) -> str:
    return f"nullif({x}, '')"


CTE["page_articles"] = f"""
pg0 AS (
  SELECT page_id, url, contains(html, '<article>') AS marked,
         replace(html, '<article>', '<article><div class="lead teaser">No. <div>' || page_id
                 || '</div> in&nbsp;short &#8211; &euro;</div><span class=''category''>c' || (page_id % 7) || '</span><time>'
                 || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || '.03.2024</time>') AS html
  FROM pages
),
pg AS (
  SELECT page_id, url, marked,
         regexp_replace(CASE WHEN page_id % 4 = 3 THEN regexp_replace(html, '(?i)</?p(\\s[^>]*)?>', ' ', 'g') ELSE html END,
                        '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g') AS h
  FROM pg0
),
pg2 AS (
  SELECT page_id, url, marked, h,
         CASE WHEN regexp_matches(h, '(?is)<article\\b')
              THEN regexp_replace({_block('h', 'article')}, '(?is)<h1\\b.*?</h1>', '', 'g') END AS body
  FROM pg
),
page_articles AS (
  SELECT page_id, url,
         {_nullif(_inline(_block('h', 'h1')))} AS title,
         CASE WHEN marked THEN '202403' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS date_raw,
         CASE WHEN marked THEN 'c' || (page_id % 7) END AS category,
         CASE WHEN marked THEN 'No. ' || page_id || ' in\u00a0short – €' END AS teaser,
         CASE WHEN body IS NULL THEN NULL
              WHEN regexp_matches(body, '(?i)<p(\\s[^>]*)?>') THEN 'array' ELSE 'string' END AS text_kind,
         CASE WHEN body IS NOT NULL AND regexp_matches(body, '(?i)<p(\\s[^>]*)?>') THEN
           list_filter(list_transform(string_split_regex(body, '(?i)<p(?:\\s[^>]*)?>')[2:],
                                      lambda x: {_inline("regexp_replace(x, '(?is)</p.*$', '')")}), lambda x: x <> '') END AS paragraphs,
         body
  FROM pg2
)"""

ORACLE["page_articles"] = sql(["page_articles"], f"""
SELECT page_id, url, title, date_raw, category, teaser, text_kind,
       len(paragraphs)::BIGINT AS n_paragraphs, array_to_string(paragraphs, {NL}) AS body,
       CASE WHEN text_kind = 'string' THEN nullif(array_to_string(list_filter(list_transform(
         string_split_regex(body, '<[^>]*>'), lambda x: {_inline('x')}), lambda x: x <> ''), {NL}), '') END AS body_text
FROM page_articles""")

ORACLE["page_paragraphs"] = sql(["page_articles"], """
SELECT page_id, (generate_subscripts(paragraphs, 1) - 1)::BIGINT AS pos, unnest(paragraphs) AS paragraph
FROM page_articles""")


def _urljoin(base: str, href: str) -> str:
    scheme = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
    auth = f"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    path = f"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract({base}, '^[^?#]*(\\?[^#]*)', 1)"
    origin = f"({scheme} || '://' || {auth})"
    bdir = f"regexp_replace(CASE WHEN {path} = '' THEN '/' ELSE {path} END, '[^/]*$', '')"
    return (f"CASE WHEN regexp_matches({href}, '^([A-Za-z][A-Za-z0-9+.-]*):') THEN {href} "
            f"WHEN starts_with({href}, '//') THEN {scheme} || ':' || {href} "
            f"WHEN starts_with({href}, '/') THEN {origin} || {href} "
            f"WHEN starts_with({href}, '?') THEN {origin} || {path} || {href} "
            f"WHEN starts_with({href}, '#') THEN {origin} || {path} || {query} || {href} "
            f"WHEN {href} = '' THEN {base} ELSE {origin} || {bdir} || {href} END")


ORACLE["page_links"] = f"""
WITH e AS (
  SELECT page_id, url, unnest(ents) AS entry, (generate_subscripts(ents, 1) - 1)::BIGINT AS pos
  FROM (SELECT page_id, url,
               regexp_extract_all(regexp_extract(html, '(?is)<nav\\b[^>]*>(.*?)</nav>', 1),
                                  '(?is)<li\\b[^>]*>(.*?)</li>', 1) AS ents FROM pages)
), l AS (
  SELECT page_id, url, pos, entry, regexp_extract(entry, '(?is)<a\\b[^>]*href="([^"]*)"', 1) AS href
  FROM e WHERE regexp_matches(entry, '(?is)<a\\b[^>]*href="([^"]*)"')
)
SELECT page_id, pos, {_inline("regexp_extract(entry, '(?is)<a\\b[^>]*href=\"[^\"]*\"[^>]*>(.*?)</a>', 1)")} AS title,
       href, {_urljoin('url', 'href')} AS link
FROM l"""

ORACLE["date_normalise"] = """
SELECT event_id, date_text, strftime(try_strptime(trim(date_text), '%d.%m.%Y'), '%Y%m%d') AS date_raw,
       CASE WHEN date_text IS NOT NULL AND try_strptime(trim(date_text), '%d.%m.%Y') IS NULL THEN 1 ELSE 0 END
         AS date_malformed
FROM (SELECT event_id, lpad(CAST(day(ts) AS VARCHAR), 2, '0') || '.' || CAST(month(ts) AS VARCHAR) || '.'
             || CAST(year(ts) AS VARCHAR) AS date_text FROM events)"""

# ---- D1-D8 dataset ---------------------------------------------------------------------
TOKEN_RE = r"'[\p{L}\p{N}]+'"
UNK_ID = 50255

CTE["split"] = f"""
ranked AS (
  SELECT *, (row_number() OVER (ORDER BY md5('{DEFAULT_SEED}:' || CAST(idx AS VARCHAR)), idx) - 1)::BIGINT AS rank,
         ceil(0.1 * count(*) OVER ()) AS n_eval
  FROM samples
),
split AS (
  SELECT idx, article_id, x, CASE WHEN rank < n_eval THEN 'eval' ELSE 'train' END AS split, rank,
         (CASE WHEN rank < n_eval THEN rank ELSE rank - n_eval END)::BIGINT AS split_rank
  FROM ranked
)"""
CTE["vocab"] = f"""
vocab AS (
  SELECT tok, cnt, (CASE WHEN r < {UNK_ID} THEN r ELSE r + 2 END)::BIGINT AS id
  FROM (SELECT tok, cnt, row_number() OVER (ORDER BY cnt DESC, tok) - 1 AS r
        FROM (SELECT tok, count(*)::BIGINT AS cnt
              FROM (SELECT unnest(regexp_extract_all(lower(text), {TOKEN_RE})) AS tok FROM documents) GROUP BY tok))
)"""
CTE["tokenized"] = f"""
tok_pos AS (
  SELECT idx, split, split_rank, unnest(t) AS tok, generate_subscripts(t, 1) AS k
  FROM (SELECT idx, split, split_rank, regexp_extract_all(lower(x), {TOKEN_RE}) AS t FROM split)
),
tokenized AS (
  SELECT s.idx, s.split, s.split_rank,
         coalesce(list(coalesce(v.id, {UNK_ID}) ORDER BY p.k) FILTER (WHERE p.k IS NOT NULL), []) AS ids
  FROM split s LEFT JOIN tok_pos p ON p.idx = s.idx LEFT JOIN vocab v ON v.tok = p.tok
  GROUP BY s.idx, s.split, s.split_rank
)"""
DEPS.update({"split": ["samples"], "tokenized": ["split", "vocab"]})

ORACLE["incremental_new_docs"] = sql(["articles"], """
SELECT idx, article_id, title,
       CASE WHEN CAST(article_id AS BIGINT) > (SELECT max(doc_id) FROM labels) THEN 1 ELSE 0 END AS newer_than_marker
FROM articles WHERE article_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""")

ORACLE["train_eval_split"] = sql(["split"], "SELECT idx, article_id, split, rank, split_rank FROM split")
ORACLE["split_sizes"] = sql(["split"], "SELECT split, count(*)::BIGINT AS n FROM split GROUP BY split")
ORACLE["vocab_topk"] = sql(["vocab"], "SELECT tok, cnt, id FROM vocab")
ORACLE["tokenized_samples"] = sql(["tokenized"], f"""
SELECT idx, split, len(ids)::BIGINT AS n_tokens, len(list_filter(ids, lambda i: i = {UNK_ID}))::BIGINT AS n_unk,
       coalesce(list_sum(list_transform(ids, lambda i, k: i::BIGINT * k)), 0)::BIGINT AS id_checksum,
       ids[1]::BIGINT AS first_id
FROM tokenized""")
ORACLE["truncation_stats"] = sql(["tokenized"], """
SELECT split, count(*)::BIGINT AS n, sum(CASE WHEN len(ids) > 512 THEN 1 ELSE 0 END)::BIGINT AS n_truncated,
       round(avg(len(ids)), 6) AS avg_len_raw, round(avg(least(len(ids), 512)), 6) AS avg_len,
       max(len(ids))::BIGINT AS max_len_raw
FROM tokenized GROUP BY split""")
ORACLE["collated_batches"] = sql(["tokenized"], """
SELECT idx, split, batch_id, seq_len, batch_len, (batch_len - seq_len)::BIGINT AS n_pad,
       seq_len AS n_label_tokens, seq_len AS mask_sum
FROM (SELECT idx, split, (split_rank // 8)::BIGINT AS batch_id, len(ids)::BIGINT AS seq_len,
             max(len(ids)) OVER (PARTITION BY split, split_rank // 8)::BIGINT AS batch_len
      FROM tokenized)""")
ORACLE["step_assignment"] = sql(["split"], """
SELECT epoch, idx, micro, step FROM (
  SELECT epoch, idx, (epoch * n + r)::BIGINT AS micro, ((epoch * n + r) // 8 + 1)::BIGINT AS step,
         10 * (n // 8) AS max_steps
  FROM (SELECT e.epoch::BIGINT AS epoch, t.idx,
               row_number() OVER (PARTITION BY e.epoch ORDER BY md5('42:' || e.epoch || ':' || t.idx), t.idx) - 1 AS r,
               count(*) OVER (PARTITION BY e.epoch) AS n
        FROM (SELECT idx FROM split WHERE split = 'train') t, range(10) e(epoch)))
WHERE step <= max_steps""")

# ---- J1-J3, V1-V10, A1-A7 ----------------------------------------------------------------
CTE["qna"] = """
qna AS (
  SELECT u.conv_id * 1000 + u.turn AS id, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""
CTE["predictions"] = f"""
predictions AS (
  SELECT m.model, q.id,
         'Q: ' || q.question || {NL} || 'A: ' ||
         CASE m.model_pos WHEN 0 THEN q.question WHEN 1 THEN q.answer
              ELSE array_to_string(list_reverse(string_split(q.answer, ' ')), ' ') END || {NL} || 'Q: next' AS full_text
  FROM qna q CROSS JOIN models m WHERE m.model_pos <> 2 OR q.id % 7 <> 3
)"""


def _extract(t: str) -> str:
    return (f"split_part(trim(CASE WHEN position('A:' IN {t}) > 0 THEN substr({t}, position('A:' IN {t}) + 2) "
            f"ELSE {t} END, {PYWS_SQL}), {NL}, 1)")


CTE["grid"] = f"""
grid AS (
  SELECT m.model, m.model_pos, q.id, q.question, q.answer AS reference,
         'Q: ' || q.question || {NL} || 'A:' AS prompt, {_extract('p.full_text')} AS prediction
  FROM qna q CROSS JOIN models m LEFT JOIN predictions p ON p.model = m.model AND p.id = q.id
)"""
CTE["lm"] = f"""
doc_tok AS (SELECT unnest(regexp_extract_all(lower(text), {TOKEN_RE})) AS tok FROM documents),
base_uni AS (SELECT tok, count(*) AS c_doc FROM doc_tok GROUP BY tok),
base_tot AS (SELECT sum(c_doc) AS n_doc, count(*) + 1 AS v_doc FROM base_uni),
train_seq AS (SELECT regexp_extract_all(lower(x), {TOKEN_RE}) AS t FROM split WHERE split = 'train'),
train_pos AS (SELECT unnest(t) AS tok, unnest(list_prepend('<s>', t[1:len(t) - 1])) AS prev
              FROM train_seq WHERE len(t) > 0),
train_bi AS (SELECT prev, tok, count(*) AS c_bi FROM train_pos GROUP BY prev, tok),
train_uni AS (SELECT tok, sum(c_bi) AS c_tr FROM train_bi GROUP BY tok),
train_prev AS (SELECT prev, sum(c_bi) AS c_prev FROM train_bi GROUP BY prev),
train_tot AS (SELECT sum(c_tr) AS n_tr, count(*) + 1 AS v_tr FROM train_uni)"""
DEPS.update({"predictions": ["qna", "models"], "grid": ["predictions"], "lm": ["split"]})


def _scored(pos_cte: str, keys: str) -> str:
    """(model, keys, pos, lp) of a positions CTE (keys, pos, prev, tok) under the three variants."""
    pb = "((coalesce(bu.c_doc, 0) + 1.0) / (bt.n_doc + bt.v_doc))"
    pu = "((coalesce(tu.c_tr, 0) + 1.0) / (tt.n_tr + tt.v_tr))"
    pi = "((coalesce(tb.c_bi, 0) + 1.0) / (coalesce(tp.c_prev, 0) + tt.v_tr))"
    return f"""
  SELECT m.model, {keys}, s.pos,
         CASE m.model WHEN 'base' THEN lp_base WHEN 'FT-M1B' THEN lp_m1b ELSE lp_full END AS lp
  FROM (SELECT {keys}, pos, ln({pb}) AS lp_base, ln(0.5 * {pu} + 0.5 * {pb}) AS lp_m1b,
               ln(0.5 * {pi} + 0.5 * {pb}) AS lp_full
        FROM {pos_cte} LEFT JOIN base_uni bu USING (tok) LEFT JOIN train_uni tu USING (tok)
             LEFT JOIN train_bi tb USING (prev, tok) LEFT JOIN train_prev tp USING (prev)
             CROSS JOIN base_tot bt CROSS JOIN train_tot tt) s CROSS JOIN models m"""


def _positions(src: str, keys: str, arr: str) -> str:
    return f"""
  SELECT {keys}, unnest(seq) AS tok, unnest(list_prepend('<s>', seq[1:len(seq) - 1])) AS prev,
         unnest(generate_series(0, len(seq) - 1)) AS pos
  FROM (SELECT {keys}, {arr} AS seq FROM {src}) WHERE len(seq) > 0"""


CTE["tlp"] = f"""
qseq AS (SELECT id, len(regexp_extract_all(lower('Q: ' || question || {NL} || 'A:'), {TOKEN_RE})) AS prompt_len,
                'Q: ' || question || {NL} || 'A: ' || answer AS full_pair FROM qna),
qpos AS ({_positions('qseq', 'id, prompt_len', f"regexp_extract_all(lower(full_pair), {TOKEN_RE})")}),
tlp AS ({_scored('qpos', 'id, prompt_len')}),
nll AS (
  SELECT model, id, avg(CASE WHEN pos >= prompt_len THEN -lp END) AS nll, avg(-lp) AS nll_full,
         sum(CASE WHEN pos >= prompt_len THEN 1 ELSE 0 END)::BIGINT AS n_answer_tokens
  FROM tlp GROUP BY model, id
)"""
DEPS["tlp"] = ["lm", "qna", "models"]


def _vec(tok: str) -> str:
    return f"(('0x' || substr(md5({tok}), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings))"


CTE["bert"] = f"""
emb AS (
  SELECT vec_id, list_transform(e, lambda x: x / nrm) AS u
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e,
               sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS nrm FROM embeddings)
),
bs_side AS (
  SELECT model, id, side, {_vec('tok')} AS vec, count(*) AS cnt FROM (
    SELECT model, id, 'p' AS side, unnest(regexp_extract_all(lower(prediction), {TOKEN_RE})) AS tok FROM grid
    UNION ALL
    SELECT model, id, 'r' AS side, unnest(regexp_extract_all(lower(reference), {TOKEN_RE})) AS tok FROM grid)
  GROUP BY ALL
),
pairs_cos AS (
  SELECT p.model, p.id, p.vec AS pv, p.cnt AS pc, r.vec AS rv, r.cnt AS rc, list_dot_product(ep.u, er.u) AS cos
  FROM bs_side p JOIN bs_side r ON p.model = r.model AND p.id = r.id AND p.side = 'p' AND r.side = 'r'
  JOIN emb ep ON ep.vec_id = p.vec JOIN emb er ON er.vec_id = r.vec
),
bp AS (SELECT model, id, sum(pc * m) / sum(pc) AS bp
       FROM (SELECT model, id, pv, pc, max(cos) AS m FROM pairs_cos GROUP BY ALL) GROUP BY ALL),
br AS (SELECT model, id, sum(rc * m) / sum(rc) AS br
       FROM (SELECT model, id, rv, rc, max(cos) AS m FROM pairs_cos GROUP BY ALL) GROUP BY ALL),
bert AS (
  SELECT g.model, g.id, coalesce(bp.bp, 0) AS bert_p, coalesce(br.br, 0) AS bert_r,
         CASE WHEN coalesce(bp.bp, 0) + coalesce(br.br, 0) = 0 THEN 0.0
              ELSE 2 * bp.bp * br.br / (bp.bp + br.br) END AS bert_f1
  FROM grid g LEFT JOIN bp ON bp.model = g.model AND bp.id = g.id LEFT JOIN br ON br.model = g.model AND br.id = g.id
)"""
DEPS["bert"] = ["grid"]

CTE["summary"] = """
results AS (
  SELECT g.model, g.model_pos, g.id, n.nll, b.bert_p, b.bert_r, b.bert_f1
  FROM grid g LEFT JOIN bert b ON b.model = g.model AND b.id = g.id
       LEFT JOIN nll n ON n.model = g.model AND n.id = g.id
),
summary AS (
  SELECT model, model_pos, avg(CASE WHEN isnan(nll) THEN NULL ELSE nll END) AS nll,
         avg(bert_p) AS bert_p, avg(bert_r) AS bert_r, avg(bert_f1) AS bert_f1
  FROM results GROUP BY model, model_pos
),
marked AS (
  SELECT *, (abs(nll - min(nll) OVER ()) < 1e-12)::INT AS best_nll,
         (abs(bert_p - max(bert_p) OVER ()) < 1e-12)::INT AS best_bert_p,
         (abs(bert_r - max(bert_r) OVER ()) < 1e-12)::INT AS best_bert_r,
         (abs(bert_f1 - max(bert_f1) OVER ()) < 1e-12)::INT AS best_bert_f1
  FROM summary
)"""
DEPS["summary"] = ["grid", "bert", "tlp"]

CTE["prompt_lines"] = f"""
prompt_lines AS (
  SELECT item_id AS prompt_pos, (generate_subscripts(l, 1) - 1)::BIGINT AS line_no, unnest(l) AS line, l
  FROM (SELECT item_id, string_split(text, {NL}) AS l FROM benchmark)
)"""
ORACLE["prompt_grid"] = sql(["models", "prompt_lines"], f"""
SELECT m.model, m.model_pos, p.prompt_pos, p.line_no, trim(p.line, {PYWS_SQL}) AS prompt
FROM prompt_lines p CROSS JOIN models m""")
ORACLE["qna_grid"] = sql(["grid"], "SELECT model, model_pos, id, question, reference, prompt, prediction FROM grid")
ORACLE["missing_predictions"] = sql(["predictions"], """
SELECT m.model, m.model_pos, q.id FROM qna q CROSS JOIN models m
WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.model = m.model AND p.id = q.id)""")
ORACLE["extract_answer"] = sql(["predictions"], f"SELECT model, id, {_extract('full_text')} AS prediction FROM predictions")
ORACLE["masked_nll"] = sql(["tlp"], """
SELECT model, id, round(nll, 6) AS nll, round(nll_full, 6) AS nll_full, n_answer_tokens FROM nll""")
ORACLE["perplexity_by_lang"] = sql(["lm"], f"""
SELECT lang, n_tokens, round(nll, 6) AS nll, round(CASE WHEN nll <> 0 THEN exp(nll) END, 6) AS perplexity
FROM (SELECT lang, sum(n)::BIGINT AS n_tokens,
             sum(n * -ln((coalesce(bu.c_doc, 0) + 1.0) / (bt.n_doc + bt.v_doc))) / sum(n) AS nll
      FROM (SELECT lang, tok, count(*) AS n FROM
              (SELECT lang, unnest(regexp_extract_all(lower(text), {TOKEN_RE})) AS tok FROM documents)
            GROUP BY lang, tok) c
      LEFT JOIN base_uni bu USING (tok) CROSS JOIN base_tot bt GROUP BY lang)""")
ORACLE["bertscore_pairs"] = sql(["bert"], """
SELECT model, id, round(bert_p, 6) AS bert_p, round(bert_r, 6) AS bert_r, round(bert_f1, 6) AS bert_f1 FROM bert""")
ORACLE["bertscore_corpus"] = sql(["bert"], """
SELECT model, round(avg(bert_p), 6) AS bert_p, round(avg(bert_r), 6) AS bert_r, round(avg(bert_f1), 6) AS bert_f1
FROM bert GROUP BY model""")
ORACLE["ngram_lm_nll"] = sql(["lm", "models"], f"""
WITH_BPOS
SELECT model, item_id, count(*)::BIGINT AS n_tokens, round(avg(-lp), 6) AS nll FROM bscored GROUP BY model, item_id""")
ORACLE["ngram_lm_nll"] = ORACLE["ngram_lm_nll"].replace("WITH_BPOS\n", "").replace(
    "\nSELECT model, item_id", f""",
bpos AS ({_positions('benchmark', 'item_id', f"regexp_extract_all(lower(text), {TOKEN_RE})")}),
bscored AS ({_scored('bpos', 'item_id')})
SELECT model, item_id""", 1)
ORACLE["lm_variant_nll"] = sql(["lm", "models"], f""",
epos AS ({_positions("(SELECT idx, x FROM split WHERE split = 'eval')", 'idx', f"regexp_extract_all(lower(x), {TOKEN_RE})")}),
escored AS ({_scored('epos', 'idx')})
SELECT model, count(*)::BIGINT AS n_tokens, round(avg(-lp), 6) AS nll,
       round(CASE WHEN avg(-lp) <> 0 THEN exp(avg(-lp)) END, 6) AS perplexity
FROM escored GROUP BY model""")
ORACLE["eval_summary"] = sql(["summary"], """
SELECT model, model_pos, round(nll, 6) AS nll, round(bert_p, 6) AS bert_p, round(bert_r, 6) AS bert_r,
       round(bert_f1, 6) AS bert_f1 FROM summary""")
ORACLE["eval_summary_sorted"] = sql(["summary"], """
SELECT model, round(bert_p, 4) AS bert_p, round(bert_r, 4) AS bert_r, round(bert_f1, 4) AS bert_f1,
       row_number() OVER (ORDER BY round(bert_p, 4), model)::BIGINT AS sort_rank FROM summary""")
ORACLE["best_marks"] = sql(["summary"], """
SELECT model, model_pos, round(nll, 6) AS nll, round(bert_p, 6) AS bert_p, round(bert_r, 6) AS bert_r,
       round(bert_f1, 6) AS bert_f1, best_nll, best_bert_p, best_bert_r, best_bert_f1 FROM marked""")


def _cell(m: str) -> str:
    return (f"CASE WHEN best_{m} = 1 THEN '**' || printf('%.4f', {m}) || '**' ELSE printf('%.4f', {m}) END "
            f"AS {m}_cell")


ORACLE["summary_cells"] = sql(["summary"], f"""
SELECT *, '| ' || model || ' | ' || nll_cell || ' | ' || bert_p_cell || ' | ' || bert_r_cell || ' | ' || bert_f1_cell
          || ' |' AS markdown_row
FROM (SELECT model, model_pos, {_cell('nll')}, {_cell('bert_p')}, {_cell('bert_r')}, {_cell('bert_f1')} FROM marked)""")
ORACLE["generations_by_prompt"] = sql(["models", "prompt_lines"], f"""
SELECT p.prompt_pos, p.line_no, trim(p.line, {PYWS_SQL}) AS prompt, count(*)::BIGINT AS n_models,
       string_agg('[' || m.model || '] ' || array_to_string(list_slice(p.l, p.line_no + 1, p.line_no + 1 + m.model_pos), ' '),
                  {NL} ORDER BY m.model_pos) AS outputs
FROM prompt_lines p CROSS JOIN models m GROUP BY p.prompt_pos, p.line_no, p.line""")

# ---- T1-T5, S8, S9, R1, U1 ---------------------------------------------------------------
CTE["run_history"] = """
run_history AS (
  SELECT event_type AS model, day(ts)::BIGINT AS step, round(avg(value) FILTER (WHERE event_id % 2 = 1), 6) AS loss,
         round(avg(value) FILTER (WHERE event_id % 2 = 0), 6) AS eval_loss
  FROM events GROUP BY event_type, day(ts)
)"""


def _centre(x: str, width: int) -> str:
    left = f"greatest(({width} - length({x})) // 2, 0)"
    right = f"greatest({width} - length({x}) - ({width} - length({x})) // 2, 0)"
    return f"(repeat(' ', {left}) || {x} || repeat(' ', {right}))"


_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END"
LOG_RE = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] \[\s*([A-Za-z]+)\s*\] \[\s*(.*?)\s*\] ( *)(.*)$"
CTE["log_lines"] = f"""
log_lines AS (
  SELECT strftime(ts, '%Y-%m') AS run, event_id * 2 AS line_no,
         '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || {_centre(_LEVEL, 7)} || '] ['
         || {_centre('event_type', 20)} || '] ' || repeat('  ', (user_id % 3)::INT)
         || printf('%s value=%.2f user=%d', event_type, value, user_id) AS value
  FROM events
  UNION ALL
  SELECT strftime(ts, '%Y-%m') AS run, event_id * 2 + 1 AS line_no, '    props: ' || props AS value FROM events WHERE value > 45
),
parsed AS (
  SELECT run, line_no,
         CASE WHEN ok THEN regexp_extract(value, '{LOG_RE}', 1) END AS ts,
         CASE WHEN ok THEN regexp_extract(value, '{LOG_RE}', 2) END AS level,
         CASE WHEN ok THEN regexp_extract(value, '{LOG_RE}', 3) END AS component,
         CASE WHEN ok THEN (length(regexp_extract(value, '{LOG_RE}', 4)) / 2)::BIGINT END AS depth,
         CASE WHEN ok THEN regexp_extract(value, '{LOG_RE}', 5) ELSE value END AS message,
         CASE WHEN ok THEN 0 ELSE 1 END AS is_continuation
  FROM (SELECT run, line_no, value, regexp_matches(value, '{LOG_RE}') AS ok FROM log_lines)
)"""
DEPS["log_lines"] = []

ORACLE["loss_curves"] = sql(["run_history"], """
SELECT model, step, 'eval' AS kind, eval_loss AS loss FROM run_history WHERE eval_loss IS NOT NULL
UNION ALL SELECT model, step, 'train', loss FROM run_history WHERE loss IS NOT NULL""")
ORACLE["overfit_flags"] = sql(["run_history"], """
SELECT model, step, eval_loss, lag(eval_loss) OVER w AS prev_loss,
       coalesce((eval_loss > lag(eval_loss) OVER w)::INT, 0) AS overfit
FROM run_history WHERE eval_loss IS NOT NULL WINDOW w AS (PARTITION BY model ORDER BY step)""")
ORACLE["checkpoint_rank"] = sql(["run_history"], """
SELECT model, step, eval_loss, loss_rank, recency_rank, (loss_rank = 1)::INT AS is_best,
       (recency_rank <= 2)::INT AS is_retained
FROM (SELECT model, step, eval_loss,
             row_number() OVER (PARTITION BY model ORDER BY eval_loss, step)::BIGINT AS loss_rank,
             row_number() OVER (PARTITION BY model ORDER BY step DESC)::BIGINT AS recency_rank
      FROM run_history WHERE eval_loss IS NOT NULL)""")
ORACLE["variant_compare"] = sql(["run_history"], """
SELECT model, max(step) FILTER (WHERE eval_loss IS NOT NULL) AS final_step,
       arg_max(eval_loss, step) FILTER (WHERE eval_loss IS NOT NULL) AS final_loss,
       arg_min(step, (eval_loss, step)) FILTER (WHERE eval_loss IS NOT NULL) AS best_step, min(eval_loss) AS best_loss,
       round(arg_max(eval_loss, step) FILTER (WHERE eval_loss IS NOT NULL) - min(eval_loss), 6) AS final_minus_best,
       round(min(eval_loss) - min(min(eval_loss)) OVER (), 6) AS behind_best,
       arg_max(loss, step) FILTER (WHERE loss IS NOT NULL) AS final_train_loss, count(*)::BIGINT AS n_steps
FROM run_history GROUP BY model""")
ORACLE["runlog_events"] = sql(["log_lines"], """
SELECT run, line_no, ts, level, component, depth, message, is_continuation,
       max(CASE WHEN is_continuation = 0 THEN line_no END) OVER (PARTITION BY run ORDER BY line_no) AS event_line
FROM parsed""")
ORACLE["step_durations"] = sql(["log_lines"], """
SELECT run, component, count(*)::BIGINT AS n_events, count(dur)::BIGINT AS n_timed, sum(dur)::BIGINT AS total_sec,
       round(avg(dur), 6) AS avg_sec, max(dur)::BIGINT AS max_sec,
       round(count(*) / greatest(max(t) - min(t), 1), 6) AS events_per_sec
FROM (SELECT run, component, t, lead(t) OVER (PARTITION BY run, component ORDER BY t, line_no) - t AS dur
      FROM (SELECT run, component, line_no, epoch(strptime(ts, '%Y-%m-%d %H:%M:%S'))::BIGINT AS t
            FROM parsed WHERE is_continuation = 0))
GROUP BY run, component""")
CTE["history"] = """
hday AS (
  SELECT event_type AS model, day(ts)::BIGINT AS d, count(*)::BIGINT AS n, sum(value) AS v,
         round(avg(value) FILTER (WHERE event_id % 2 = 1), 6) AS loss,
         round(avg(value) FILTER (WHERE event_id % 2 = 0), 6) AS eval_loss
  FROM events GROUP BY 1, 2
),
hend AS (SELECT model, 20 * max(d) + 7 AS step, sum(n)::DOUBLE AS n, sum(v) AS v, count(*)::DOUBLE AS k FROM hday GROUP BY model),
history AS (
  SELECT model, 20 * d AS step, 'loss' AS metric, loss AS value FROM hday WHERE loss IS NOT NULL
  UNION ALL SELECT model, 20 * d, 'learning_rate', round(1 / d, 6) FROM hday
  UNION ALL SELECT model, 20 * d + 7, 'eval_loss', eval_loss FROM hday WHERE d % 4 = 0 AND eval_loss IS NOT NULL
  UNION ALL SELECT model, 20 * d + 7, 'eval_samples_per_second', n::DOUBLE FROM hday WHERE d % 4 = 0
  UNION ALL SELECT model, step, 'train_runtime', n FROM hend
  UNION ALL SELECT model, step, 'total_flos', n * 1000000 FROM hend
  UNION ALL SELECT model, step, 'train_loss', round(v / n, 6) FROM hend
  UNION ALL SELECT model, step, 'custom_skips', k FROM hend
  UNION ALL SELECT model, step, 'note', NULL FROM hend
),
htrain AS (SELECT model, step, value AS loss FROM history WHERE metric = 'loss'),
heval AS (SELECT model, step, value AS eval_loss FROM history WHERE metric = 'eval_loss')"""
DEPS["history"] = []
ORACLE["history_metrics"] = sql(["history"], """
SELECT model, metric, count(*)::BIGINT AS n, min(step) AS first_step, max(step) AS last_step, min(value) AS least,
       max(value) AS most, round(avg(value), 6) AS mean
FROM history GROUP BY model, metric""")
ORACLE["history_evaluations"] = sql(["history"], """
SELECT e.model, e.step, eval_loss, t.step AS train_step, t.loss AS train_loss, round(eval_loss - t.loss, 6) AS gap,
       lag(eval_loss) OVER w AS prev_loss, coalesce((eval_loss > lag(eval_loss) OVER w)::INT, 0) AS overfit,
       row_number() OVER (PARTITION BY e.model ORDER BY eval_loss, e.step)::BIGINT AS loss_rank,
       (row_number() OVER (PARTITION BY e.model ORDER BY eval_loss, e.step) = 1)::INT AS is_best,
       (row_number() OVER (PARTITION BY e.model ORDER BY e.step DESC) <= 2)::INT AS is_retained
FROM heval AS e ASOF LEFT JOIN htrain AS t ON e.model = t.model AND e.step >= t.step
WINDOW w AS (PARTITION BY e.model ORDER BY e.step)""")
ORACLE["history_summary"] = sql(["history"], """
SELECT e.*, t.final_train_loss, s.n_steps, s.samples_per_sec, s.train_runtime, s.total_flos, s.train_loss
FROM (SELECT model, max(step) AS final_step, arg_max(eval_loss, step) AS final_loss, arg_min(step, (eval_loss, step)) AS best_step,
             min(eval_loss) AS best_loss, round(arg_max(eval_loss, step) - min(eval_loss), 6) AS final_minus_best,
             round(min(eval_loss) - min(min(eval_loss)) OVER (), 6) AS behind_best
      FROM heval GROUP BY model) AS e
JOIN (SELECT model, arg_max(loss, step) AS final_train_loss FROM htrain GROUP BY model) AS t USING (model)
JOIN (SELECT model, count(DISTINCT step) FILTER (WHERE metric IN ('loss', 'eval_loss', 'eval_samples_per_second'))::BIGINT AS n_steps,
             avg(value) FILTER (WHERE metric = 'eval_samples_per_second') AS samples_per_sec,
             max(value) FILTER (WHERE metric = 'train_runtime') AS train_runtime,
             max(value) FILTER (WHERE metric = 'total_flos') AS total_flos,
             max(value) FILTER (WHERE metric = 'train_loss') AS train_loss
      FROM history GROUP BY model) AS s USING (model)""")
ORACLE["log_file_events"] = sql(["log_lines"], """
SELECT run, line_no, ts, level, component, depth, message, is_continuation,
       max(CASE WHEN is_continuation = 0 THEN line_no END) OVER (PARTITION BY run ORDER BY line_no) AS event_line
FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY run ORDER BY line_no) - 1 AS line_no) FROM parsed)""")
CTE["log_steps"] = """
said AS (
  SELECT strftime(ts, '%Y-%m') AS run, event_id AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type AS component,
         epoch(date_trunc('second', ts))::BIGINT AS t,
         CASE WHEN event_id % 4 = 2 THEN printf('%.2f', value)::DOUBLE END AS sec,
         CASE WHEN event_id % 4 IN (1, 3) THEN user_id END AS n
  FROM events
),
log_steps AS (
  SELECT run, component, min(line_no) AS first_line, max(line_no) AS last_line, count(*)::BIGINT AS n_events,
         arg_min(ts, line_no) AS start_ts, arg_max(ts, line_no) AS end_ts, arg_max(t, line_no) - arg_min(t, line_no) AS measured_sec,
         max(sec) AS reported_sec, arg_max(n, line_no) FILTER (WHERE n IS NOT NULL) AS n_reported,
         (max(sec) IS NOT NULL)::INT AS closed
  FROM (SELECT *, count(sec) OVER (PARTITION BY run, component ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g
        FROM said) GROUP BY run, component, g
)"""
DEPS["log_steps"] = []
ORACLE["log_steps"] = sql(["log_steps"], "SELECT * FROM log_steps")
ORACLE["log_step_report"] = sql(["log_steps"], """
SELECT run, component, count(*) FILTER (WHERE closed = 1)::BIGINT AS n_steps, count(*) FILTER (WHERE closed = 0)::BIGINT AS n_open,
       sum(n_events)::BIGINT AS n_events, (sum(measured_sec) FILTER (WHERE closed = 1))::BIGINT AS measured_sec,
       round(sum(reported_sec), 2) AS reported_sec, sum(n_reported)::BIGINT AS n_reported,
       round((sum(n_reported) FILTER (WHERE closed = 1)) / nullif(sum(reported_sec), 0), 6) AS reported_per_sec
FROM log_steps GROUP BY run, component""")
ORACLE["newsfeed_links"] = """
WITH entries AS (SELECT page_id, url, i, page_id * 10 + i AS k FROM (SELECT *, unnest(range(1, 3 + (page_id % 3)::INT)) AS i FROM pages)),
listed AS (SELECT page_id, url, i, 0 AS part, k::VARCHAR AS article_id, CASE WHEN i % 4 <> 0 THEN '/news/' || k END AS href,
                  'News ' || k AS title FROM entries
           UNION ALL SELECT page_id, url, i, 1, k || 'n', 'more/' || k, 'More ' || k FROM entries WHERE i % 3 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i, part) - 1 AS pos FROM listed)
SELECT page_id, pos, title, href, article_id,
       CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/]+') || href
            ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://[^/]+(?:/.*)?)/[^/]*$', '\\1') || '/' || href END AS link
FROM placed WHERE href IS NOT NULL"""
ORACLE["newsroom_articles"] = """
SELECT page_id, 'Press ' || page_id AS title,
       CASE WHEN page_id % 5 <> 0 THEN '202511' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END AS date_raw,
       'c' || (page_id % 7) AS category, '+++ Short ' || page_id || ' +++' AS teaser, 'array' AS text_kind,
       'Box ' || page_id || '|deep|First ' || page_id || '|Last & done' AS body
FROM pages"""
ORACLE["char_body_samples"] = ORACLE["training_samples"].replace("THEN [l[2]]", "THEN string_split(l[2], '')")
ORACLE["workflow_split"] = ORACLE["train_eval_split"]
ORACLE["indexed_new_docs"] = sql(["articles"], """
SELECT idx, article_id, title FROM articles WHERE idx NOT IN (SELECT doc_id FROM labels)""")
ORACLE["committed_samples"] = sql(["samples"], """
SELECT idx, article_id, x, CASE WHEN idx % 2 = 0 THEN 'first' ELSE 'second' END AS tag FROM samples""")
ORACLE["stored_samples"] = ORACLE["training_samples"]
ORACLE["qna_scan"] = sql(["qna"], "SELECT id, question, answer FROM qna")
ORACLE["prompt_lines"] = f"""
SELECT part, row_number() OVER (PARTITION BY part ORDER BY item_id, line)::BIGINT - 1 AS prompt_pos, trim(value, {PYWS_SQL}) AS prompt
FROM (SELECT item_id, (item_id % 16)::BIGINT AS part, unnest(range(0, len(ls))) AS line, unnest(ls) AS value
      FROM (SELECT item_id, string_split(text, {NL}) AS ls FROM benchmark))"""
ORACLE["stream_ingest"] = ORACLE["training_samples"]
ORACLE["map_batches"] = sql(["samples"], f"""
SELECT idx, length(x)::BIGINT AS n_chars, len(string_split(x, {NL}))::BIGINT AS n_lines FROM samples""")
