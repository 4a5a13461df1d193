"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

OP2 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, length(coalesce(text, '')) AS size
           FROM documents),
w AS (SELECT doc_id, i AS pos, [ls[i + 1], ls[i + 2], ls[i + 3]] AS win
      FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS i FROM d WHERE len(ls) >= 3)
      WHERE length(trim(ls[i + 1])) > 0 OR length(trim(ls[i + 2])) > 0 OR length(trim(ls[i + 3])) > 0),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS rn FROM w),
covered AS (SELECT DISTINCT doc_id, pos + k AS line
            FROM (SELECT doc_id, pos, unnest([0, 1, 2]) AS k FROM ranked WHERE rn > 1)),
lines AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS body, size FROM d),
marked AS (SELECT l.*, c.line IS NOT NULL AS gone,
                  lag(c.line IS NOT NULL, 1, false) OVER (PARTITION BY l.doc_id ORDER BY l.line) AS before
           FROM lines l LEFT JOIN covered c USING (doc_id, line))
SELECT doc_id, CASE WHEN any_value(size) > 0 THEN count(*) ELSE 0 END AS n_lines,
       count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE gone AND NOT before) AS n_spans,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10 = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM lowered),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[p + 1:p + n], ' ') AS win
       FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(0, len(ws) - least(len(ws), 10) + 1)) AS p
             FROM i WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(ws[p + 1:p + n], ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS p
             FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT w) AS n_hit
          FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS w FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
        FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

# the inner reduction divides by the reversed polynomial of CRC-32, eight bits for each character
OP11 = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
             xor(4294967295, list_reduce(
                 list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ord(s)::BIGINT)),
                 lambda crc, byte: list_reduce(
                     list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                     lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
parts AS (SELECT c.conv_id, 0 AS part, p, role, text FROM c JOIN t ON t.conv_id = c.base AND p <= h
          UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d, role, text FROM parts),
path AS (SELECT conv_id, d, text, string_agg(md5(length(role) || ':' || role || text), '')
                                  OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r
         UNION ALL SELECT conv_id, 0, '', '' FROM c),
sizes AS (SELECT conv_id, max(d) AS n FROM path GROUP BY conv_id),
node AS (SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(length(text)) AS size,
                string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = n) AS ends
         FROM path JOIN sizes USING (conv_id) GROUP BY path, d),
kids AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
own AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (path)),
total AS (SELECT left(path, 32 * k) AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
                 CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens
          FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM own) GROUP BY 1)
SELECT own.conv_id, CAST(own.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, own.n_convs,
       CAST(own.n_children AS BIGINT) AS n_children, n_leaves, saved_tokens, sha256(coalesce(own.ends, '')) AS ends_sha256
FROM own JOIN total USING (path) LEFT JOIN own AS up ON own.depth > 0 AND up.path = left(own.path, 32 * (own.depth - 1))
"""

OP12 = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                 CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
          FROM e AS a, e AS b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score
        FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS n FROM pairs WHERE same)
        WHERE n <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM (SELECT p.anchor_id, positive_id, positive_score, x.other_id AS negative_id, x.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY x.score DESC, x.other_id) AS rank
      FROM pos AS p JOIN pairs AS x ON x.anchor_id = p.anchor_id AND NOT x.same
       AND 80 * positive_score <= 100 * x.score AND 100 * x.score <= 100 * positive_score)
WHERE rank <= 5
"""

ORACLE = {"op11_prefix_trie": OP11, "op12_hard_negatives": OP12, "op2_line_dedup": OP2, "op10_benchmark_decontamination": OP10}
