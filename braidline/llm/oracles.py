"""DuckDB SQL for the queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP6 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({LOWER}, '{BENCH_WORD}') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '{BENCH_WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS g
        FROM iw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(k) WHERE len(w) > 0),
dg AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
       FROM dw, (SELECT DISTINCT n FROM win) AS sizes, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS r(k)),
hits AS (SELECT doc_id, item, k, dg.n FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + n)) AS r(p) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN own USING (doc_id)
"""

OP4 = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""

#: Components by recursion over the links of distinct sets.
OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))))
             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
d AS (SELECT g, min(doc_id) AS rep, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
t AS (SELECT rep, n, unnest(g) AS x FROM d),
o AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS both_n FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 9 GROUP BY ALL),
links AS (SELECT a, b FROM o WHERE 100 * both_n >= 90 * (na + nb - both_n)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r(id, c) AS (SELECT rep, rep FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id
FROM s LEFT JOIN d ON s.g = d.g LEFT JOIN m ON m.id = d.rep
"""

OP1 = r"""
WITH l AS (SELECT doc_id, n_lines, k - 1 AS line, list_sort(list_distinct(list_filter(string_split_regex(lower(t[k]), '[\x09\x0B-\x0D\x20]+'), lambda x: x <> ''))) AS g
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines FROM documents), unnest(range(1, n_lines + 1)) AS r(k)),
c AS (SELECT g, len(g) AS n, min((doc_id, line)) AS f, row_number() OVER () AS id FROM l WHERE len(g) >= 1 GROUP BY g),
tok AS (SELECT id, n, f, unnest(g) AS x FROM c),
freq AS (SELECT x, count(*) AS k FROM tok GROUP BY x),
pre AS (SELECT * FROM (SELECT id, n, f, tok.x, row_number() OVER (PARTITION BY id ORDER BY k, tok.x) AS p FROM tok JOIN freq ON tok.x = freq.x) WHERE p <= n - CAST(ceil(n * 4 / 5) AS INT) + 1),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM pre a JOIN pre b ON a.x = b.x AND a.f < b.f AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4),
beaten AS (SELECT DISTINCT cand.b AS id FROM cand JOIN c x ON x.id = cand.a JOIN c y ON y.id = cand.b WHERE 9 * len(list_intersect(x.g, y.g)) >= 4 * (x.n + y.n)),
gone AS (SELECT l.doc_id, l.line FROM l JOIN c ON l.g = c.g LEFT JOIN beaten ON beaten.id = c.id WHERE beaten.id IS NOT NULL OR (l.doc_id, l.line) <> c.f),
agg AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN agg ON agg.doc_id = d.doc_id
"""

OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE isfinite(list_cosine_similarity(a.e, b.e)) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON r.id = p.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, count(*) AS k FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id
"""

ORACLES = {"op1_line_dedup": OP1, "op4_warc": OP4, "op6_decontamination": OP6, "op7_embedding_dups": OP7, "op9_ngram_join": OP9}
