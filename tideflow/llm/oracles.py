"""SQL for the operators that SQL can express, over whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRING_DEDUP = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS j FROM w),
g AS (SELECT doc_id, j, string_agg(word, ' ') OVER f AS gram, count(*) OVER f AS n FROM t WINDOW f AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, j FROM g WHERE n = 20 QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, j) > 1),
c AS (SELECT DISTINCT doc_id, j + unnest(range(20)) AS j FROM r),
k AS (SELECT t.doc_id, count(c.j) AS n_removed, string_agg(word, ' ' ORDER BY t.j) FILTER (c.j IS NULL) AS kept FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.j = t.j GROUP BY t.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

NGRAM_JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS j, len(ws) AS n_words FROM w),
g AS (SELECT doc_id, j, n_words, string_agg(word, ' ') OVER f AS gram, count(*) OVER f AS n FROM t WINDOW f AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, gram FROM g WHERE n = 3 OR (n_words < 3 AND j = 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN z USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
