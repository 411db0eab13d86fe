"""SQL for DuckDB for those of the operators that SQL can express but that need more of it than a few lines."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, k, substr(h, CAST(2 * k + 1 AS BIGINT), 100) AS s FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS k FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
m AS (SELECT r, k FROM w JOIN f USING (s) WHERE first < doc_id),
g AS (SELECT r, k, CASE WHEN k <= lag(k) OVER (PARTITION BY r ORDER BY k) + 50 THEN 0 ELSE 1 END AS new FROM m),
i AS (SELECT r, k, sum(new) OVER (PARTITION BY r ORDER BY k) AS span FROM g),
s AS (SELECT r, span, min(k) AS a, max(k) + 50 AS b FROM i GROUP BY r, span),
p AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
c AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail FROM s GROUP BY r),
t AS (SELECT p.r, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head FROM p JOIN d ON d.r = p.r GROUP BY p.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, CAST(2 * tail + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END)) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(c.least, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(c.least, doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id"""

_WORDS = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(_LOWER)

CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), j AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE item_id IS NOT NULL AND len(w) > 0),
t AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM j)),
v AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM t) WHERE len(w) >= n)),
h AS (SELECT r, k, v.n, item_id FROM v JOIN t ON t.n = v.n AND t.s = v.s),
q AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS word FROM h) GROUP BY r),
a AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN q USING (r) LEFT JOIN a USING (r)"""
