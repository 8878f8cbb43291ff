"""SQL that DuckDB runs on the same tables, for the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
g AS (
  SELECT *, CASE WHEN count(*) OVER o = 13 THEN md5(string_agg(word, ' ') OVER o) END AS gram
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
),
m AS (SELECT gram, min(doc_id) AS least FROM g WHERE gram IS NOT NULL GROUP BY gram),
s AS (SELECT g.doc_id, g.i, g.word, coalesce(m.least < g.doc_id, false) AS again FROM g LEFT JOIN m USING (gram)),
c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM s),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN r USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.replace("(text,", "(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),")} AS words FROM documents
),
w AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
g AS (
  SELECT doc_id, n, i, count(*) OVER o AS size, md5(string_agg(word, ' ') OVER o) AS gram
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
),
s AS (SELECT DISTINCT doc_id, gram FROM g WHERE size = 5 OR (n < 5 AND i = 0)),
k AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n_shingles + y.n_shingles - common)),
r(doc_id, other) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, least(doc_id, coalesce(least_other, doc_id)) AS component_id
FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least_other FROM r GROUP BY doc_id) USING (doc_id)
"""

OP6 = r"""
WITH front AS (
  SELECT page_id, url, length(html) AS size, md5(html) AS tag, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/]*/([a-z]*)', 1) AS section FROM pages
),
c AS (
  SELECT 3 * page_id AS record_id, page_id, url, 4 * page_id AS time, CASE WHEN page_id % 5 = 0 THEN 'revisit' ELSE 'response' END AS kind, tag, size FROM front
  UNION ALL
  SELECT 3 * page_id + 1, page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://(www\.)?', CASE WHEN page_id % 2 = 0 THEN 'https://WWW.' ELSE 'http://' END)
    || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=mail#again', 4 * page_id + 1 + 4 * (page_id % 1000), 'revisit', CASE WHEN page_id % 7 = 0 THEN 'new' ELSE tag END, NULL FROM front
  UNION ALL
  SELECT 3 * page_id + 2, page_id, 'http://' || host || ':80/', 4 * page_id + 2, CASE WHEN page_id % 3 = 0 THEN 'revisit' ELSE 'response' END, section, size FROM front
),
u AS (SELECT *, regexp_replace(url, '#.*$', '') AS plain FROM c),
x AS (
  SELECT *, lower(regexp_extract(plain, '^([A-Za-z]+)://', 1)) AS scheme, regexp_replace(plain, '^[A-Za-z]+://', '') AS rest FROM u
),
y AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), CASE WHEN scheme = 'https' THEN ':443$' ELSE ':80$' END, ''), '^www\.', '') AS site,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') AS path,
    array_to_string(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_')), '&') AS query FROM x
),
z AS (SELECT *, site || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM y),
b AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN struct_pack(id := record_id, t := tag, n := size, day := time) END IGNORE NULLS)
    OVER (PARTITION BY url_key ORDER BY time, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM z
),
r AS (SELECT *, CASE WHEN base IS NULL THEN 'unresolved' WHEN base.t = tag THEN 'resolved' ELSE 'changed' END AS status FROM b WHERE kind = 'revisit')
SELECT record_id, page_id, url_key, CASE WHEN status = 'resolved' THEN base.id END AS refers_to, status,
  CASE WHEN status = 'resolved' THEN 'content-length=' || base.n || ';content-type=text/html;date=day ' || time || ';etag=' || tag
    ELSE 'date=day ' || time || ';etag=' || tag || ';server=x' END AS headers
FROM r
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS words
  FROM documents
),
s AS (SELECT count(*) FILTER (len(words) > 0) AS n_docs, sum(len(words)) AS total FROM d),
t AS (SELECT r, any_value(doc_id) AS doc_id, any_value(len(words)) AS n, term, count(*) AS tf FROM d, unnest(words) AS u(term) GROUP BY r, term),
f AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term),
i AS (
  SELECT j, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS j, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
),
m AS (
  SELECT j, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total)))) AS score
  FROM i JOIN t USING (term) JOIN f USING (term), s GROUP BY ALL
),
o AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id NULLS LAST) AS place FROM m WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score::BIGINT AS score FROM o WHERE place <= 20
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d
),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + v.v) AS p, 1 + (1000000000 * (k.n + 1)) // (v.total + v.v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
x AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
y AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q
),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM y)
SELECT lang, source, part, item, value::BIGINT AS value, place::INTEGER AS rank FROM z WHERE part = 'pair' OR place <= 200
"""

SQL: dict[str, str] = {"op5_substring": OP5, "op6_revisits": OP6, "op10_jaccard": OP10, "op12_ranking": OP12, "op13_divergence": OP13}
