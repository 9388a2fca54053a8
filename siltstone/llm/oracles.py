"""SQL of the queries that SQL can express, written from their contracts alone."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links come from counts of common shingles, components from the closure of the links.
JACCARD = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS item FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM items a JOIN items b USING (item) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * n >= 85 * (len(a.s) + len(b.s) - n)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM both_ways UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, (SELECT min(y) FROM reach WHERE x = doc_id)) AS component_id FROM sets"""

#: Base32 takes five bits at a time from three hexadecimal digits.
WARC = """
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
told AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) || '00' AS h, max(page_id) OVER (PARTITION BY body) AS head FROM bodies)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(5 * i // 4 AS INT) + 1, 3) AS INT) >> CAST(7 - (5 * i) % 4 AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM told"""

#: Documents' runs of words of each window length that an item has, joined with the items' windows.
DECONTAMINATE = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS g
  FROM (SELECT *, least(10, len(w)) AS n FROM items WHERE len(w) > 0)),
runs AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS g
  FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM runs JOIN windows USING (n, g)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)"""

#: All windows of 100 bytes, as hexadecimal digits taken from pieces of 1000 places; all but the first of equal ones are covered.
REPEATS = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
pieces AS (SELECT doc_id, n, k, substr(h, 2000 * k + 1, 2198) AS part FROM (SELECT *, unnest(range(0, n // 1000 + 1)) AS k FROM docs)),
windows AS (SELECT doc_id, 1000 * k + j AS p, md5(substr(part, 2 * j + 1, 200)) AS m FROM (SELECT *, unnest(range(0, least(1000, n - 99 - 1000 * k))) AS j FROM pieces)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) AS nth FROM windows) WHERE nth > 1),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT doc_id, p, CAST(p > 100 + lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS INT) AS fresh FROM late)) GROUP BY doc_id, coalesce(run, 0)),
kept AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM runs UNION ALL SELECT doc_id, coalesce(max(b), 0), max(n) FROM docs LEFT JOIN runs USING (doc_id) GROUP BY doc_id),
texts AS (SELECT doc_id, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS rest FROM kept JOIN docs USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM docs JOIN texts USING (doc_id) LEFT JOIN counts USING (doc_id)"""

SQL = {"op5_suffix_dedup": REPEATS, "op7_jaccard_components": JACCARD, "op8_warc_salvage": WARC, "op9_positional_index": DECONTAMINATE}
