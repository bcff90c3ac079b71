"""SQL for DuckDB that gives the rows of numbered queries, by plain definitions and all pairs.

Tables of these queries have ids of their own per row; the operators' docstrings tell what holds otherwise.
"""

from __future__ import annotations

WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM f"""

# Components: the smallest id that every node reaches over links, nodes without links alone.
_REACHED = """reached(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reached r JOIN links l ON r.other = l.a),
least AS (SELECT id, min(other) AS other FROM reached GROUP BY id)"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE list_inner_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
{_REACHED},
degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.other, vec_id)) AS component_id,
  least(vec_id, coalesce(least.other, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN degree ON vec_id = degree.id LEFT JOIN least ON vec_id = least.id"""

NGRAMS = rf"""WITH RECURSIVE w AS (SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
{_REACHED}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least.other, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON doc_id = least.id"""

# Texts as hexadecimal digits: two for each byte, so that byte strings are substrings.
REPEATS = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS s, h FROM t),
named AS (SELECT doc_id, s, sha256(substr(h, 2 * s + 1, 200)) AS name FROM starts),
again AS (SELECT doc_id, s FROM named QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, s) > 1),
runs AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM again)),
spans AS (SELECT doc_id, min(s) AS low, max(s) + 100 AS high FROM runs GROUP BY doc_id, run),
bounds AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM spans),
pieces AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS kept,
  max(high) AS high, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans FROM bounds JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(high, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN pieces USING (doc_id)"""
