"""SQL counterparts of the corpus queries."""

from __future__ import annotations

LLM_SQL: dict[str, str] = {}

LLM_SQL["op5_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

LLM_SQL["op2_url_filter"] = """
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), judged AS (
  SELECT *,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

# Base32 of SHA-1: eight groups of five hex digits are four letters each.
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((g >> {shift}) & 31)::INT, 1)"
_LETTERS = " || ".join(_LETTER.format(shift=shift) for shift in (15, 10, 5, 0))

LLM_SQL["op10_warc"] = f"""
WITH bodies AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM bodies
)
SELECT page_id,
       strlen(body) AS payload_bytes,
       list_aggregate(list_transform(
         list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INT, 5))::BIGINT),
         lambda g: {_LETTERS}), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_WHOLE = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE))"

LLM_SQL["op11_voronoi_knn"] = f"""
WITH e AS (SELECT vec_id, {_WHOLE} AS v FROM embeddings WHERE {_FINITE}),
scored AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
  FROM e q JOIN e ON e.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER best)::INT AS rank, vec_id, score
FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
"""

LLM_SQL["op13_hard_negatives"] = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS v
  FROM embeddings
  WHERE label IS NOT NULL AND {_FINITE}
), scored AS (
  SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score
  FROM e a JOIN e ON e.vec_id <> a.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER best)::INT AS rank, n.vec_id AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM positives p
JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW best AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER best <= 10
"""

LLM_SQL["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), n AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), counted AS (
  SELECT lang, words, phrase, count(*) AS f
  FROM (
    SELECT lang, size AS words,
           unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM worded, (VALUES (1), (2), (3)) sizes(size)
    WHERE len(w) >= size
  )
  GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, string_split(c.phrase, ' ') AS w
  FROM counted c, (VALUES (1), (2)) ks(k)
  WHERE c.words > k
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts
  JOIN counted x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[:k], ' ')
  JOIN counted y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, k) = 1
), covered AS (
  SELECT lang, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase, f AS longer
  FROM (SELECT lang, string_split(phrase, ' ') AS w, f FROM counted WHERE words = 3)
)
SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n, score
FROM scored s JOIN n USING (lang)
WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = s.lang AND c.phrase = s.phrase AND 100 * c.longer >= 50 * s.a)
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER best <= 2000
"""
