"""SQL for DuckDB with the rows of queries that compare whole texts: the plain definition, by all strings and all pairs that share a shingle."""

from __future__ import annotations

#: Every string of 200 bytes by its place; a byte goes if such a string over it starts twice or more.
REPEATED_BYTES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
     w AS (SELECT r, i, substr(x, 2 * i + 1, 400) AS s FROM (SELECT r, x, unnest(range(0, greatest(length(x) // 2 - 199, 0))) AS i FROM d)),
     h AS (SELECT md5_number(s) AS h, r, i FROM w),
     again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
     new AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS first FROM again),
     run AS (SELECT r, i, sum(first) OVER (PARTITION BY r ORDER BY i) AS g FROM new),
     span AS (SELECT r, g, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY r, g),
     gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span),
     cut AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last FROM span GROUP BY r),
     kept AS (SELECT gap.r, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k FROM gap JOIN d ON d.r = gap.r GROUP BY gap.r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, '') || substr(x, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.r = d.r LEFT JOIN kept ON kept.r = d.r
"""

#: Distinct shingles of two words, all pairs that share one, and what can be reached.
NEAR_DUPLICATES = r"""
WITH RECURSIVE
     d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
           FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
     n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     both_sides AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
     link AS MATERIALIZED (SELECT u, v FROM both_sides JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
     reach AS (SELECT u, v FROM link UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u),
     nearest AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN nearest ON nearest.u = d.doc_id
"""
