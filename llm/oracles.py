"""DuckDB SQL for the operators that SQL can express, each from its rule: all windows, all pairs."""

from __future__ import annotations

from llm.license_scan import oracle_sql as license_scan

_WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of 50 units that also start in a document with a smaller id, merged to maximal spans.
_SPANS = """
least AS (SELECT x, min(doc_id) AS lowest FROM windows GROUP BY x),
hits AS (SELECT r, i FROM windows JOIN least USING (x) WHERE lowest < doc_id),
steps AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hits),
numbered AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM steps),
spans AS (SELECT r, k, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY r, k),
gaps AS (
  SELECT r, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY r ORDER BY a)
  UNION ALL SELECT r, max(b), NULL FROM spans GROUP BY r
  UNION ALL SELECT r, 0, NULL FROM units WHERE r NOT IN (SELECT r FROM spans)),
removed AS (SELECT r, sum(b - a) AS n, count(*) AS spans FROM spans GROUP BY r)"""

SUFFIX = f"""
WITH units AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
windows AS (
  SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS x
  FROM (SELECT r, doc_id, h, unnest(range(greatest(0, len(h) // 2 - 49))) AS i FROM units)),
{_SPANS},
kept AS (
  SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY a) AS left_over
  FROM gaps JOIN units USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       coalesce(spans, 0) AS n_spans, sha256(unhex(left_over)) AS kept_sha256
FROM units JOIN kept USING (r) LEFT JOIN removed USING (r)
"""

SUBSTRING = f"""
WITH units AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
windows AS (
  SELECT r, doc_id, i, array_to_string(w[i + 1: i + 50], ' ') AS x
  FROM (SELECT r, doc_id, w, unnest(range(greatest(0, len(w) - 49))) AS i FROM units)),
{_SPANS},
kept AS (
  SELECT r, string_agg(array_to_string(w[a + 1: coalesce(b, len(w))], ' '), ' ' ORDER BY a) FILTER (coalesce(b, len(w)) > a) AS left_over
  FROM gaps JOIN units USING (r) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM units JOIN kept USING (r) LEFT JOIN removed USING (r)
"""

#: Smallest id that links reach, from (x, y) pairs of rows r.
_REACHED = """
sides AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached AS (
  WITH RECURSIVE way(r, node) AS (
    SELECT x, y FROM sides
    UNION SELECT way.r, sides.y FROM way JOIN sides ON sides.x = way.node)
  SELECT r, node FROM way)"""

JACCARD = f"""
WITH units AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
grams AS (
  SELECT DISTINCT r, array_to_string(w[i + 1: i + 5], ' ') AS g
  FROM (SELECT r, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(w) - 4) END)) AS i FROM units)),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
links AS (
  SELECT x, y FROM shared JOIN sizes m ON m.r = x JOIN sizes n ON n.r = y WHERE 100 * common >= 80 * (m.n + n.n - common)),
{_REACHED},
least AS (SELECT reached.r, min(units.doc_id) AS lowest FROM reached JOIN units ON units.r = reached.node GROUP BY reached.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(lowest, doc_id) AS component_id
FROM units LEFT JOIN sizes USING (r) LEFT JOIN least USING (r)
"""

VECTORS = f"""
WITH units AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
         embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0 AS usable
  FROM embeddings),
vectors AS MATERIALIZED (SELECT r, label, v, len(v) AS n FROM units WHERE usable),
links AS (
  SELECT a.r AS x, b.r AS y FROM vectors a JOIN vectors b ON a.label = b.label AND a.n = b.n AND a.r < b.r
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
{_REACHED},
least AS (SELECT reached.r, min(units.vec_id) AS lowest FROM reached JOIN units ON units.r = reached.node GROUP BY reached.r),
counted AS (SELECT x AS r, count(*) AS n FROM sides GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(lowest, vec_id) AS component_id, vec_id = least(lowest, vec_id) AS kept
FROM units LEFT JOIN counted USING (r) LEFT JOIN least USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op5_embedding_near_dedup": VECTORS,
    "op7_suffix_array_dedup": SUFFIX,
    "op9_substring_dedup": SUBSTRING,
    "op10_ngram_jaccard_join": JACCARD,
    "op11_license_scans": license_scan(),
}
