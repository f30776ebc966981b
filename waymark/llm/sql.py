"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"

JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
shingles AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s FROM words),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM shingles),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM shingles s JOIN reach r ON r.id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest([array_to_string(w[i : i + least(10, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS x
  FROM b WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM items),
windows AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest([array_to_string(w[i : i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS x
  FROM d, lengths WHERE len(w) >= n),
hits AS (SELECT w.doc_id, w.n, w.i, t.item_id FROM windows w JOIN items t ON t.n = w.n AND t.x = w.x),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_SPACED}'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest([md5_number(array_to_string(w[i : i + 12], ' ')) FOR i IN range(1, len(w) - 11)]) AS x
  FROM d WHERE len(w) >= 13),
gone AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS least FROM windows) WHERE least < doc_id),
removed AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS r FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, w, coalesce(len(r), 0) AS n, map_from_entries([(j, true) FOR j IN coalesce(r, [])]) AS r FROM d LEFT JOIN removed USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN n = 0 THEN w ELSE [w[j] FOR j IN range(1, len(w) + 1) IF r[j] IS NULL] END, ' '), '')) AS kept_sha256
FROM kept
"""


LINES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
f AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '[^\x20\x09-\x0D]')) AS f FROM d),
ends AS (SELECT doc_id, l, unnest(f[1 : len(f) - 1]) AS a, unnest(f[2 :]) AS b FROM f WHERE len(f) > 1),
p AS (SELECT doc_id, a, b, md5(array_to_string(l[a : b], chr(10))) AS x FROM ends),
first AS (SELECT doc_id, a, b, first_value(doc_id) OVER w AS fd, first_value(b) OVER w AS fb FROM p WINDOW w AS (PARTITION BY x ORDER BY doc_id, a)),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(a, b + 1)))) AS g FROM first WHERE fd <> doc_id OR fb < a GROUP BY doc_id),
kept AS (SELECT d.doc_id, text, l, coalesce(len(g), 0) AS n, map_from_entries([(j, true) FOR j IN coalesce(g, [])]) AS g FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(n AS BIGINT) AS n_removed,
  sha256(CASE WHEN n = 0 THEN text ELSE coalesce(array_to_string([l[j] FOR j IN range(1, len(l) + 1) IF g[j] IS NULL], chr(10)), '') END) AS kept_sha256 FROM kept
"""

SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(length(hex(encode(coalesce(text, '')))) // 2 AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS x FROM w)),
g AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM k WHERE r > 1),
s AS (SELECT doc_id, sum(least(100, coalesce(nx - i, 100))) AS removed, count(*) FILTER (nx IS NULL OR nx > i + 100) AS spans FROM g GROUP BY doc_id),
pieces AS (SELECT doc_id, 0 AS a, min(i) AS b FROM g GROUP BY doc_id UNION ALL SELECT g.doc_id, i + 100, coalesce(nx, n) FROM g JOIN d ON d.doc_id = g.doc_id WHERE nx IS NULL OR nx > i + 100),
kept AS (SELECT p.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM pieces p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

MIX = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_SPACED}')), 0) AS BIGINT) AS size, md5(doc_id || '|17') AS u FROM documents),
src AS (SELECT source, sum(size) AS s, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS w FROM d GROUP BY source),
ord AS (SELECT *, 3.0::DOUBLE * s / w AS top, sum(s) OVER () AS total, row_number() OVER (ORDER BY 3.0::DOUBLE * s / w, source) AS k FROM src),
lev AS (SELECT *, (total - 3 * coalesce(sum(s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ord),
cap AS (SELECT min(k) AS k FROM lev WHERE level <= top),
goal AS (SELECT source, CAST(s AS BIGINT) AS s, CASE WHEN k < (SELECT k FROM cap) THEN 3.0::DOUBLE * s ELSE w * (SELECT level FROM lev WHERE k = (SELECT k FROM cap)) END AS target FROM lev),
base AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE least(3, CAST(floor(target / s + 1e-9) AS BIGINT)) END AS b FROM goal),
run AS (SELECT d.*, s, target, b, greatest(0, target - s * b) AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN base ON base.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, s AS source_size, target, CAST(size * least(3, b + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM run
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": JACCARD, "op5_line_dedup": LINES, "op6_benchmark_decontamination": DECONTAMINATION, "op8_source_mix": MIX, "op9_substring_dedup": SUBSTRINGS, "op10_suffix_array_dedup": SUFFIXES}
