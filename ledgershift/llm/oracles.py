"""DuckDB SQL for the rows of the contracts that SQL can express."""

from __future__ import annotations

from . import chat, infill, line_rules, secret_scan

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, 1 + CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(w) - 4) END)) AS i FROM d)),
n AS (SELECT doc_id, count(h) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
pair AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, pair.b FROM r JOIN pair ON pair.a = r.other),
k AS (SELECT doc_id, md5(string_agg(h, '' ORDER BY h)) AS k FROM s GROUP BY doc_id),
l AS (SELECT a AS doc_id, count(DISTINCT y.k) AS n_links FROM pair JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE x.k <> y.k GROUP BY a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(other) AS component_id, coalesce(any_value(l.n_links), 0)::BIGINT AS n_links
FROM n JOIN r ON r.doc_id = n.doc_id LEFT JOIN l ON l.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS weight FROM s),
f AS (SELECT *, coalesce(sum(source_size * 2) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left, sum(source_size) OVER () AS total FROM w WINDOW o AS (ORDER BY source_size / weight, source IS NULL, source)),
l AS (SELECT *, (total * 1.5::DOUBLE - full_before) / weight_left AS level FROM f),
t AS (SELECT source, source_size, weight, max(CASE WHEN level * weight <= source_size * 2 THEN level END) OVER () AS level FROM l),
g AS (SELECT source, source_size, weight, least(source_size * 2, coalesce(level * weight, source_size * 2)) AS target FROM t),
x AS (SELECT d.doc_id, d.size, source_size, target, weight, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
y AS (SELECT *, greatest(0, least(size, floor(target) - b)) AS t0, greatest(0, least(size, floor(target) - source_size - b)) AS t1,
  CASE weight WHEN 3 THEN 1.5 WHEN 1 THEN 0.5 ELSE 1 END::DOUBLE AS p, CASE weight WHEN 3 THEN 0.5 WHEN 1 THEN 1.5 ELSE 1 END::DOUBLE AS q FROM x),
z AS (SELECT *, CASE WHEN t0 > 0 THEN (b + t0 / 2) / target END AS a0, CASE WHEN t1 > 0 THEN (source_size + b + t1 / 2) / target END AS a1 FROM y)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, (t0 + t1)::BIGINT AS taken,
  CASE WHEN p = q THEN a0 ELSE (sqrt(p * p + (q * q - p * p) * a0) - p) / (q - p) END AS position,
  CASE WHEN p = q THEN a1 ELSE (sqrt(p * p + (q * q - p * p) * a1) - p) / (q - p) END AS again_position FROM z
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 48))) AS i FROM d)),
m AS (SELECT h, min(doc_id) AS f FROM x GROUP BY h),
g AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM x JOIN m USING (h) WHERE f < doc_id), range(50) AS t(k)),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) AS kept FROM u LEFT JOIN g USING (doc_id, p) WHERE g.p IS NULL GROUP BY u.doc_id),
r AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)
"""

ORACLE_SQL = {
    "op2_ngram_jaccard_join": NGRAM_JOIN,
    "op4_quality_rules": line_rules.ORACLE,
    "op5_chat_formatting": chat.ORACLE,
    "op8_mixing": MIXING,
    "op10_substring_dedup": SUBSTRINGS,
    "op12_secret_scan": secret_scan.ORACLE,
    "op13_fill_in_middle": infill.ORACLE,
}
