"""DuckDB SQL of the queries that it can express."""

from __future__ import annotations

SQL = {
    "op11_fim": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
l AS (
  SELECT *, CASE WHEN t = '' THEN [] WHEN t LIKE E'%\n' THEN string_split(t, E'\n')[:-2] ELSE string_split(t, E'\n') END AS lines,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
),
c AS (
  SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM l
),
p AS (
  SELECT *, least(length(t), coalesce(list_sum(list_transform(lines[1:a], lambda x: length(x) + 1)), 0))::BIGINT AS p,
    least(length(t), coalesce(list_sum(list_transform(lines[1:b], lambda x: length(x) + 1)), 0))::BIGINT AS q
  FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || t[1:p] || '<S>' || t[q + 1:] || '<M>' || t[p + 1:q]
    ELSE '<S>' || t[q + 1:] || '<P>' || t[1:p] || '<M>' || t[p + 1:q] END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p""",
    "op12_mixing": r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS name, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || md5('12:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, '')))[1:15])::BIGINT AS place
  FROM documents
),
s AS (SELECT none, name, sum(size)::HUGEINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY none, name) - 1) % 3] AS weight, 2 * source_size AS cap FROM s),
o AS (
  SELECT *, sum(source_size) OVER () AS total, coalesce(sum(cap) OVER (ORDER BY cap / weight, none, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
    sum(weight) OVER (ORDER BY cap / weight, none, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w
),
f AS (SELECT *, (3 * total - 2 * clamped) * weight <= 2 * cap * open AS fits FROM o),
v AS (SELECT arg_min((3 * total - 2 * clamped)::DOUBLE / (2 * open)::DOUBLE, {'r': cap / weight, 'a': none, 'b': name}) FILTER (fits) AS level FROM f),
g AS (SELECT none, name, source_size, coalesce(least(cap::DOUBLE, weight * level), cap::DOUBLE) AS target FROM f, v),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS times FROM g),
b AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY none, name ORDER BY place, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (times * size + greatest(0, least(size, quota - times * source_size - before)))::BIGINT AS taken
FROM b JOIN q USING (none, name)""",
    "op13_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
),
e AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
l AS (SELECT lang, term, count(*) AS m FROM e GROUP BY ALL HAVING count(DISTINCT row) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, l.term, l.m, coalesce(n, 0) AS n FROM g JOIN l USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM e GROUP BY ALL) USING (lang, source, term)),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(m) OVER (PARTITION BY lang, source) AS lang_total, count(*) OVER (PARTITION BY lang, source) AS v FROM c),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (total + 5 * v) AS p, 1 + 1000000000::HUGEINT * (m + 5) // (lang_total + 5 * v) AS q FROM s),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT i.lang, i.source AS s1, j.source AS s2, sum(abs(i.p - j.p)) AS x FROM p i JOIN p j ON i.lang = j.lang AND i.term = j.term GROUP BY ALL) k
    ON k.lang = a.lang AND s1 = a.source AND s2 = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM k WHERE part = 'pair' OR rank <= 50""",
}
