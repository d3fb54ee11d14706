"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256,
       octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

MIXTURE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * (1000 + least(size, 1000)))::BIGINT AS tilted FROM d GROUP BY source),
s1 AS (SELECT *, 3 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open FROM s1),
lv AS (SELECT rest, open FROM s2 WHERE rest * weight <= cap * open ORDER BY cap::DOUBLE / weight, open DESC LIMIT 1),
s3 AS (SELECT source, source_size, tilted,
         CASE WHEN weight * lv.rest >= cap * lv.open THEN cap::DOUBLE
              ELSE (weight * lv.rest)::DOUBLE / lv.open::DOUBLE END AS target FROM s2, lv),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size)::BIGINT, 3) ELSE 0 END AS whole FROM s3),
s5 AS (SELECT *, target - whole * source_size AS left_over FROM s4),
p AS (SELECT d.*, s5.* EXCLUDE (source), least(greatest(CASE WHEN tilted > 0
         THEN left_over * (1000 + least(size, 1000)) / tilted::DOUBLE ELSE 0 END, 1e-9::DOUBLE), (1 - 1e-9)::DOUBLE) AS share
      FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
q AS (SELECT *, ln(u) - ln(1 - u) - (ln(share) - ln(1 - share)) AS odds FROM p),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM q),
g AS (SELECT source, left_over - coalesce(max(running) FILTER (running <= left_over), 0) AS gap
      FROM r GROUP BY source, left_over),
c AS (SELECT r.source, arg_min(doc_id, (abs(gap - size), odds, doc_id)) AS closing
      FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source
      WHERE running > left_over AND abs(gap - size) < gap GROUP BY r.source)
SELECT doc_id, size, source_size, target,
       least(whole + (running <= left_over OR coalesce(doc_id = closing, FALSE))::BIGINT, 3) * size AS taken
FROM r LEFT JOIN c ON r.source IS NOT DISTINCT FROM c.source
"""

QUALITY = """
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda a, _: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
voc AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT unnest(w) AS gram FROM d)),
crc AS (SELECT gram, xor(list_reduce([4294967295] ||
         list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
         lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 65536 AS b FROM voc, tab),
one AS (SELECT r, doc_id, i, b FROM (SELECT r, doc_id, unnest(w) AS gram, generate_subscripts(w, 1) AS i FROM d) JOIN crc USING (gram)),
g0 AS (SELECT r, doc_id, b FROM one UNION ALL
       SELECT x.r, x.doc_id, (x.b * 31421 + y.b + 1) % 65536 FROM one x JOIN one y ON x.r = y.r AND y.i = x.i + 1),
good AS (SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL
         ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100000),
g AS (SELECT r, b, good.id IS NOT NULL AS good FROM g0 LEFT JOIN good ON g0.doc_id = good.id),
n AS (SELECT b, count(*) AS raw, count(*) FILTER (good) AS good FROM g GROUP BY b),
tot AS (SELECT sum(raw)::DOUBLE AS raw_all, sum(good)::DOUBLE AS good_all FROM n),
wt AS (SELECT b, CASE WHEN good_all > 0 THEN
         round(ln(((good + 1.0::DOUBLE) / (good_all + 65536)) / ((raw + 1.0::DOUBLE) / (raw_all + 65536))) * 1000000)::BIGINT
         ELSE 0 END AS v FROM n, tot),
sums AS (SELECT r, sum(v)::BIGINT AS s FROM g JOIN wt USING (b) GROUP BY r),
win AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS k FROM d),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + o.o) AS n FROM rep, range(3) AS o(o) GROUP BY r),
base AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(x) - len(list_distinct(x)))::BIGINT AS n_dup_lines
       FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS x FROM d)),
f AS (SELECT base.*, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, s FROM base LEFT JOIN cov USING (r) LEFT JOIN sums USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       floor(s::DOUBLE / (2 * n_words - 1))::BIGINT AS llr,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND s >= -250000 * (2 * n_words - 1) AS kept
FROM f
"""

RANKED = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
tot AS (SELECT count(*)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, tot GROUP BY term, nn),
doc AS (SELECT r, doc_id, 50 + ((50 * len(w)::BIGINT * nn) // ll) AS m FROM d, tot WHERE len(w) > 0),
asked AS (SELECT DISTINCT q, item_id, unnest(w) AS term FROM b),
s AS (SELECT q, item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM asked JOIN tf USING (term) JOIN wt USING (term) JOIN doc USING (r) GROUP BY q, item_id, r),
k AS (SELECT q, item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank
      FROM s JOIN doc USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""

DIVERGENCE = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, coalesce(v.v, 0) AS v
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL) USING (lang, source)
      LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
      FROM g JOIN kept USING (lang) LEFT JOIN cells USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // ((SELECT sum(total) FROM g WHERE g.lang = p.lang) + 5 * any_value(v.v)) AS q
      FROM p JOIN v USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.f, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f
                 FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
        ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
a AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM a)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 50
"""
