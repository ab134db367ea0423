"""SQL, as DuckDB has it, of those operators that SQL can express."""

from __future__ import annotations

#: Groups: shingles as text, pairs by common shingles, the least id that links reach.
JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN coalesce(len(ws), 0) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY ALL) USING (doc_id)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Windows of items, their occurrences in documents, and the words that they cover.
CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(ws[j:j+k-1], ' ') AS g FROM (SELECT item_id, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS j FROM i WHERE len(ws) > 0)),
dw AS (SELECT doc_id, k, j, array_to_string(ws[j:j+k-1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) AS j FROM d, (SELECT DISTINCT k FROM iw))),
o AS (SELECT doc_id, item_id, j, k FROM dw JOIN iw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS x FROM o) GROUP BY ALL),
f AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS names FROM o GROUP BY ALL)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)
"""

#: Sales by pairs; the checksum bit by bit over the digits of the number.
DOMINANCE = r"""
WITH c AS (SELECT sale_id, list_transform(range(1, length(sale_id::VARCHAR) + 1), lambda i: ascii((sale_id::VARCHAR)[i])::UBIGINT) AS bytes FROM (SELECT DISTINCT sale_id FROM sales)),
k AS (SELECT sale_id, 1 + xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 5 AS w FROM c),
s AS (SELECT sale_id, floor(epoch_us(sold_at) / 1000000 / 60)::BIGINT AS slot, floor(floor(100 * total + 0.5) / 1)::BIGINT AS level FROM sales),
p AS (SELECT slot, level, count(*) AS n, sum(w) AS m FROM s JOIN k USING (sale_id) WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY ALL),
a AS (SELECT x.slot, x.level, coalesce(sum(y.n), 0) AS n, coalesce(sum(y.m), 0) AS m FROM p x LEFT JOIN p y ON y.slot < x.slot AND y.level > x.level GROUP BY ALL)
SELECT sale_id, slot, level, n::BIGINT AS n_sales, m::BIGINT AS n_rows FROM s LEFT JOIN a USING (slot, level)
"""

#: Every kept term of every pair of groups, in numbers of 128 bits.
DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT row, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (s.total + v.v) AS p, 1 + 1000000000 * (k.n + 1) // (v.total + v.v) AS q
  FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
o AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 200
"""

#: Windows as text; words that repeated ones cover.
REPEATS = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT row, i, md5(array_to_string(ws[i:i+34], ' ')) AS g FROM (SELECT row, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
r AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
x AS (SELECT DISTINCT row, unnest(range(i, i + 35)) AS i FROM w SEMI JOIN r USING (g)),
k AS (SELECT d.row, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT row, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d) d ANTI JOIN x USING (row, i) GROUP BY ALL)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (row) LEFT JOIN (SELECT row, count(*) AS n FROM x GROUP BY ALL) USING (row)
"""
