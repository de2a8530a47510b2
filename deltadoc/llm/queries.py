"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from deltadoc.llm.audit import op13_audit
from deltadoc.llm.bitplane import op9_bitplane
from deltadoc.llm.crosstoken import op12_crosstoken
from deltadoc.llm.dartminhash import op8_dartminhash
from deltadoc.llm.divergence import op11_divergence
from deltadoc.llm.langid import op4_langid
from deltadoc.llm.media import op2_ogg
from deltadoc.llm.mixing import op10_mixing
from deltadoc.llm.packing import op1_packing
from deltadoc.llm.permindex import op6_permindex
from deltadoc.llm.quality import op5_quality
from deltadoc.llm.urltree import op7_urltree
from deltadoc.llm.warc import op3_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_ogg": op2_ogg,
    "op3_warc": op3_warc,
    "op4_langid": op4_langid,
    "op5_quality": op5_quality,
    "op6_permindex": op6_permindex,
    "op7_urltree": op7_urltree,
    "op8_dartminhash": op8_dartminhash,
    "op9_bitplane": op9_bitplane,
    "op10_mixing": op10_mixing,
    "op11_divergence": op11_divergence,
    "op12_crosstoken": op12_crosstoken,
    "op13_audit": op13_audit,
}

#: Exact links between all pairs of documents that share a shingle, and their components.
_NEAR_COPIES = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(ws) - 4) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE k >= 0.8 * (na.c + nb.c - k) - 1e-9),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id),
c AS (SELECT id, min(root) AS class_id FROM r GROUP BY id)
SELECT doc_id, CASE WHEN len(ws) > 0 THEN min(doc_id) OVER (PARTITION BY array_to_string(ws, ' ')) ELSE doc_id END AS exact_id, class_id FROM w JOIN c ON id = doc_id"""

#: The same schedule and blocks by windows over whole sources.
_MIXING = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7') AS k FROM documents),
a AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
b AS (SELECT *, CAST([3, 1, 2][(sid - 1) % 3 + 1] AS DOUBLE) AS w, sum(n) OVER () AS total FROM a),
f AS (SELECT *, (total * 1.5 - coalesce(sum(n * 2) OVER (ORDER BY n * 2 / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY n * 2 / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b),
t AS (SELECT sid, source, n, least(n * 2, (SELECT arg_min(level, (n * 2 / w, sid)) FROM f WHERE level <= n * 2 / w) * w) AS target FROM f),
g AS (SELECT *, (sum(target) OVER (ORDER BY sid) - target) / sum(target) OVER () AS low, CASE WHEN sid = max(sid) OVER () THEN 2.0 ELSE sum(target) OVER (ORDER BY sid) / sum(target) OVER () END AS high FROM t),
i AS (SELECT i, i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE) AS u FROM (SELECT unnest(range(1, (SELECT CAST(floor(1.05 * 1.5 * sum(size) / 128) AS BIGINT) + 50 * (count(DISTINCT source) + 1) + 1 FROM d))) AS i)),
m AS (SELECT sid, n, target, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS rank FROM i JOIN g ON u >= low AND u < high),
c AS (SELECT sid, rank % CAST(ceil(n / 128) AS BIGINT) AS block, count(*) AS copies FROM m WHERE rank < floor(target / 128 + 0.5) GROUP BY ALL),
q AS (SELECT doc_id, size, sid, n, target, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
z AS (SELECT *, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS block FROM q WHERE size > 0),
y AS (SELECT doc_id, z.sid, start, sum(coalesce(copies, 0) * (least(start + size, (z.block + 1) * 128) - greatest(start, z.block * 128))) AS taken FROM z LEFT JOIN c ON c.sid = z.sid AND c.block = z.block GROUP BY ALL)
SELECT q.doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN y ON y.sid = q.sid AND y.start = q.start AND y.doc_id IS NOT DISTINCT FROM q.doc_id AND size > 0"""

#: Windows by position, histograms by rows of a table.
_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, lang, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM d),
g AS (SELECT r, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g, count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k FROM w),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) > 1 AS twice FROM g WHERE k = 8),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM h WHERE twice) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, lang, len(ws) AS n, length(list_aggregate(list_concat([''], ws), 'string_agg', '')) AS chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS symbols, coalesce(n_dup_lines, 0) AS dup, coalesce(n_repeat_words, 0) AS rep,
  len(regexp_extract_all(text, '[a-z]')) AS c0, len(regexp_extract_all(text, '[^\x00-\x7F]')) AS c1, len(regexp_extract_all(text, '[A-Z]')) AS c2, len(regexp_extract_all(text, '[0-9]')) AS c3 FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
t AS (SELECT lang, sum(n) AS n, sum(chars) AS chars, sum(c0) AS c0, sum(c1) AS c1, sum(c2) AS c2, sum(c3) AS c3, sum(symbols) AS c4, sum(chars - c0 - c1 - c2 - c3 - symbols) AS c5 FROM m WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n) >= 2000),
top AS (SELECT lang, word, count(*) AS k FROM (SELECT lang, lower(word) AS word FROM w WHERE length(word) <= 5 AND lang IS NOT NULL) GROUP BY lang, word QUALIFY row_number() OVER (PARTITION BY lang ORDER BY k DESC, word) <= 20),
q AS (SELECT top.lang, word, k / t.n AS q FROM top JOIN t USING (lang)),
own AS (SELECT r, lower(word) AS word, count(*) AS k FROM w WHERE length(word) <= 5 GROUP BY ALL),
p AS (SELECT m.r, coalesce(own.k, 0) / m.n AS p, q FROM m JOIN q USING (lang) LEFT JOIN own ON own.r = m.r AND own.word = q.word WHERE m.n >= 100),
pq AS (SELECT * FROM p UNION ALL SELECT r, 1 - sum(p), 1 - sum(q) FROM p GROUP BY r),
cc AS (SELECT r, unnest([m.c0 / m.chars, m.c1 / m.chars, m.c2 / m.chars, m.c3 / m.chars, symbols / m.chars, (m.chars - m.c0 - m.c1 - m.c2 - m.c3 - symbols) / m.chars]) AS p, unnest([t.c0 / t.chars, t.c1 / t.chars, t.c2 / t.chars, t.c3 / t.chars, c4 / t.chars, c5 / t.chars]) AS q FROM m JOIN t USING (lang) WHERE m.chars >= 100),
js AS (SELECT r, 'word' AS what, p, q FROM pq UNION ALL SELECT r, 'class', p, q FROM cc),
dist AS (SELECT r, what, sqrt(greatest(0, sum(CASE WHEN p > 1e-12 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 1e-12 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS x FROM js GROUP BY ALL),
bad AS (SELECT r, max(CASE WHEN x > CASE what WHEN 'word' THEN 0.36 ELSE 0.33 END THEN 1 ELSE 0 END) AS bad FROM dist GROUP BY r)
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, n < 20 OR 100 * rep > 30 * n AS base_failed, NOT (n < 20 OR 100 * rep > 30 * n) AND coalesce(bad, 0) = 0 AS kept FROM m LEFT JOIN bad USING (r)"""

#: Every term of the grid of groups, without histograms.
_AUDIT = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN t USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(t.c, 0) AS c, 1 + (1000000000 * (coalesce(t.c, 0) + 2)) // (n.n + 2 * v.v) AS p, 1 + (1000000000 * (k.c + 2)) // (v.n + 2 * v.v) AS q
  FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN t ON t.lang = n.lang AND t.source = n.source AND t.term = k.term),
e AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT e.lang, e.source, 'pair' AS part, e.item, coalesce(value, 0)::BIGINT AS value FROM e LEFT JOIN s USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM u QUALIFY part = 'pair' OR rank <= 10"""

ORACLE_SQL: dict[str, str] = {
    "op8_dartminhash": _NEAR_COPIES,
    "op10_mixing": _MIXING,
    "op11_divergence": _DIVERGENCE,
    "op13_audit": _AUDIT,
}
