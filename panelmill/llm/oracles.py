"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from .sharding import PRIME, rounds

#: CRC-32 of a text's UTF-8 bytes, with its table from the rule.
CRC = """xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT)),
  lambda c, b: xor(c >> 8, crc_table[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)"""

CRC_TABLE = "SELECT list(list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, n) ORDER BY n) AS crc_table FROM range(256) r(n)"

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN s sx ON sx.doc_id = x JOIN s sy ON sy.doc_id = y WHERE 100 * o >= 75 * (len(sx.sh) + len(sy.sh) - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM s JOIN r ON s.doc_id = r.x GROUP BY s.doc_id, len(s.sh)
"""

OP3 = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP10 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g USING (text)
"""


OP11 = r"""
WITH lower AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT rid, doc_id, ts, len(ts) AS n FROM lower WHERE len(ts) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM d),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), total),
q AS (SELECT item, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM (SELECT row_number() OVER () AS item, * FROM benchmark)),
m AS (SELECT rid, doc_id, 10 + (90 * n * docs) // len AS m FROM d, total),
s AS (SELECT item, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

#: The rates of op12 are those of quality_rules.RATES.
OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
w AS (SELECT rid, i, ws[i] AS w, CASE WHEN i + 2 <= len(ws) THEN array_to_string(ws[i:i + 2], ' ') END AS three FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM t)),
again AS (SELECT rid, three FROM w WHERE three IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
places AS (SELECT w.rid, unnest([i, i + 1, i + 2]) AS i FROM w JOIN again USING (rid, three)),
repeats AS (SELECT rid, count(DISTINCT i) AS n FROM places GROUP BY rid),
c AS (SELECT d.*, len(ws) AS n_words, coalesce(CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT), 0) AS word_chars, n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words FROM d JOIN t USING (rid) LEFT JOIN repeats USING (rid)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS r1, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS r2,
  CASE WHEN n_words > 0 THEN 1000 * n_dup_lines // n_words ELSE 0 END AS r3, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS r4 FROM c),
v AS (SELECT lang, source, unnest(['r1', 'r2', 'r3', 'r4']) AS rate, unnest([r1, r2, r3, r4]) AS v, unnest([150, 12, 8, 45]) AS unit FROM j WHERE NOT base_failed),
b AS (SELECT lang, source, rate, unit, (v >> greatest(length(bin(v)) - 9, 0)) << greatest(length(bin(v)) - 9, 0) AS b FROM v),
levels AS (SELECT 'source' AS level, lang, source, rate, unit, b FROM b UNION ALL SELECT 'lang', lang, NULL, rate, unit, b FROM b UNION ALL SELECT 'all', NULL, NULL, rate, unit, b FROM b),
ranked AS (SELECT *, count(*) OVER (PARTITION BY level, lang, source, rate ORDER BY b) AS upto, count(*) OVER (PARTITION BY level, lang, source, rate) AS size FROM levels),
q AS (SELECT level, lang, source, rate, unit, max(size) AS size, min(b) FILTER (4 * upto >= size) AS q1, min(b) FILTER (4 * upto >= 3 * size) AS q3 FROM ranked GROUP BY ALL),
h AS (SELECT level, lang, source, max(size) AS size, min(q1 - 8 * greatest(q3 - q1, unit)) FILTER (rate = 'r1') AS low1, max(q3 + 8 * greatest(q3 - q1, unit)) FILTER (rate = 'r1') AS high1,
  max(q3 + 8 * greatest(q3 - q1, unit)) FILTER (rate = 'r2') AS high2, max(q3 + 8 * greatest(q3 - q1, unit)) FILTER (rate = 'r3') AS high3, max(q3 + 8 * greatest(q3 - q1, unit)) FILTER (rate = 'r4') AS high4 FROM q GROUP BY ALL),
k AS (SELECT j.*, CASE WHEN s.size >= 200 THEN s WHEN l.size >= 200 THEN l ELSE a END AS h FROM j LEFT JOIN h s ON s.level = 'source' AND s.lang IS NOT DISTINCT FROM j.lang AND s.source IS NOT DISTINCT FROM j.source
  LEFT JOIN h l ON l.level = 'lang' AND l.lang IS NOT DISTINCT FROM j.lang LEFT JOIN h a ON a.level = 'all')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(r1 >= h.low1 AND r1 <= h.high1 AND r2 <= h.high2 AND r3 <= h.high3 AND r4 <= h.high4, FALSE) AS kept FROM k
"""


def op13() -> str:
    """The pass is a recursion over turns; each step has every edit of a turn with every insert after it."""
    crc = CRC.format(text="(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")
    return rf"""
WITH RECURSIVE raw AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h FROM conversations, ({CRC_TABLE})),
dam AS (SELECT rid, conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE h <> 0),
f AS (SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w || role[1] AS two, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid, copy) > 1 AS again,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM dam WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), rid, copy)),
g AS (SELECT *, last = '' AS blank, last <> '' AND again AS dup, last NOT IN ('', '.', '!', '?') AND NOT again AS trunc FROM f),
moves(s, letter, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
close(s, t, n, rep) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, 'user:'), (1, 2, 1, 'user:'), (3, 2, 1, 'user:'), (2, 3, 1, 'assistant:'), (0, 3, 2, 'user:' || chr(10) || 'assistant:'), (1, 3, 2, 'user:' || chr(10) || 'assistant:')),
edits AS (
  SELECT conv_id, i, s.s, s.s AS t, 3 AS c, 'D' AS e, NULL AS rep FROM g, (SELECT unnest(range(4)) AS s) s
  UNION ALL SELECT conv_id, i, s, t, trunc::INT, 'K', role || ':' || text FROM g JOIN moves ON role[1] = letter WHERE NOT blank AND NOT dup
  UNION ALL SELECT conv_id, i, s, t, 2 + trunc::INT, 'R', CASE letter WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text FROM g JOIN moves ON role[1] <> letter AND letter <> 's' WHERE NOT blank AND NOT dup),
v AS (
  SELECT conv_id, 0 AS i, t AS s, 2 * n AS cost, repeat('I', n) AS audit, CASE WHEN n > 0 THEN close.rep END AS rep FROM (SELECT DISTINCT conv_id FROM raw) JOIN close ON close.s = 0
  UNION ALL
  SELECT conv_id, i, s, b.cost, b.audit, b.rep FROM (
    SELECT v.conv_id, v.i + 1 AS i, close.t AS s, min(struct_pack(cost := v.cost + e.c + 2 * close.n, audit := v.audit || e.e || repeat('I', close.n),
      rep := CASE WHEN e.rep IS NULL AND close.n = 0 THEN v.rep ELSE concat_ws(chr(10), v.rep, e.rep, CASE WHEN close.n > 0 THEN close.rep END) END)) AS b
    FROM v JOIN edits e ON e.conv_id IS NOT DISTINCT FROM v.conv_id AND e.i = v.i + 1 AND e.s = v.s JOIN close ON close.s = e.t GROUP BY ALL)),
n AS (SELECT conv_id, max(i) AS last, sum(blank::INT) AS blank, sum(dup::INT) AS duplicate, sum(trunc::INT) AS truncated, sum(coalesce(two NOT IN ('su', 'ua', 'au'), FALSE)::INT) AS illegal,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM g GROUP BY conv_id),
best AS (SELECT v.conv_id, min(struct_pack(cost := cost, audit := audit, rep := rep)) AS b FROM v LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM v.conv_id WHERE v.i = coalesce(n.last, 0) AND v.s IN (0, 3) GROUP BY v.conv_id)
SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(b.cost AS BIGINT) AS cost, b.audit AS audit, sha256(coalesce(b.rep, '')) AS repaired_sha256
FROM best LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM best.conv_id
"""


def op8(shards: int = 40, seed: int = 0) -> str:
    """The walk is a recursion over the rows whose number still lies outside."""
    sql, keys = "SELECT *, v % a AS l0, v // a AS r0 FROM {0}", rounds(seed)
    for i, (m, c, d) in enumerate(keys):
        left = i % 2 == 0
        y = f"(({f'r{i}' if left else f'l{i}'} * {m} + {c}) % {PRIME})"
        f = f"(({y} * {y} + {d}) % {PRIME})"
        sides = (f"(l{i} + {f}) % a", f"r{i}") if left else (f"l{i}", f"(r{i} + {f}) % b")
        sql = f"SELECT *, {sides[0]} AS l{i + 1}, {sides[1]} AS r{i + 1} FROM ({sql})"
    sql = f"SELECT row_number, n, a, b, r{len(keys)} * a + l{len(keys)} AS v FROM ({sql})"
    return f"""
WITH RECURSIVE rows AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size, coalesce(text, '') AS text FROM documents),
one AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS root FROM rows),
total AS (SELECT n, a, CAST(ceil(n / a::DOUBLE) AS BIGINT) AS b FROM one, (SELECT unnest(range(greatest(1, root - root // 2), root + 1)) AS a FROM one) ORDER BY CAST(ceil(n / a::DOUBLE) AS BIGINT) * a, a DESC LIMIT 1),
numbered AS (SELECT doc_id, size, {CRC.format(text='text')} AS text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS row_number FROM rows, ({CRC_TABLE})),
start AS (SELECT row_number, row_number AS v, n, a, b FROM numbered, total),
walk AS ({sql.format('start')} UNION ALL {sql.format('(SELECT row_number, n, a, b, v FROM walk WHERE v >= n)')})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(v % {shards} AS INTEGER) AS shard, v // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, row_number
FROM numbered JOIN (SELECT * FROM walk WHERE v < n) USING (row_number)
"""
