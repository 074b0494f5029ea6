"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from lagscope.llm.quality_rules import DUPLICATED, LINE_CHARS, LINES, SYMBOLS_PER_WORD, TOP

WORD = r"[^\x20\x09-\x0D]+"


def _pick(table: str, column: str, n: int) -> str:
    return f"coalesce(max({table}.{column}) FILTER ({table}.n = {n}), 0)"


QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w0 AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
p AS (SELECT rid, i, length(ws[i]) AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w0)),
g AS (SELECT a.rid, a.n, a.i, a.gram, count(*) OVER (PARTITION BY a.rid, a.n, a.gram) AS k FROM (
    {" UNION ALL ".join(f"SELECT rid, {n} AS n, i, array_to_string(ws[i:i + {n - 1}], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w0)" for n in sorted({3, *TOP, *DUPLICATED}))}) a),
r AS (SELECT * FROM g WHERE k > 1),
cover AS (SELECT q.rid, q.n, count(*) AS words, sum(p.c) AS chars FROM (SELECT DISTINCT rid, n, i + unnest(range(n)) AS i FROM r) q JOIN p ON p.rid = q.rid AND p.i = q.i GROUP BY q.rid, q.n),
best AS (SELECT rid, n, max(k * (length(gram) - n + 1)) AS chars FROM r GROUP BY rid, n),
lines0 AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
lines1 AS (SELECT rid, l, list_sum(list_transform(regexp_extract_all(l, '{WORD}'), lambda x: length(x))) AS c FROM lines0 WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
lines2 AS (SELECT rid, l, max(c) AS c, count(*) AS k FROM lines1 GROUP BY rid, l),
lines3 AS (SELECT rid, sum(k) AS n, sum(k - 1) AS dup, sum((k - 1) * c) AS dup_chars, sum(k * c) AS chars FROM lines2 GROUP BY rid),
b AS (SELECT w0.rid, w0.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(l.n, 0) AS n_lines,
    coalesce(l.dup_chars, 0)::DOUBLE / greatest(coalesce(l.chars, 0), 1) AS dup_line_share
  FROM w0 LEFT JOIN lines3 l ON l.rid = w0.rid),
c AS (SELECT rid, {", ".join(f"{_pick('cover', 'chars', n)} AS c{n}" for n in sorted(DUPLICATED))}, {_pick("cover", "words", 3)} AS rep FROM cover GROUP BY rid),
t AS (SELECT rid, {", ".join(f"{_pick('best', 'chars', n)} AS t{n}" for n in sorted(TOP))} FROM best GROUP BY rid),
s AS (SELECT b.*, coalesce(c.rep, 0)::BIGINT AS n_repeat_words,
    {", ".join(f"coalesce(c.c{n}, 0)::DOUBLE / greatest(word_chars, 1) AS d{n}" for n in sorted(DUPLICATED))},
    {", ".join(f"coalesce(t.t{n}, 0)::DOUBLE / greatest(word_chars, 1) AS u{n}" for n in sorted(TOP))}
  FROM b LEFT JOIN c ON c.rid = b.rid LEFT JOIN t ON t.rid = b.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join([f"d{n} > {x}" for n, x in DUPLICATED.items()] + [f"u{n} > {x}" for n, x in TOP.items()])}
    OR dup_line_share > {LINE_CHARS} OR n_dup_lines > {LINES} * n_lines OR n_symbols > {SYMBOLS_PER_WORD} * n_words) AS kept,
  greatest({", ".join(f"u{n}" for n in TOP)}) AS top_share, greatest({", ".join(f"d{n}" for n in DUPLICATED)}) AS dup_share, dup_line_share
FROM f
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN k.keeper IS NOT NULL AND k.keeper IS DISTINCT FROM d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.keeper IS DISTINCT FROM d.page_id THEN k.keeper END AS refers_to
FROM d LEFT JOIN k ON d.payload_digest = k.payload_digest AND d.payload_bytes >= 1000
"""

ORACLE: dict[str, str] = {"op1_quality_rules": QUALITY_RULES, "op6_warc": WARC}

FILTER_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT d.*, regexp_extract_all(t, '{WORD}') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
f AS (SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first_id, false)::INT AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (SELECT o, s, instr('ABCDE', substr(o, s, 1)) - 1 AS bit FROM orders, range(1, 6) r(s)),
parts AS (SELECT DISTINCT part FROM f),
hit AS (SELECT f.*, o.o, (SELECT min(s) FROM steps x WHERE x.o = o.o AND (f.mask >> x.bit) & 1 = 1) AS gone FROM f, orders o),
by_step AS (SELECT h.part, st.o, st.s, st.bit,
    count(*) FILTER (h.gone IS NULL OR h.gone > st.s) AS kept,
    count(*) FILTER (h.gone = st.s) AS removed,
    count(*) FILTER (h.gone < st.s AND (h.mask >> st.bit) & 1 = 1) AS redundant,
    count(*) FILTER (h.mask = 1 << st.bit) AS unique_fails,
    count(*) FILTER (h.gone = st.s AND h.good = 1) AS good_lost,
    count(*) FILTER (h.gone = st.s AND h.toxic = 1) AS toxic_lost
  FROM hit h JOIN steps st ON st.o = h.o GROUP BY ALL),
grid AS (SELECT p.part, st.o, st.s, st.bit FROM parts p, steps st)
SELECT g.part, g.o AS filter_order, g.s::INT AS step, coalesce(b.kept, 0)::BIGINT AS kept, coalesce(b.removed, 0)::BIGINT AS removed,
  coalesce(b.redundant, 0)::BIGINT AS redundant, coalesce(b.unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(b.good_lost, 0)::BIGINT AS good_lost, coalesce(b.toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(b.removed, 0)) OVER (PARTITION BY g.part, g.bit))::BIGINT AS shapley
FROM grid g LEFT JOIN by_step b ON b.part = g.part AND b.o = g.o AND b.s = g.s
"""

ORACLE["op12_filter_audit"] = FILTER_AUDIT

SOURCE_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
tk AS (SELECT rid, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
gc AS (SELECT lang, source, term, count(*) AS cnt FROM tk GROUP BY ALL),
kept AS (SELECT lang, term FROM (SELECT DISTINCT rid, lang, term FROM tk) GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, k.term, coalesce(gc.cnt, 0) AS cnt, v.v FROM groups g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN gc ON gc.lang = g.lang AND gc.source = g.source AND gc.term = k.term),
gp AS (SELECT *, 1 + (1000000000::HUGEINT * (cnt + 5)) // (sum(cnt) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM dense),
ld AS (SELECT lang, term, sum(cnt) AS cnt, any_value(v) AS v FROM dense GROUP BY lang, term),
lp AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (cnt + 5)) // (sum(cnt) OVER (PARTITION BY lang) + 5 * v) AS q FROM ld),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(dist.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
terms AS (SELECT gp.lang, gp.source, 'term' AS part, gp.term AS item, gp.p - lp.q AS value FROM gp JOIN lp ON lp.lang = gp.lang AND lp.term = gp.term WHERE gp.cnt > 0 AND gp.p > lp.q),
u AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rk FROM u)
SELECT lang, source, part, item, value::BIGINT AS value, rk::INTEGER AS "rank" FROM r WHERE part = 'pair' OR rk <= 50
"""

ORACLE["op11_source_divergence"] = SOURCE_DIVERGENCE
