"""SQL for DuckDB of the corpus queries that SQL can express."""

from __future__ import annotations

from tidewatch.llm.licences import TEMPLATES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS got FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.got)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(got) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id"""

OP9 = """
WITH l AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS line2 FROM l),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, i) AS k FROM w WHERE line2 IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i FROM later UNION ALL SELECT doc_id, i + 1 FROM later)),
runs AS (SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, count(*) AS c FROM (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM gone) GROUP BY doc_id, island) GROUP BY doc_id),
s AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS kept FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(longest, 0) AS longest_run, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN runs USING (doc_id)"""

OP9_REPEATED = """
WITH l AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS line2 FROM l),
later2 AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, i) AS k FROM w WHERE line2 IS NOT NULL) WHERE k > 1),
later1 AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS k FROM w WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i FROM later2 UNION ALL SELECT doc_id, i + 1 FROM later2 UNION ALL SELECT doc_id, i FROM later1)),
runs AS (SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, count(*) AS c FROM (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM gone) GROUP BY doc_id, island) GROUP BY doc_id),
s AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS kept FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(longest, 0) AS longest_run, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN runs USING (doc_id)"""

OP10 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM p) WHERE c > 1),
v AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
m AS (SELECT v.doc_id, v.i, v.word, max(a.i) OVER (PARTITION BY v.doc_id ORDER BY v.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM v LEFT JOIN again a ON a.doc_id = v.doc_id AND a.i = v.i),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN s USING (doc_id)"""


def _norm(text: str) -> str:
    """Words of a text as the licence scan takes them."""
    lower = f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}.]+', ' ', 'g')"
    return f"list_filter(string_split(regexp_replace(regexp_replace({lower}, '\\.([^\\p{{N}}])', ' \\1', 'g'), '\\.$', ' '), ' '), lambda x: x <> '')"


def _templates() -> str:
    return ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))


OP7 = f"""
WITH t0 AS (SELECT * FROM (VALUES {_templates()}) AS v(template, licence, t)),
tw AS (SELECT template, licence, {_norm('t')} AS ws FROM t0),
tb AS (SELECT template, licence, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS b FROM tw),
tg AS (SELECT template, licence, len(b) AS tn, unnest(b) AS g FROM tb),
l AS (SELECT doc_id, unnest(range(len(p))) AS line, unnest(p) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
lw AS (SELECT doc_id, line, {_norm('s')} AS ws FROM l),
lb AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS b FROM lw WHERE len(ws) > 1),
lg AS (SELECT doc_id, line, len(b) AS ln, unnest(b) AS g FROM lb),
d AS (SELECT doc_id, line, template, licence, 2.0 * count(*) / (any_value(ln) + any_value(tn)) AS dice FROM lg JOIN tg USING (g) GROUP BY doc_id, line, template, licence),
best AS (SELECT doc_id, CAST(max(dice) AS DOUBLE) AS dice, count(DISTINCT line) AS n, first(licence ORDER BY dice DESC, licence) AS licence FROM d WHERE dice >= 0.8 GROUP BY doc_id)
SELECT o.doc_id, licence, round(dice, 6) AS dice, coalesce(n, 0) AS licence_lines FROM documents o LEFT JOIN best USING (doc_id)"""

#: A text with A-Z folded.
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
s AS (SELECT lang, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
f1 AS (SELECT lang, a, count(*) AS f FROM s GROUP BY ALL),
f2 AS (SELECT lang, a, b, count(*) AS f FROM s WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, a, b, c, count(*) AS f FROM s WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY ALL),
cover AS (SELECT lang, a, b, max(f) AS most FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) GROUP BY ALL),
two AS (SELECT f2.lang, concat(f2.a, ' ', f2.b) AS phrase, f2.f AS a, x.f AS l, y.f AS r, ((1000000::HUGEINT * f2.f * f2.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b
  LEFT JOIN cover ON cover.lang = f2.lang AND cover.a = f2.a AND cover.b = f2.b WHERE cover.most IS NULL OR 100 * cover.most < 50 * f2.f),
cuts AS (SELECT f3.lang, concat(f3.a, ' ', f3.b, ' ', f3.c) AS phrase, f3.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
    ((1000000::HUGEINT * f3.f * f3.f) // (x.f::HUGEINT * yz.f))::BIGINT AS s1, ((1000000::HUGEINT * f3.f * f3.f) // (xy.f::HUGEINT * z.f))::BIGINT AS s2
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a = f3.a JOIN f1 z ON z.lang = f3.lang AND z.a = f3.c
  JOIN f2 xy ON xy.lang = f3.lang AND xy.a = f3.a AND xy.b = f3.b JOIN f2 yz ON yz.lang = f3.lang AND yz.a = f3.b AND yz.b = f3.c),
every AS (SELECT * FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts),
k AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank, phrase, a, l, r, n, score FROM every JOIN n USING (lang))
SELECT lang, rank, phrase, a, l, r, n, score FROM k WHERE rank <= 2000"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13 = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({LOW}, '{TERM}')) AS term FROM documents),
d AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM d GROUP BY ALL),
s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM l),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOW}, '{TERM}')) AS term FROM benchmark),
f AS (SELECT term, count(*) AS df FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT AS w FROM f, s),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // ll)))))::BIGINT AS score FROM q JOIN w USING (term) JOIN d USING (term) JOIN l USING (doc_id), s GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 50"""

ORACLE = {"op2_minhash": OP2, "op7_licences": OP7, "op9_lines": OP9, "op9_repeated_lines": OP9_REPEATED, "op10_substring": OP10, "op11_phrases": OP11, "op13_search": OP13}
