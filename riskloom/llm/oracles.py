"""DuckDB SQL of the operators on conversations, shingle sets and spellings: plain definitions, without their methods."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text's UTF-8 bytes: each byte goes in, then eight bits are shifted out."""
    code = "CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END"
    each_byte = f"flatten(list_transform(string_split({text}, ''), lambda x: {code}))"
    steps = f"flatten(list_transform({each_byte}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}::BIGINT[]), lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"


OP11_SQL = f"""WITH t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own FROM conversations GROUP BY conv_id),
h AS (SELECT t.*, {crc32('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM t),
s AS (SELECT a.conv_id, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS s FROM h a LEFT JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 100),
p AS (SELECT conv_id, d, len(s) AS len, sha256(CAST(s[1:d] AS VARCHAR)) AS node, CASE WHEN d > 0 THEN sha256(CAST(s[1:d - 1] AS VARCHAR)) END AS above, CASE WHEN d > 0 THEN length(s[d].x) ELSE 0 END AS chars FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM s) x),
n AS (SELECT d, node, any_value(above) AS above, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n, coalesce(sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = d)), sha256('')) AS ends FROM p GROUP BY d, node),
k AS (SELECT d - 1 AS d, above AS node, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (d, node)),
u AS (SELECT p.d, p.node, sum((f.n - 1) * f.chars) AS saved, count(*) FILTER (f.kids = 0) AS leaves FROM f JOIN p ON p.conv_id = f.conv_id AND p.d <= f.d GROUP BY p.d, p.node)
SELECT f.conv_id, f.d AS depth, a.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN u USING (d, node) LEFT JOIN n a ON a.d = f.d - 1 AND a.node = f.above"""

OP12_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) ELSE [array_to_string(w, ' ')] END)) AS g FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * m >= 85 * (cx.n + cy.n - m)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS y FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.y = e.x)
SELECT r.doc_id, coalesce(any_value(c.n), 0) AS n_shingles, min(r.y) AS component_id FROM r LEFT JOIN c ON c.doc_id = r.doc_id GROUP BY r.doc_id"""

OP13_SQL = rf"""WITH RECURSIVE o AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) x WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT *, {crc32("CAST(doc_id AS VARCHAR) || ':' || run")} AS h FROM o),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM h) x WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
g AS MATERIALIZED (SELECT word, substring(word, 1, i) || substring(word, i + 2) AS less, substring(word, 1, i) || '_' || substring(word, i + 2) AS gap FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w) x),
q AS MATERIALIZED (SELECT g.word, w.word AS other FROM g JOIN w ON g.less = w.word UNION SELECT w.word, g.word FROM g JOIN w ON g.less = w.word UNION SELECT a.word, b.word FROM g a JOIN g b ON a.gap = b.gap AND a.word <> b.word),
b AS (SELECT q.word, q.other, w.n AS other_n, count(*) OVER (PARTITION BY q.word) AS n_near, row_number() OVER (PARTITION BY q.word ORDER BY w.n DESC, q.other) AS place FROM q JOIN w ON w.word = q.other),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM w LEFT JOIN b ON b.word = w.word AND place = 1),
r AS (SELECT word, word AS at, 0 AS step FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, (SELECT arg_max(r.at, r.step) FROM r WHERE r.word = f.word) AS root, f.n, f.n_near, f.form_n FROM f"""
