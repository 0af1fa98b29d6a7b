"""DuckDB SQL for the text queries that SQL can express; doc_id is taken as unique there."""

from __future__ import annotations

import string

from panelworks.llm.chat import CONTROLS, NAMES, PROBE
from panelworks.llm.repetition import SYMBOLS, Rules

_WORD = r"[^\x20\x09-\x0D]"


def repetition_sql(rules: Rules = Rules()) -> str:
    """The measures and verdicts of :func:`panelworks.llm.repetition.assess`."""
    lengths = [3, *(n for n, _ in rules.coverage)]
    ahead = ", ".join(f"lead(word, {k}) OVER o AS w{k}" for k in range(1, max(lengths)))
    gram = lambda n: "concat_ws(' ', word, " + ", ".join(f"w{k}" for k in range(1, n)) + ")"
    grams = ", ".join(f"CASE WHEN w{n - 1} IS NOT NULL THEN {gram(n)} END AS g{n}" for n in lengths)
    early = ", ".join(f"CAST(g{n} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY i) > 1 AS INTEGER) AS e{n}" for n in lengths[1:])
    cover = ", ".join(f"max({'r' if n == 3 else 'e'}{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m{n}" for n in lengths)
    share = ", ".join(f"coalesce(sum(c) FILTER (m{n} = 1), 0) AS s{n}" for n in lengths[1:])
    ratio = ", ".join(f"CAST(coalesce(s{n}, 0) AS DOUBLE) / greatest(coalesce(word_chars, 0), 1) AS coverage_{n}" for n in lengths[1:])
    worse = " OR ".join([f"line_share > {rules.line_share}", *(f"coverage_{n} > {limit}" for n, limit in rules.coverage)])
    return f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws FROM documents),
v AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
u AS (SELECT doc_id, i, word, {ahead} FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, length(word) AS c, {grams} FROM u),
f AS (SELECT doc_id, i, c, CAST(g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS INTEGER) AS r3, {early} FROM g),
m AS (SELECT doc_id, c, {cover} FROM f),
a AS (SELECT doc_id, count(*) AS n_words, sum(c) AS word_chars, count(*) FILTER (m3 = 1) AS n_repeat_words, {share} FROM m GROUP BY 1),
l0 AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM w), l1 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS j FROM l0),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY j) AS k FROM l1 WHERE regexp_matches(line, '{_WORD}')),
d AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS c FROM l WHERE k > 1 GROUP BY 1),
z AS (SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
 CAST(coalesce(d.c, 0) AS DOUBLE) / greatest(coalesce(word_chars, 0), 1) AS line_share, {ratio} FROM w LEFT JOIN a USING (doc_id) LEFT JOIN d USING (doc_id)),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM z)
SELECT *, NOT base_failed AND NOT ({worse}) AS kept FROM b"""


def near_duplicate_sql(width: int = 5, percent: int = 75) -> str:
    """The components of :func:`panelworks.llm.neardup.near_duplicates`, from the exact sets."""
    upper = string.ascii_uppercase
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{_WORD}+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {width} THEN list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i:i + {width - 1}], ' '))
 WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.r),
c AS (SELECT doc_id, min(r) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""


def infill_sql(seed: int = 1) -> str:
    """The cuts and texts of :func:`panelworks.llm.infill.transform`."""
    h = ", ".join(f"CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, {h} FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:n], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(x) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(y) END AS BIGINT) AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def chat_sql() -> str:
    """The turns, loss texts and sizes of :func:`panelworks.llm.chat.read_back`, roles being the known ones."""
    escaped = "text"
    for c in CONTROLS:
        escaped = f"regexp_replace({escaped}, '(\\\\*{c})', '\\\\\\1', 'g')"
    names = " ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in NAMES.items())
    conv, text = PROBE
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT {conv}, i, r, '{text}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (SELECT *, 15 + CASE role {names} ELSE 1 + 2 * octet_length(encode(role)) END + length({escaped}) AS chars FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""
