"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from ocellus.llm import chat_format, quality_rules

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_SPACED = rf"list_filter(string_split_regex({{0}}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM.format('text')} AS w FROM benchmark),
win AS (
  SELECT item_id, array_to_string(w[i:i + 9], ' ') AS s, 10 AS n FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)
  UNION ALL SELECT item_id, array_to_string(w, ' '), len(w) FROM b WHERE len(w) BETWEEN 1 AND 9
),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
occ AS (SELECT a.doc_id, a.i, a.n, win.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM places) a JOIN win ON a.s = win.s AND a.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op4() -> str:
    escaped = rf"regexp_replace(replace({{0}}, '\', '\\'), '{chat_format.CONTROL}', '\1\\\2', 'g')"
    marks = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in chat_format.MARKS.items())
    other = sum(map(len, chat_format.ROLE_MARKS))
    known = ", ".join(f"'{r}'" for r in chat_format.MARKS)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
c AS (SELECT *, length({escaped.format('text')}) + CASE role {marks} ELSE {other} END + CASE WHEN role IN ({known}) THEN 0 ELSE length({escaped.format('role')}) END AS chars FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def _op5() -> str:
    grid = ", ".join(map(str, quality_rules.GRID))
    upper = quality_rules._UPPER
    risk, gap = quality_rules.RISK, quality_rules.CONFIDENCE_GAP
    ratio = {
        "symbols": "n_symbols / greatest(n_words, 1)", "exclamations": "n_exclamations / greatest(n_words, 1)", "capitals": "n_capitals / greatest(word_chars, 1)",
        "repeated_words": "n_repeat_words / greatest(n_words, 1)", "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    }
    level = "greatest(" + ", ".join(f"{ratio[r]} / {cutoff}::DOUBLE" for r, cutoff in quality_rules.RULES.items()) + ")"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_SPACED.format("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM again) GROUP BY r),
m AS (
  SELECT d.r, doc_id, stratum, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_exclamations, length(text) - length(translate(text, '{upper}', '')) AS n_capitals
  FROM d LEFT JOIN rep ON d.r = rep.r
),
x AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {level} AS v FROM m),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
t AS (SELECT stratum, cutoff, count(*) AS n, count(CASE WHEN v > cutoff THEN 1 END) AS k FROM x JOIN good USING (doc_id), (SELECT unnest([{grid}]::DOUBLE[]) AS cutoff) WHERE NOT base_failed GROUP BY stratum, cutoff),
p AS (SELECT *, count(DISTINCT stratum) OVER () AS strata, CASE WHEN k >= n * {risk} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk})))) END AS tail FROM t),
cut AS (SELECT stratum, min(cutoff) AS cutoff FROM p WHERE tail <= {gap} / strata GROUP BY stratum),
bad AS (SELECT r FROM x JOIN cut USING (stratum) WHERE v > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM x
"""


OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOWER.format('text'))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)),
c AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.b) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON d.doc_id = c.a GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op4_chat_format": _op4(), "op5_quality_rules": _op5(), "op8_jaccard_join": OP8}
