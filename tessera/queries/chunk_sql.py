"""DuckDB SQL for the chunks of documents: units of lines by windows, long ones cut by a recursive query."""

from __future__ import annotations

from ..functions import fixed_values as V

S, O, B = V.CHUNK_SIZE, V.CHUNK_OVERLAP, V.BREAK_CHARS
BLANKS = " || ".join(f"chr({c})" for c in (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _windows(source: str) -> str:
    """CTEs of which ``p`` has the windows of the texts: k, s (where it begins) and content, for
    ``source`` (k, t)."""
    half, breaks = S // 2 + 1, " || ".join(f"chr({ord(c)})" for c in B)
    end = f"""CASE WHEN s + {S} >= n THEN n ELSE coalesce((SELECT s + {half} + length(g) - p + 1 FROM (SELECT g, instr(translate(reverse(g), {breaks}, repeat(chr(1), {len(B)})), chr(1)) AS p
  FROM (SELECT substr(t, s + {half} + 1, {S - half}) AS g)) WHERE p > 0), s + {S}) END"""
    return f"""n AS (SELECT k, t, length(t) AS n, 0 AS s FROM (SELECT k, trim(t, {BLANKS}) AS t FROM ({source})) WHERE t <> ''),
w AS (SELECT k, t, n, s, {end} AS e FROM n UNION ALL SELECT k, t, n, s, {end} FROM (SELECT k, t, n, greatest(e - {O}, s + 1) AS s FROM w WHERE e < n)),
p AS (SELECT k, s, trim(substr(t, s + 1, e - s), {BLANKS}) AS content FROM w)"""


#: Windows of whole texts.
PLAIN = f"""WITH RECURSIVE {_windows('SELECT doc_id AS k, text AS t FROM documents WHERE text IS NOT NULL')}
SELECT k AS doc_id, (row_number() OVER (PARTITION BY k ORDER BY s) - 1)::INT AS chunk_index, length(content)::INT AS char_len, content FROM p WHERE content <> ''"""

#: Self-contained units of lines, and windows of those that are too long.
FINE = f"""WITH RECURSIVE l AS (SELECT doc_id, i, trim(raw, {BLANKS}) AS line FROM (SELECT doc_id, unnest(ps) AS raw, generate_subscripts(ps, 1) AS i FROM (
  SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ps FROM documents WHERE text IS NOT NULL)) WHERE trim(raw, {BLANKS}) <> ''),
c AS (SELECT *, regexp_matches(line, {_quoted(V.HEADING)}) AS h, regexp_matches(line, {_quoted(V.QUESTION_LINE)}) AS q, regexp_matches(line, {_quoted(V.ANSWER_LINE)}) AS a,
  trim(ltrim(line, '-*•· ' || chr(9)), {BLANKS}) AS bare FROM l),
x AS (SELECT *, last_value(CASE WHEN h THEN regexp_extract(line, {_quoted(V.HEADING)}, 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head,
  CASE WHEN q THEN regexp_extract(line, {_quoted(V.QUESTION_LINE)}, 1) END AS asked, lag(q) OVER v AS before_q, lag(line) OVER v AS before, lead(a) OVER v AS after_a,
  list_filter(list_transform(string_split_regex(regexp_extract(bare, {_quoted(V.KEY_VALUE)}, 2), '[，,；;]'), lambda y: trim(y, {BLANKS})), lambda y: y <> '') AS vs FROM c WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT doc_id, i, 0 AS j, head, 'Q：' || asked AS unit FROM x WHERE q AND NOT coalesce(after_a, false)
  UNION ALL SELECT doc_id, i, 0, head, CASE WHEN before_q THEN 'Q：' || regexp_extract(before, {_quoted(V.QUESTION_LINE)}, 1) || ' A：' ELSE '' END || regexp_extract(line, {_quoted(V.ANSWER_LINE)}, 1) FROM x WHERE a
  UNION ALL SELECT doc_id, i, generate_subscripts(us, 1), head, unnest(us) FROM (SELECT *, CASE WHEN len(vs) > 1 AND len(list_filter(vs, lambda y: regexp_matches(y, {_quoted(V.AMOUNT_WITH_UNIT)}))) > 1
    THEN list_transform(vs, lambda y: trim(regexp_extract(bare, {_quoted(V.KEY_VALUE)}, 1), {BLANKS}) || '：' || y) ELSE [bare] END AS us FROM x WHERE NOT h AND NOT q AND NOT a AND bare <> '')),
f AS (SELECT doc_id, i, j, CASE WHEN head IS NOT NULL THEN head || ' / ' || unit ELSE unit END AS t FROM u),
{_windows(f'''SELECT {{'d': doc_id, 'i': i, 'j': j}} AS k, t FROM f WHERE length(t) > {S} UNION ALL SELECT {{'d': doc_id, 'i': 0, 'j': 0}}, text FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM f)''')},
r AS (SELECT doc_id, i, j, 0 AS s, t AS content FROM f WHERE length(t) <= {S} UNION ALL SELECT k.d, k.i, k.j, s, content FROM p WHERE content <> '')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j, s) - 1)::INT AS chunk_index, length(content)::INT AS char_len, content FROM r"""
