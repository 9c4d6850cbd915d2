"""DuckDB SQL for the rows of op11: damage by a CRC-32 over bytes, and the layers as a recursive query."""

from __future__ import annotations

BLANKS = r"E' \t\n\x0b\x0c\r'"


def _plus(x: str, cost: int | str, letter: str) -> str:
    """The entry ``x`` (cost and audit) after an edit; null stays null."""
    return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}'}} END"


def _least(*entries: str) -> str:
    return f"list_min(list_filter([{', '.join(entries)}], lambda x: x IS NOT NULL))"


def _keep(state: str, initial: str) -> str:
    return f"CASE WHEN NOT gone AND r = '{initial}' THEN {_plus(state, 'e', 'K')} END"


def _change(state: str) -> str:
    return f"CASE WHEN NOT gone THEN {_plus(state, '3 + e', 'R')} END"


SQL = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS kind FROM k, t),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, LATERAL (SELECT unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i, rtrim(text, {BLANKS}) AS x FROM d),
f AS (SELECT *, substr(role, 1, 1) AS r, x = '' AS blank, x <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(x, 1) NOT IN ('.', '!', '?') AS loose,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM o),
g AS (SELECT *, blank OR again AS gone, CASE WHEN loose AND NOT blank AND NOT again THEN 3 ELSE 0 END AS e FROM f),
dp AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS n, NULL::STRUCT(c INT, a VARCHAR) AS s, {{'c': 3, 'a': 'I'}} AS u, {{'c': 6, 'a': 'II'}} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, n, s, u, {_least('a', _plus('u', 3, 'I'))} FROM (
    SELECT conv_id, i, n, s, {_least('u', _plus('n', 3, 'I'), _plus('s', 3, 'I'), _plus('a', 3, 'I'))} AS u, a FROM (
      SELECT g.conv_id, g.i, {_plus('n', 4, 'D')} AS n, {_least(_plus('s', 4, 'D'), _keep('n', 's'))} AS s,
        {_least(_plus('u', 4, 'D'), *(_keep(x, 'u') for x in 'nsa'), *map(_change, 'nsa'))} AS u,
        {_least(_plus('a', 4, 'D'), _keep('u', 'a'), _change('u'))} AS a
      FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND g.i = dp.i + 1))),
b AS (SELECT conv_id, {_least('n', 'a')} AS best FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
l AS (SELECT conv_id, substr(best.a, j, 1) AS letter, j FROM b, LATERAL (SELECT unnest(range(1, 1 + length(best.a))) AS j)),
m AS (SELECT *, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w AS out, sum((letter <> 'D')::INT) OVER (PARTITION BY conv_id) AS total FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
v AS (SELECT m.conv_id, string_agg(CASE WHEN letter = 'K' THEN g.role WHEN (out - total % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE g.text END, E'\\n' ORDER BY j) AS text
  FROM m LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM m.conv_id AND g.i = m.i WHERE letter <> 'D' GROUP BY m.conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
  count(*) FILTER (e > 0) AS truncated, count(*) FILTER (p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c::BIGINT AS cost, best.a AS audit, sha256(coalesce(v.text, '')) AS repaired_sha256
FROM b LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM b.conv_id"""
