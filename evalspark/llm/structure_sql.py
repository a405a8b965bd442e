"""SQL of the Merkle manifest and of conversation repair."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    return f"xor(list_reduce([4294967295]::bigint[] || [ascii(x)::bigint FOR x IN string_split({text}, '')], lambda c, x: {bits}), 4294967295)"


def _encoded(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::varchar)) || ':' || {value}::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_encoded, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


def _tree(name: str, leaves: str) -> str:
    """Nodes (g, level, i, w, h) of the trees over leaves (g, i, w, h); w: how many a level has."""
    return f"""{name} AS (SELECT g, 0 AS level, i, w, h FROM {leaves}
    UNION ALL SELECT g, level + 1, i // 2, (w + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE w > 1 GROUP BY g, level, i // 2, w)"""


def _steps(name: str, rows: str, first: int) -> str:
    """Steps (id, place, step) up the tree of rows (id, g, i): the side and the digest of the sibling, S where there is none."""
    return f"""SELECT r.id, {first} + l.level AS place, CASE WHEN s.h IS NULL THEN 'S' WHEN (r.i >> l.level) & 1 = 1 THEN 'L' || s.h ELSE 'R' || s.h END AS step
    FROM {rows} r JOIN (SELECT DISTINCT g, level FROM {name} WHERE w > 1) l ON l.g = r.g LEFT JOIN {name} s ON s.g = l.g AND s.level = l.level AND s.i = xor(r.i >> l.level, 1)"""


MANIFEST = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS g, {_leaf('n_chars')} AS h,
    CASE WHEN n_chars IS NOT NULL AND {crc32("doc_id::varchar")} % 7 = 0 THEN {_leaf('(n_chars::hugeint + 1)')} END AS bad FROM documents),
  lv AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS w FROM d),
  {_tree('t', 'lv')}, sub AS (SELECT g AS lang, h FROM t WHERE w = 1), tl AS (SELECT '' AS g, lang, h, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS w FROM sub), {_tree('u', 'tl')},
  up AS (SELECT lv.id, tl.g, tl.i FROM lv JOIN tl ON tl.lang = lv.g), st AS ({_steps('t', 'lv', 0)} UNION ALL {_steps('u', 'up', 1000)}),
  ls AS (SELECT lv.id, list(step ORDER BY place) FILTER (step IS NOT NULL) AS steps FROM lv LEFT JOIN st USING (id) GROUP BY 1),
  f AS (SELECT lv.*, sub.h AS subroot, (SELECT h FROM u WHERE w = 1) AS root, coalesce(steps, []) AS steps FROM lv JOIN sub ON sub.lang = lv.g JOIN ls USING (id)),
  o AS (SELECT *, list_reduce([coalesce(bad, h)] || steps, lambda x, y: CASE left(y, 1) WHEN 'S' THEN sha256(x) WHEN 'L' THEN sha256(substr(y, 2) || x) ELSE sha256(x || substr(y, 2)) END) AS folded_root FROM f)
  SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string([substr(s, 2) FOR s IN steps], '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM o"""


def _option(end: int, edit: str, cost: str, *rows: str) -> str:
    """What an edit makes of the best beginning with an end: (c, a, o) for cost, audit, text; NULL where there is none."""
    text = f"s{end}.o"
    for k, row in enumerate(rows):
        text += f" || CASE WHEN s{end}.o = '' THEN '' ELSE chr(10) END || {row}" if k == 0 else f" || chr(10) || {row}"
    return f"CASE WHEN s{end} IS NOT NULL THEN {{'c': s{end}.c + {cost}, 'a': s{end}.a || '{edit}', 'o': {text}}} END"


def _best(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


_KEPT, _USER, _ASSISTANT, _NEW_USER, _NEW_ASSISTANT = "role || ':' || text", "'user:' || text", "'assistant:' || text", "'user:'", "'assistant:'"


def _where(condition: str, option: str) -> str:
    return f"CASE WHEN {condition} THEN {option} END"


def _to(end: int) -> str:
    """The best beginning with an end after one more row (initial, role, text, x: what keeping it costs, stays: whether it may)."""
    options = [_option(end, "D", "4")]
    if end == 1:
        options.append(_where("stays AND initial = 's'", _option(0, "K", "x", _KEPT)))
    if end == 2:
        for before in (0, 1, 3):
            options += [_where("stays AND initial = 'u'", _option(before, "K", "x", _KEPT)), _where("stays", _option(before, "R", "x + 3", _USER))]
        options += [_where("stays AND initial = 'u'", _option(2, "IK", "x + 3", _NEW_ASSISTANT, _KEPT)), _where("stays", _option(2, "IR", "x + 6", _NEW_ASSISTANT, _USER))]
    if end == 3:
        options += [_where("stays AND initial = 'a'", _option(2, "K", "x", _KEPT)), _where("stays", _option(2, "R", "x + 3", _ASSISTANT))]
        for before in (0, 1, 3):
            options += [_where("stays AND initial = 'a'", _option(before, "IK", "x + 3", _NEW_USER, _KEPT)), _where("stays", _option(before, "IR", "x + 6", _NEW_USER, _ASSISTANT))]
    return _best(*options)


_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
_STATE = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR)"
REPAIR = f"""WITH RECURSIVE k AS (SELECT coalesce(conv_id::varchar, '') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(_KEY)} % 20 AS kind FROM conversations),
  g AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
  n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS rn, left(role, 1) AS initial, rtrim(text, {_SPACE}) AS solid FROM g),
  r AS MATERIALIZED (SELECT *, solid = '' AS blank, solid <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY rn) > 1 AS duplicate, lag(initial) OVER (PARTITION BY conv ORDER BY rn) AS before FROM n),
  e AS MATERIALIZED (SELECT *, NOT blank AND NOT duplicate AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated, NOT blank AND NOT duplicate AS stays FROM r),
  dp AS (SELECT conv, 0::bigint AS rn, {{'c': 0, 'a': '', 'o': ''}}::{_STATE} AS s0, NULL::{_STATE} AS s1, NULL::{_STATE} AS s2, NULL::{_STATE} AS s3 FROM (SELECT DISTINCT conv FROM k)
    UNION ALL SELECT conv, rn, {', '.join(_to(end) for end in range(4))} FROM (SELECT e.conv, e.rn, role, text, initial, stays, CASE WHEN truncated THEN 3 ELSE 0 END AS x, s0, s1, s2, s3 FROM dp JOIN e ON e.conv = dp.conv AND e.rn = dp.rn + 1)),
  z AS (SELECT conv, {_best(_option(0, '', '0'), _option(1, 'II', '6', _NEW_USER, _NEW_ASSISTANT), _option(2, 'I', '3', _NEW_ASSISTANT), _option(3, '', '0'))} AS best FROM dp
    SEMI JOIN (SELECT k.conv, coalesce(max(e.rn), 0) AS rn FROM k LEFT JOIN e ON e.conv = k.conv GROUP BY 1) m ON m.conv = dp.conv AND m.rn = dp.rn),
  s AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY 1)
  SELECT i.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    best.c AS cost, best.a AS audit, sha256(best.o) AS repaired_sha256 FROM (SELECT DISTINCT conv, conv_id FROM k) i JOIN z ON z.conv = i.conv LEFT JOIN s ON s.conv = i.conv"""
