"""SQL that repeats the draws of the multinomial tree, for fewer than 4,096 rows or groups."""

from __future__ import annotations

import numpy as np

from evalspark.operators.bootstrap import RANGE_GROUPS, RANGES
from evalspark.operators.multinomial import scrambled


def _scrambled(x: str) -> str:
    for _ in range(2):
        x = f"((xor({x} >> 16, {x}) * 73244475) & 4294967295)"
    return f"xor({x} >> 16, {x})"


def counts(draws: int, seed: int = 42) -> str:
    """CTEs up to cnt (r, b, n, s): how often replicate b draws leaf r, and its stream, from lf (r, m): the leaves and how much each weighs."""
    start = int(scrambled(np.array([seed], dtype=np.uint64))[0])
    return f"""lv AS (SELECT coalesce(max(ceil(log2(r + 1)))::int, 0) AS lev, sum(m)::bigint AS total FROM lf),
  hp AS (SELECT h, sum(m)::bigint AS m FROM (SELECT ((1::bigint << lev) + r) >> k AS h, m FROM lf, lv, (SELECT unnest(range(13)) AS k) WHERE k <= lev) GROUP BY 1),
  nd AS MATERIALIZED (SELECT a.h, a.m, coalesce(c.m, 0) AS ml FROM hp a CROSS JOIN lv LEFT JOIN hp c ON c.h = 2 * a.h WHERE a.h < (1::bigint << lev)),
  hk AS (SELECT h, {_scrambled(f'xor({start}::bigint, h)')} AS key FROM hp), hb AS (SELECT h, b, xor(key, b) AS x FROM hk, (SELECT unnest(range({draws})) AS b)),
  st AS MATERIALIZED (SELECT h, b, {_scrambled('x')} AS s FROM hb),
  sz AS (SELECT s, unnest(range(s + 1)) AS k FROM (SELECT unnest(range(1, 65)) AS s)),
  pm AS (SELECT h, s, k, exp(lgamma(s + 1) - lgamma(k + 1) - lgamma(s - k + 1) + k * ln(ml / m::double) + (s - k) * ln(1 - ml / m::double)) AS p FROM nd, sz WHERE ml > 0 AND ml < m),
  cdf AS MATERIALIZED (SELECT h, s, k, CASE WHEN k = s THEN 4294967296 ELSE floor(sum(p) OVER (PARTITION BY h, s ORDER BY k) * 4294967296)::bigint END AS t FROM pm),
  tr AS (SELECT 0 AS l, 1::bigint AS h, b, total AS n FROM lv, (SELECT unnest(range({draws})) AS b) UNION ALL
    SELECT l + 1, 2 * h + side, b, CASE WHEN side = 0 THEN k ELSE n - k END FROM (
      SELECT l, h, b, n, CASE WHEN any_value(ml) = 0 THEN 0 WHEN any_value(ml) = any_value(m) THEN n ELSE sum(coalesce(k + 1, 0)) END::bigint AS k FROM (
        SELECT y.*, cdf.k FROM (SELECT *, {_scrambled('x')} AS u FROM (
          SELECT tr.l, tr.h, tr.b, tr.n, nd.m, nd.ml, least(64, tr.n - 64 * j) AS z, xor(st.s, j) AS x FROM tr JOIN nd ON nd.h = tr.h JOIN st ON st.h = tr.h AND st.b = tr.b, LATERAL (SELECT unnest(range((tr.n + 63) // 64)) AS j))) y
        ASOF LEFT JOIN cdf ON cdf.h = y.h AND cdf.s = y.z AND y.u >= cdf.t) GROUP BY l, h, b, n), (SELECT unnest([0, 1]) AS side)),
  cnt AS MATERIALIZED (SELECT tr.h - (1::bigint << lev) AS r, tr.b, tr.n, st.s FROM tr JOIN lv ON tr.l = lev JOIN st ON st.h = tr.h AND st.b = tr.b WHERE tr.n > 0)"""


def weights(groups: str, group: str, draws: int, seed: int = 42) -> str:
    """CTEs up to wts (b, group, w) for the different groups of a table."""
    return f"""grp AS (SELECT DISTINCT {group} FROM {groups}), gh AS (SELECT {group}, sha1(coalesce('=' || {group}::varchar, '')) AS hash FROM grp),
  gl AS (SELECT CASE WHEN count(*) < {RANGE_GROUPS} THEN 0 ELSE least({RANGES.bit_length() - 1}, floor(log2(count(*) // {RANGE_GROUPS}))::int + 1) END AS bits FROM grp),
  gr AS (SELECT *, ('0x' || substr(hash, 1, 3))::bigint >> ({RANGES.bit_length() - 1} - bits) AS r FROM gh, gl), plc AS MATERIALIZED (SELECT {group}, r, row_number() OVER (PARTITION BY r ORDER BY hash) - 1 AS place FROM gr),
  lf AS (SELECT i AS r, count(r) AS m FROM gl, LATERAL (SELECT unnest(range(1::bigint << bits)) AS i) LEFT JOIN gr ON gr.r = i GROUP BY 1), {counts(draws, seed)},
  dx AS (SELECT cnt.r, cnt.b, lf.m, xor(cnt.s, j) AS x FROM cnt JOIN lf USING (r), LATERAL (SELECT unnest(range(cnt.n)) AS j)), dp AS (SELECT r, b, ({_scrambled('x')} * m) >> 32 AS place FROM dx),
  wts AS MATERIALIZED (SELECT b, {group}, count(*) AS w FROM dp JOIN plc USING (r, place) GROUP BY 1, 2)"""
