"""DuckDB SQL with the rows of the application's queries."""

from __future__ import annotations

from .application import LAGS
from .panel_sql import _PLACES

_CASES = f"""{_PLACES}, st AS (SELECT loc, x, y, n_regionkey AS city, nation AS brand, CASE WHEN nation % 2 = 0 THEN 'major' ELSE 'independent' END AS grp FROM places JOIN nation ON n_nationkey = nation),
se AS (SELECT * FROM (VALUES (1, 'major', 'independent'), (2, 'independent', 'major'), (3, 'major', 'major')) v(setting, a, b)),
pr AS (SELECT setting, p.loc, q.loc AS nearest, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS h FROM se JOIN st p ON p.grp = a JOIN st q ON q.grp = b AND q.city = p.city AND q.loc <> p.loc AND (setting < 3 OR q.brand <> p.brand)),
prs AS (SELECT CAST(setting AS INTEGER) AS setting, loc, nearest, round(h, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY setting, loc ORDER BY h, nearest) AS r FROM pr) WHERE r = 1),
ce AS (SELECT l_suppkey AS loc, year(l_shipdate) * 12 + month(l_shipdate) AS m, l_linenumber % 2 = 1 AS odd, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem),
me AS (SELECT loc, CAST(m - (SELECT min(m) FROM ce) AS INTEGER) AS t, CAST(sum(c) FILTER (odd) AS DOUBLE) / nullif(count(*) FILTER (odd), 0) / 100000 AS g, CAST(sum(c) FILTER (NOT odd) AS DOUBLE) / nullif(count(*) FILTER (NOT odd), 0) / 100000 AS d FROM ce GROUP BY loc, m),
gr AS (SELECT l.loc, s.t, g, d FROM (SELECT DISTINCT loc FROM me) l CROSS JOIN (SELECT DISTINCT t FROM me) s LEFT JOIN me ON me.loc = l.loc AND me.t = s.t),
lv AS (SELECT t, round(avg(g), 6) AS lg, round(avg(d), 6) AS ld FROM gr GROUP BY t),
cc AS (SELECT loc, t, 100 * (g - lg) AS g, 100 * (d - ld) AS d FROM gr JOIN lv USING (t)),
re AS (SELECT loc, t, round(g - avg(CASE WHEN t >= 12 THEN g END) OVER (PARTITION BY loc), 4) AS g, round(d - avg(CASE WHEN t >= 12 THEN d END) OVER (PARTITION BY loc), 4) AS d FROM cc),
ca AS (SELECT prs.setting, prs.loc, prs.nearest, m.t, p.city, p.brand AS y_brand, p.grp AS y_group, q.brand AS x_brand, m.g AS yg, coalesce(m.g, 0) AS yg_c, m.d AS yd, coalesce(m.d, 0) AS yd_c, coalesce(o.g, 0) AS xg, coalesce(o.d, 0) AS xd,
  CAST(m.t = 20 AS INTEGER)::DOUBLE AS pulse_a, CAST(m.t = 21 AS INTEGER)::DOUBLE AS pulse_a_next, CAST(m.t = 47 AS INTEGER)::DOUBLE AS pulse_b, CAST(m.t = 48 AS INTEGER)::DOUBLE AS pulse_b_next, m.t < 12 AS presample
  FROM prs JOIN st p ON p.loc = prs.loc JOIN st q ON q.loc = prs.nearest JOIN re m ON m.loc = prs.loc JOIN re o ON o.loc = prs.nearest AND o.t = m.t)"""


def _design(s: str, o: str) -> str:
    sources = {"own": f"y{s}_c", "own_other": f"y{o}_c", "nb": f"x{s}", "nb_other": f"x{o}"}
    cols = ", ".join(f"lag({sources[b]}, {k}) OVER w AS {b}_l{k}" for b, ks in LAGS.items() for k in ks)
    return f"SELECT setting, '{s}' AS series, loc, t, y{s} AS y, {cols}, pulse_a, pulse_a_next, pulse_b, pulse_b_next FROM ca WINDOW w AS (PARTITION BY setting, loc ORDER BY t)"


_SUMS = ", ".join(f"sum(CAST(round({c} * 10000) AS BIGINT)) / 10000::DOUBLE AS {c}" for c in [*[f"{b}_l{k}" for b, ks in LAGS.items() for k in ks], "pulse_a", "pulse_a_next", "pulse_b", "pulse_b_next"])

ORACLES = {
    "application_pairs": f"WITH {_CASES} SELECT * FROM prs",
    "application_cases": f"WITH {_CASES} SELECT * FROM ca",
    "application_design": f"WITH {_CASES}, de AS ({_design('g', 'd')} UNION ALL {_design('d', 'g')}) SELECT setting, series, loc, count(*) AS steps, count(y) AS seen, {_SUMS} FROM de WHERE t >= 12 GROUP BY ALL",
}
