"""DuckDB SQL with the rows of the clustered queries that SQL can express."""

from __future__ import annotations

from .more_sql import _SCORES
from .panel_sql import _CELLS, _NEAR

_COLOURS = """o AS (SELECT loc, row_number() OVER (ORDER BY (loc * 2654435761) % 4294967291, loc) AS r FROM places),
nb AS (SELECT a.r, list(b.r) AS nbs FROM graph JOIN o a ON a.loc = i JOIN o b ON b.loc = j GROUP BY a.r),
paint AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS cs
  UNION ALL
  SELECT k + 1, list_append(cs, CAST(list_min(list_filter(range(1, coalesce(len(nbs), 0) + 2), lambda c: NOT list_contains(list_transform(list_filter(coalesce(nbs, []), lambda x: x <= k), lambda x: cs[x]), c))) AS INTEGER))
  FROM paint JOIN o ON o.r = k + 1 LEFT JOIN nb ON nb.r = o.r),
colours AS (SELECT loc, cs[r] AS colour FROM o, (SELECT cs FROM paint ORDER BY k DESC LIMIT 1))"""

_FEATURES = f"""{_CELLS}, feat AS (SELECT loc, round(avg(z), 6) AS level, round(avg(x), 6) AS x_mean, round(stddev_samp(z), 6) AS spread FROM grid GROUP BY loc)"""

ORACLES: dict[str, str] = {
    "graph_colours": f"WITH RECURSIVE {_NEAR}, {_COLOURS} SELECT loc, colour FROM colours",
    "coloured_sweep": f"""WITH RECURSIVE {_SCORES}, {_NEAR}, {_COLOURS},
sc AS (SELECT loc, CAST(n_nationkey AS INTEGER) AS g, ll FROM scores JOIN nation ON n_name = model),
wt AS (SELECT 0.05 * (SELECT median(x) FROM (SELECT max(ll) - min(ll) AS x FROM sc GROUP BY loc)) / (SELECT greatest(avg(n), 1) FROM (SELECT count(*) AS n FROM graph GROUP BY i)) AS w),
sw AS (
  SELECT CAST(0 AS INTEGER) AS c, loc, CAST(nation AS INTEGER) AS g, CAST(NULL AS DOUBLE) AS gain FROM places
  UNION ALL
  (WITH votes AS (SELECT graph.i AS loc, sw.g, count(*) AS n FROM graph JOIN sw ON sw.loc = graph.j GROUP BY 1, 2),
  val AS (SELECT sw.c, sc.loc, sw.g AS old, sc.g, sc.ll + w * coalesce(n, 0) AS v FROM sw JOIN colours ON colours.loc = sw.loc AND colour = sw.c + 1 JOIN sc ON sc.loc = sw.loc LEFT JOIN votes ON votes.loc = sc.loc AND votes.g = sc.g, wt),
  top AS (SELECT loc, old, g AS new, v - now AS up FROM (SELECT *, max(CASE WHEN g = old THEN v END) OVER (PARTITION BY loc) AS now, row_number() OVER (PARTITION BY loc ORDER BY v DESC, g) AS r FROM val) WHERE r = 1 AND v - now > 1e-9 AND g <> old),
  sizes AS (SELECT g AS old, count(*) AS size FROM sw GROUP BY g),
  go AS (SELECT loc, new, up FROM (SELECT *, row_number() OVER (PARTITION BY old ORDER BY up DESC, loc) AS nth FROM top) JOIN sizes USING (old) WHERE nth <= size - 2)
  SELECT sw.c + 1, sw.loc, coalesce(go.new, sw.g), coalesce(go.up, sw.gain) FROM sw LEFT JOIN go ON go.loc = sw.loc WHERE sw.c < (SELECT max(colour) FROM colours)))
SELECT loc, g, round(gain, 3) AS gain FROM sw WHERE c = (SELECT max(c) FROM sw)""",
    "kmeans_assignment": f"""WITH {_FEATURES}, s AS (SELECT avg(level) AS ml, stddev_samp(level) AS sl, avg(x_mean) AS mx, stddev_samp(x_mean) AS sx, avg(spread) AS ms, stddev_samp(spread) AS ss FROM feat),
p AS (SELECT loc, level, round((level - ml) / sl, 4) AS a, round((x_mean - mx) / sx, 4) AS b, round((spread - ms) / ss, 4) AS c FROM feat, s),
ends AS (SELECT 1 AS g, a, b, c FROM (SELECT * FROM p ORDER BY level, loc LIMIT 1) UNION ALL SELECT 2, 0, 0, 0 UNION ALL SELECT 3, a, b, c FROM (SELECT * FROM p ORDER BY level DESC, loc DESC LIMIT 1)),
f AS (SELECT p.loc, e.g, row_number() OVER (PARTITION BY p.loc ORDER BY (p.a - e.a) * (p.a - e.a) + (p.b - e.b) * (p.b - e.b) + (p.c - e.c) * (p.c - e.c), e.g) AS r FROM p, ends e)
SELECT loc, CAST(g AS INTEGER) AS g FROM f WHERE r = 1""",
}
