"""DuckDB SQL with the rows of the further queries."""

from __future__ import annotations

from .panel_sql import _CELLS, _FILTER, _MODELS, _MPANEL, _NEAR, _PLACES

_NORMAL = f"""{_MPANEL}, rws AS (SELECT model, z, x, t / 12.0::DOUBLE AS y FROM mpanel WHERE z IS NOT NULL AND x IS NOT NULL),
m AS (SELECT model, CAST(count(*) AS DOUBLE) AS m00, sum(x) AS m01, sum(y) AS m02, sum(x * x) AS m11, sum(x * y) AS m12, sum(y * y) AS m22, sum(z) AS v0, sum(x * z) AS v1, sum(y * z) AS v2 FROM rws GROUP BY model),
s AS (SELECT model, sqrt(m00) AS s0, sqrt(m11) AS s1, sqrt(m22) AS s2, m01 / sqrt(m00 * m11) AS a, m02 / sqrt(m00 * m22) AS b, m12 / sqrt(m11 * m22) AS c, v0 / sqrt(m00) AS w0, v1 / sqrt(m11) AS w1, v2 / sqrt(m22) AS w2 FROM m),
r AS (SELECT *, greatest(abs(w1 - a * w0), abs(w2 - b * w0)) AS lref FROM s)"""


def _ridge(p: str) -> str:
    """Solution and trace on the active set of (1, a, b; a, 1, c; b, c, 1) plus p on the last two."""
    return f"((1 + {p}) * (1 + {p}) - c * c - a * (a * (1 + {p}) - b * c) + b * (a * c - b * (1 + {p})))"


def _sweep(m: str, k: str, p: int | str) -> str:
    """The p x p matrix m, a list row by row, swept on column k."""
    i, j, d = f"((x - 1) // {p} + 1)", f"((x - 1) % {p} + 1)", f"{m}[({k} - 1) * {p} + {k}]"
    row, column = f"{m}[({k} - 1) * {p} + {j}]", f"{m}[({i} - 1) * {p} + {k}]"
    return f"list_transform(range(1, {p} * {p} + 1), lambda x: CASE WHEN {i} = {k} AND {j} = {k} THEN -1 / {d} WHEN {i} = {k} THEN {row} / {d} WHEN {j} = {k} THEN {column} / {d} ELSE {m}[x] - {column} * {row} / {d} END)"


def _products(columns: list[str]) -> str:
    return "[" + ", ".join(f"CAST(sum({a} * {b}) AS DOUBLE)" for a in columns for b in columns) + "]"


_DESIGN = f"""{_CELLS}, {_PLACES},
nn AS (SELECT i AS loc, j AS other FROM (SELECT a.loc AS i, b.loc AS j, row_number() OVER (PARTITION BY a.loc ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.loc) AS r FROM places a JOIN places b ON a.loc <> b.loc) WHERE r = 1),
cases AS (SELECT nn.loc, other, g.t, g.z AS y, h.z AS x, row_number() OVER (PARTITION BY nn.loc ORDER BY g.t) AS nr, g.t < 4 AS presample FROM nn JOIN grid g ON g.loc = nn.loc JOIN grid h ON h.loc = nn.other AND h.t = g.t)"""
_STATION = f"""{_DESIGN}, l AS (SELECT loc, t, y, lag(y) OVER w AS a, lag(x) OVER w AS b, presample FROM cases WINDOW w AS (PARTITION BY loc ORDER BY t)),
o AS (SELECT loc, y, a, b FROM l WHERE NOT presample AND y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
c AS (SELECT loc, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM o GROUP BY loc), u AS (SELECT o.loc, y - my AS y, a - ma AS a, b - mb AS b FROM o JOIN c ON c.loc = o.loc),
q AS (SELECT loc, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS bt FROM u GROUP BY loc),
k AS (SELECT *, (bb * ay - ab * bt) / (aa * bb - ab * ab) AS p, (aa * bt - ab * ay) / (aa * bb - ab * ab) AS g FROM q),
e AS (SELECT u.loc, y - p * a - g * b AS e, b - ab / aa * a AS rb, n, aa, ab, bb, g FROM u JOIN k ON k.loc = u.loc),
st AS (SELECT loc, any_value(n) AS n, any_value(g) AS g, sum(e * e) / (any_value(n) - 3) AS s2, sum(rb * rb) AS ss, sum(e * e * rb * rb) AS meat FROM e GROUP BY loc),
tests AS (SELECT loc, n, g * g * ss / s2 AS f, g * g / (meat / (ss * ss) * n / (n - 3)) AS w FROM st)"""
_COEF = """c0 AS (SELECT l_orderkey % 50 AS b, l_suppkey % 4 AS g, round(avg(l_discount), 6) AS nb_1, round(avg(l_tax), 6) AS nb_2, round(avg(l_quantity / 100), 6) AS own_1, round(avg(l_linenumber / 50::DOUBLE), 6) AS own_2 FROM lineitem GROUP BY 1, 2)"""
_REPS = """o AS (SELECT o_custkey % 300 AS rep, CAST(o_orderkey % 4 + 1 AS INTEGER) AS k, (o_orderkey // 4) % 5 * 0.05::DOUBLE AS phi, o_totalprice FROM orders),
g0 AS (SELECT rep, k, phi, round(-avg(o_totalprice) / 1000, 3) AS loglik, count(*) AS n FROM o GROUP BY 1, 2, 3),
g1 AS (SELECT rep, k, CASE WHEN k = 1 THEN 0.0::DOUBLE ELSE phi END AS phi, loglik, k * 6.0::DOUBLE AS p, 4000.0::DOUBLE AS n, 100.0::DOUBLE AS d, n % 7 <> 0 AS admissible FROM g0),
g2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rep, k, phi ORDER BY loglik) AS r FROM g1) WHERE r = 1),
crit AS (SELECT rep, k, phi, admissible, -2 * loglik + 2 * p AS aic, -2 * loglik + 2 * p + 2 * p * (p + 1) / (n - p - 1) AS aicc, -2 * loglik - 2 * n * ln(1 - p / n) AS gcv, -2 * loglik + 2 * ln(ln(n)) * p AS hq, -2 * loglik + 3 * p AS kic, -2 * loglik + ln(n) * p AS bic,
  -2 * loglik + ln(n) * p + 2 * CASE WHEN k = 1 THEN 0 ELSE d * ln(k) - ln(CAST(factorial(k) AS DOUBLE)) + ln(list_sum(list_transform(range(0, k), lambda j: (CASE WHEN j % 2 = 0 THEN 1 ELSE -1 END) * CAST(factorial(k) AS DOUBLE) / CAST(factorial(CAST(j AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(k - j AS INTEGER)) AS DOUBLE) * (1 - j / k::DOUBLE) ** d))) END AS ebic FROM g2)"""
_CRITERIA = ("aic", "aicc", "gcv", "hq", "kic", "bic", "ebic")
_CHOSEN = f"""{_REPS}, lg AS (SELECT rep, k, phi, criterion, value FROM (UNPIVOT crit ON {", ".join(_CRITERIA)} INTO NAME criterion VALUE value) WHERE admissible AND isfinite(value)),
few AS (SELECT rep, criterion, count(DISTINCT CASE WHEN phi >= 0.025 AND phi <= 0.2 THEN phi END) < 2 AS few FROM lg WHERE k > 1 GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT lg.*, row_number() OVER (PARTITION BY rep, criterion, phi ORDER BY value, k) AS r FROM lg JOIN few USING (rep, criterion) WHERE k > 1 AND (few OR (phi >= 0.025 AND phi <= 0.2))) WHERE r = 1),
pooled AS (SELECT rep, criterion, min(value) AS base FROM lg WHERE k = 1 GROUP BY 1, 2),
votes AS (SELECT rep, criterion, CASE WHEN base <= value THEN 1 ELSE k END AS k FROM best LEFT JOIN pooled USING (rep, criterion)),
win AS (SELECT rep, criterion, k FROM (SELECT *, row_number() OVER (PARTITION BY rep, criterion ORDER BY n DESC, k) AS r FROM (SELECT rep, criterion, k, count(*) AS n FROM votes GROUP BY 1, 2, 3)) WHERE r = 1),
every AS (SELECT e.rep, e.criterion, coalesce(w.k, 1) AS win FROM (SELECT DISTINCT rep, criterion FROM lg) e LEFT JOIN win w ON w.rep = e.rep AND w.criterion = e.criterion),
chosen AS (SELECT rep, criterion, k, phi FROM (SELECT lg.*, row_number() OVER (PARTITION BY rep, criterion ORDER BY value, phi) AS r FROM lg JOIN every USING (rep, criterion) WHERE k = win) WHERE r = 1)"""
_SCORES = f"""{_FILTER}, scores AS (SELECT grid.loc, s.model, sum(-0.5 * (ln(2 * 3.141592653589793::DOUBLE * v) + (z - b0 - b1 * x - s.m) * (z - b0 - b1 * x - s.m) / v)) AS ll FROM grid JOIN s ON s.t = grid.t JOIN models USING (model) WHERE z IS NOT NULL GROUP BY 1, 2)"""
_FOLDS = f"""{_CELLS}, ends AS (SELECT min(t) AS a, max(t) AS z FROM grid),
lf AS (SELECT loc, (row_number() OVER (ORDER BY (loc * 7919) % 1000003, loc) - 1) % 5 + 1 AS lf FROM (SELECT DISTINCT loc FROM grid)),
fl AS (SELECT g.loc, g.t, lf, greatest(1, CAST(ceil((g.t - a) * 5 / CAST(ends.z - a AS DOUBLE)) AS INTEGER)) AS tf, (row_number() OVER (ORDER BY (g.loc * 7919 + g.t * 104729) % 1000003, g.loc, g.t) - 1) % 5 + 1 AS cf FROM grid g JOIN lf ON lf.loc = g.loc, ends),
fo AS (SELECT fl.*, CAST(j AS INTEGER) AS fold FROM fl, range(1, 6) r(j))"""

_CSUMS = f"""{_MPANEL}, {_MODELS},
cs AS (SELECT p.model, p.t, count(z) AS n, coalesce(sum(z), 0) AS sz, coalesce(sum(CASE WHEN z IS NOT NULL THEN x END), 0) AS sx, coalesce(sum(z * z), 0) AS szz, coalesce(sum(z * x), 0) AS szx, coalesce(sum(CASE WHEN z IS NOT NULL THEN x * x END), 0) AS sxx FROM mpanel p GROUP BY 1, 2)"""
_AUG = ("z", "one", "x", "m0")
_AUG_S = {"z": "sz", "one": "n", "x": "sx", "m0": "0"}
_AUG_Q = {("z", "z"): "szz", ("z", "one"): "sz", ("z", "x"): "szx", ("one", "one"): "n", ("one", "x"): "sx", ("x", "x"): "sxx"}
_AUG_PAIRS = [(a, b) for i, a in enumerate(_AUG) for b in _AUG[i:]]
_LAGGED = ["one", *[f"own_{k}" for k in range(1, 5)], *[f"nb_{k}" for k in range(1, 5)], "y"]
#: Block: columns of its own; the others are swept first.
_BLOCKS = {"own": [2, 3, 4, 5], "nb": [6, 7, 8, 9], "nb_late": [8, 9], "both_late": [4, 5, 8, 9]}
_LAG_TESTS = f"""{_DESIGN}, l AS (SELECT loc, t, y, presample, 1.0::DOUBLE AS one, {', '.join(f'lag(y, {k}) OVER w AS own_{k}, lag(x, {k}) OVER w AS nb_{k}' for k in range(1, 5))} FROM cases WINDOW w AS (PARTITION BY loc ORDER BY t)),
ok AS (SELECT * FROM l WHERE NOT presample AND {' AND '.join(f'{c} IS NOT NULL' for c in _LAGGED)}),
mats AS (SELECT loc, count(*) AS n, {_products(_LAGGED)} AS m FROM ok GROUP BY loc),
blocks(block, ord, q) AS (VALUES {', '.join(f"('{b}', {[*[i for i in range(1, 10) if i not in own], *own]}, {len(own)})" for b, own in _BLOCKS.items())}),
sw AS (SELECT loc, block, ord, q, n, 0 AS step, m, CAST(NULL AS DOUBLE) AS without FROM mats, blocks WHERE n > 9
  UNION ALL SELECT loc, block, ord, q, n, step + 1, {_sweep('m', 'ord[step + 1]', 10)}, CASE WHEN step = 9 - q THEN m[100] ELSE without END FROM sw WHERE step < 9),
tests AS (SELECT loc, block, q, n, (without - m[100]) / q / (m[100] / (n - 9)) AS f FROM sw WHERE step = 9)"""
_ROOT = ["one", "before", *[f"d{k}" for k in range(1, 9)], "d"]

#: Filter of two states by model and step, and (s) its smoother back to the start, with the covariances l of a step with the next one.
_TWO = f"""WITH RECURSIVE {_CSUMS}, k AS (SELECT *, 0.9::DOUBLE AS g2, 20.0::DOUBLE AS w2 FROM models),
f AS (SELECT model, CAST(-1 AS INTEGER) AS t, m0 AS m1, 0.0::DOUBLE AS m2, c0 AS c11, 0.0::DOUBLE AS c12, c0 AS c22, 0.0::DOUBLE AS ll FROM k
  UNION ALL
  SELECT model, t, a1 + (p11 * u1 + p12 * u2) / v, a2 + (p12 * u1 + p22 * u2) / v, p11, p12, p22,
    ll - 0.5 * (n * 1.8378770664093453::DOUBLE + n * ln(v) + ln(det) + (ee - (u1 * u1 * p11 + 2 * u1 * u2 * p12 + u2 * u2 * p22) / v) / v)
  FROM (SELECT *, (d22 * r11 - d12 * r12) / det AS p11, (d22 * r12 - d12 * r22) / det AS p12, (d11 * r22 - d21 * r12) / det AS p22 FROM (SELECT *, d11 * d22 - d12 * d21 AS det FROM (SELECT *, 1 + (r11 * n + r12 * sx) / v AS d11, (r11 * sx + r12 * sxx) / v AS d12, (r12 * n + r22 * sx) / v AS d21, 1 + (r12 * sx + r22 * sxx) / v AS d22,
      s - n * a1 - sx * a2 AS u1, xs - sx * a1 - sxx * a2 AS u2, q - 2 * (a1 * s + a2 * xs) + a1 * a1 * n + 2 * a1 * a2 * sx + a2 * a2 * sxx AS ee
    FROM (SELECT cs.*, v, f.ll, k.g * f.m1 AS a1, g2 * f.m2 AS a2, k.g * k.g * f.c11 + w AS r11, k.g * g2 * f.c12 AS r12, g2 * g2 * f.c22 + w2 AS r22, sz - b0 * n - b1 * sx AS s, szx - b0 * sx - b1 * sxx AS xs,
        szz - 2 * b0 * sz - 2 * b1 * szx + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx AS q
      FROM f JOIN cs ON cs.model = f.model AND cs.t = f.t + 1 JOIN k ON k.model = f.model)))))"""
_TWO_BACK = f"""{_TWO},
s AS (SELECT model, t, m1, m2, c11, c12, c22, 0.0::DOUBLE AS l11, 0.0::DOUBLE AS l22 FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY t DESC) AS r FROM f) WHERE r = 1
  UNION ALL
  SELECT model, t, m1 + b11 * e1 + b12 * e2, m2 + b21 * e1 + b22 * e2, c11 + b11 * b11 * d11 + 2 * b11 * b12 * d12 + b12 * b12 * d22, c12 + b11 * b21 * d11 + (b11 * b22 + b12 * b21) * d12 + b12 * b22 * d22,
    c22 + b21 * b21 * d11 + 2 * b21 * b22 * d12 + b22 * b22 * d22, n11 * b11 + n12 * b12, n12 * b21 + n22 * b22
  FROM (SELECT *, (g * c11 * r22 - g2 * c12 * r12) / det AS b11, (g2 * c12 * r11 - g * c11 * r12) / det AS b12, (g * c12 * r22 - g2 * c22 * r12) / det AS b21, (g2 * c22 * r11 - g * c12 * r12) / det AS b22,
      n1 - g * m1 AS e1, n2 - g2 * m2 AS e2, n11 - r11 AS d11, n12 - r12 AS d12, n22 - r22 AS d22
    FROM (SELECT *, r11 * r22 - r12 * r12 AS det
      FROM (SELECT f.*, s.m1 AS n1, s.m2 AS n2, s.c11 AS n11, s.c12 AS n12, s.c22 AS n22, g, g2, g * g * f.c11 + w AS r11, g * g2 * f.c12 AS r12, g2 * g2 * f.c22 + w2 AS r22
        FROM s JOIN f ON f.model = s.model AND f.t = s.t - 1 JOIN k ON k.model = f.model))))"""

ORACLES: dict[str, str] = {
    "augmented_filter": f"""WITH RECURSIVE {_CSUMS},
f AS (SELECT model, CAST(-1 AS INTEGER) AS t, 0.0::DOUBLE AS a_z, 0.0::DOUBLE AS a_one, 0.0::DOUBLE AS a_x, -1.0::DOUBLE AS a_m0, c0 AS c, {', '.join(f'0.0::DOUBLE AS q_{a}_{b}' for a, b in _AUG_PAIRS)} FROM models
  UNION ALL
  SELECT model, t, {', '.join(f'a_{a} + r / (v + n * r) * ({_AUG_S[a]} - n * a_{a})' for a in _AUG)}, r * v / (v + n * r),
    {', '.join(f"q_{a}_{b} + ({_AUG_Q.get((a, b), '0')} - a_{a} * {_AUG_S[b]} - a_{b} * {_AUG_S[a]} + n * a_{a} * a_{b} - r / (v + n * r) * ({_AUG_S[a]} - n * a_{a}) * ({_AUG_S[b]} - n * a_{b})) / v" for a, b in _AUG_PAIRS)}
  FROM (SELECT cs.*, {', '.join(f'g * f.a_{a} AS a_{a}' for a in _AUG)}, g * g * f.c + w AS r, v, {', '.join(f'f.q_{a}_{b}' for a, b in _AUG_PAIRS)} FROM f JOIN cs ON cs.model = f.model AND cs.t = f.t + 1 JOIN models k ON k.model = f.model))
SELECT model, {', '.join(f'round(q_{a}_{b}, 4) AS q_{a}_{b}' for a, b in _AUG_PAIRS)} FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY t DESC) AS last FROM f) WHERE last = 1 AND t >= 0""",
    "two_state_filter": f"""{_TWO}
SELECT f.model, round(e.ll, 3) AS loglik, f.t, {', '.join(f'round(f.{c}, 4) AS {c}' for c in ('m1', 'm2', 'c11', 'c12', 'c22'))} FROM f JOIN (SELECT model, max_by(ll, t) AS ll FROM f GROUP BY model) e USING (model) WHERE f.t >= 0""",
    "two_state_smoother": f"{_TWO_BACK} SELECT model, t, {', '.join(f'round({c}, 4) AS {c}' for c in ('m1', 'm2', 'c11', 'c12', 'c22'))} FROM s WHERE t >= 0",
    "two_state_em_step": f"""{_TWO_BACK},
lat AS (SELECT a.model, count(*) AS steps, {', '.join(f'sum(a.m{i} * a.m{i} + a.c{i}{i}) AS s11_{i}, sum(a.m{i} * b.m{i} + b.l{i}{i}) AS s10_{i}, sum(b.m{i} * b.m{i} + b.c{i}{i}) AS s00_{i}' for i in (1, 2))} FROM s a JOIN s b ON b.model = a.model AND b.t = a.t - 1 GROUP BY a.model),
o AS (SELECT s.model, sum(n) AS n, sum(sx) AS sx, sum(sxx) AS sxx, sum(sz - n * m1 - sx * m2) AS y, sum(szx - sx * m1 - sxx * m2) AS yx FROM s JOIN cs ON cs.model = s.model AND cs.t = s.t GROUP BY s.model),
be AS (SELECT model, n, (y * sxx - yx * sx) / (n * sxx - sx * sx) AS b0, (n * yx - sx * y) / (n * sxx - sx * sx) AS b1 FROM o),
vv AS (SELECT s.model, sum(szz - 2 * (b0 + m1) * sz - 2 * (b1 + m2) * szx + (b0 + m1) * (b0 + m1) * cs.n + 2 * (b0 + m1) * (b1 + m2) * sx + (b1 + m2) * (b1 + m2) * sxx + cs.n * c11 + 2 * sx * c12 + sxx * c22) / any_value(be.n) AS v
  FROM s JOIN cs ON cs.model = s.model AND cs.t = s.t JOIN be ON be.model = s.model GROUP BY s.model)
SELECT k.model, round(e.ll, 3) AS loglik, round(be.b0, 4) AS b0, round(be.b1, 4) AS b1, round(vv.v, 4) AS v, round(s10_1 / s00_1, 4) AS g1, round(s10_2 / s00_2, 4) AS g2,
  round((s11_1 - 2 * g * s10_1 + g * g * s00_1) / steps, 4) AS w1, round((s11_2 - 2 * g2 * s10_2 + g2 * g2 * s00_2) / steps, 4) AS w2, round(s.m1, 4) AS m1, round(s.m2, 4) AS m2
FROM k JOIN (SELECT model, max_by(ll, t) AS ll FROM f GROUP BY model) e ON e.model = k.model JOIN lat ON lat.model = k.model JOIN be ON be.model = k.model JOIN vv ON vv.model = k.model JOIN s ON s.model = k.model AND s.t = -1""",
    "parameter_checks": f"""WITH {_MPANEL}, o AS (SELECT * FROM mpanel WHERE z IS NOT NULL), st AS (SELECT model, t, avg(z) AS mean, count(*) AS n FROM o GROUP BY 1, 2),
b AS (SELECT model, var_samp(mean) AS between_, avg(n) AS n FROM st GROUP BY 1), m AS (SELECT model, var_samp(z) AS v FROM o GROUP BY 1)
SELECT model, concat_ws(',', CASE WHEN v > 0 THEN NULL ELSE 'v' END, CASE WHEN round(between_ - v / n, 6) > 0 THEN NULL ELSE 'w' END) AS faults FROM m JOIN b USING (model)""",
    "lag_tests": f"WITH RECURSIVE {_LAG_TESTS} SELECT loc, block, CAST(q AS INTEGER) AS restrictions, CAST(n AS INTEGER) AS cells, CAST(9 AS INTEGER) AS rank, round(f, 4) AS f FROM tests",
    "lag_causality": f"WITH RECURSIVE {_LAG_TESTS} SELECT block, count(*) AS groups, CAST(any_value(q) AS INTEGER) AS restrictions, round((avg(q * f) - any_value(q)) / sqrt(2.0::DOUBLE * any_value(q) / count(*)), 4) AS z_f FROM tests GROUP BY block",
    "unit_root_tests": f"""WITH RECURSIVE {_CELLS}, z AS (SELECT loc, t, z, lag(z) OVER (PARTITION BY loc ORDER BY t) AS before FROM grid WHERE z IS NOT NULL),
l AS (SELECT loc, 1.0::DOUBLE AS one, before, z - before AS d, {', '.join(f'lag(z - before, {k}) OVER (PARTITION BY loc ORDER BY t) AS d{k}' for k in range(1, 9))} FROM z),
mats AS (SELECT loc, count(*) AS n, {_products(_ROOT)} AS m FROM l WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _ROOT)} GROUP BY loc),
sw AS (SELECT loc, n, 0 AS step, m FROM mats WHERE n > 10 UNION ALL SELECT loc, n, step + 1, {_sweep('m', '(step + 1)', 11)} FROM sw WHERE step < 10),
best AS (SELECT *, step - 2 AS lags, row_number() OVER (PARTITION BY loc ORDER BY n * ln(m[121] / n) + step * ln(n), step) AS r FROM sw WHERE step > 2),
tt AS (SELECT loc, n, lags, m[22] / sqrt(-m[13] * m[121] / (n - step)) AS t FROM best WHERE r = 1)
SELECT loc, n, CAST(lags AS INTEGER) AS lags, round(t, 4) AS t, t < CASE WHEN n < 25 THEN -3.0 WHEN n < 50 THEN -2.93 WHEN n < 100 THEN -2.89 WHEN n < 250 THEN -2.88 WHEN n < 500 THEN -2.87 ELSE -2.86 END AS reject FROM tt""",
    "stacked_tests": f"""WITH RECURSIVE {_COEF}, u AS (UNPIVOT c0 ON nb_1, nb_2, own_1, own_2 INTO NAME parameter VALUE value),
hyp(block, parameter) AS (VALUES ('nb', 'nb_1'), ('nb', 'nb_2'), ('own', 'own_1'), ('own', 'own_2'), ('all_four', 'nb_1'), ('all_four', 'nb_2'), ('all_four', 'own_1'), ('all_four', 'own_2')),
r AS (SELECT b, block, unnest([CAST(g AS VARCHAR), 'all']) AS regime, printf('%05d|%s', g, parameter) AS name, value FROM u JOIN hyp USING (parameter)),
names AS (SELECT block, regime, name, row_number() OVER (PARTITION BY block, regime ORDER BY name) AS i, count(*) OVER (PARTITION BY block, regime) AS q, e FROM (SELECT block, regime, name, avg(value) AS e FROM r GROUP BY ALL)),
whole AS (SELECT block, regime, b FROM (SELECT block, regime, b, count(*) AS n FROM r GROUP BY ALL) JOIN (SELECT DISTINCT block, regime, q FROM names) USING (block, regime) WHERE n = q),
used AS (SELECT block, regime, count(*) AS used FROM whole GROUP BY ALL),
x AS (SELECT r.block, r.regime, r.b, i, q, value FROM r JOIN whole USING (block, regime, b) JOIN names USING (block, regime, name)),
cov AS (SELECT a.block, a.regime, any_value(a.q) AS q, a.i, c.i AS j, covar_samp(a.value, c.value) AS v FROM x a JOIN x c USING (block, regime, b) GROUP BY a.block, a.regime, a.i, c.i),
edge AS (SELECT block, regime, q, i, j, v FROM cov UNION ALL SELECT block, regime, q, i, q + 1, e FROM names UNION ALL SELECT block, regime, q, q + 1, i, e FROM names UNION ALL SELECT DISTINCT block, regime, q, q + 1, q + 1, 0 FROM names),
mats AS (SELECT block, regime, any_value(q) AS q, list(v ORDER BY i, j) AS m FROM edge GROUP BY ALL),
sw AS (SELECT block, regime, q, 0 AS step, m FROM mats UNION ALL SELECT block, regime, q, step + 1, {_sweep('m', '(step + 1)', '(q + 1)')} FROM sw WHERE step < q)
SELECT block, regime, CAST(q AS INTEGER) AS q, CASE WHEN used > q THEN round(ln(-m[(q + 1) * (q + 1)]), 2) END AS log_statistic, CAST(used AS INTEGER) AS used FROM sw JOIN used USING (block, regime) WHERE step = q""",
    "ridge_fit": f"""WITH {_NORMAL}, x AS (SELECT *, {_ridge('0.3')} AS det, 1.3::DOUBLE AS q FROM r),
inv AS (SELECT *, (q * q - c * c) / det AS i00, (b * c - a * q) / det AS i01, (a * c - b * q) / det AS i02, (q - b * b) / det AS i11, (a * b - c) / det AS i12, (q - a * a) / det AS i22 FROM x)
SELECT model, round((i00 * w0 + i01 * w1 + i02 * w2) / s0, 5) AS b0, round((i01 * w0 + i11 * w1 + i12 * w2) / s1, 5) AS b1, round((i02 * w0 + i12 * w1 + i22 * w2) / s2, 5) AS b2, round(3 - 0.3 * (i11 + i22), 5) AS df, round(lref, 5) AS lambda_ref FROM inv""",
    "elastic_net": f"""WITH RECURSIVE {_NORMAL}, cd AS (SELECT model, 0 AS it, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2 FROM r
  UNION ALL SELECT model, it + 1, y0, y1, sign(w2 - b * y0 - c * y1) * greatest(abs(w2 - b * y0 - c * y1) - 0.15 * lref, 0) / 1.15 FROM (
    SELECT *, sign(w1 - a * y0 - c * x2) * greatest(abs(w1 - a * y0 - c * x2) - 0.15 * lref, 0) / 1.15 AS y1 FROM (SELECT cd.model, it, x1, x2, a, b, c, w1, w2, lref, w0 - a * x1 - b * x2 AS y0 FROM cd JOIN r USING (model) WHERE it < 400))),
f AS (SELECT r.*, x0, x1, x2 FROM cd JOIN r USING (model) WHERE it = 400)
SELECT model, round(x0 / s0, 5) + 0.0 AS b0, round(x1 / s1, 5) + 0.0 AS b1, round(x2 / s2, 5) + 0.0 AS b2,
  round(CASE WHEN x1 <> 0 AND x2 <> 0 THEN 3 - 0.15 * ((1.15 - b * b) + (1.15 - a * a)) / {_ridge('0.15')} WHEN x1 <> 0 THEN 2 - 0.15 / (1.15 - a * a) WHEN x2 <> 0 THEN 2 - 0.15 / (1.15 - b * b) ELSE 1 END, 5) AS df, round(lref, 5) AS lambda_ref FROM f""",
    "soft_threshold": "WITH s AS (SELECT l_suppkey, round(l_discount * 100) - 5 AS u FROM lineitem), t AS (SELECT l_suppkey, sign(u) * greatest(abs(u) - 2, 0) AS s FROM s) SELECT l_suppkey, sum(s) AS shrunk, count(CASE WHEN s = 0 THEN 1 END) AS zeros FROM t GROUP BY 1",
    "em_iteration": f"""WITH RECURSIVE {_FILTER}, one AS (SELECT s.model, s.m, s.c FROM s WHERE s.t = 0),
sm AS (SELECT model, t, m, c FROM s UNION ALL SELECT k.model, -1, k.m0 + k.c0 * k.g / (k.g * k.g * k.c0 + k.w) * (o.m - k.g * k.m0), k.c0 + (k.c0 * k.g / (k.g * k.g * k.c0 + k.w)) ** 2 * (o.c - k.g * k.g * k.c0 - k.w) FROM one o JOIN models k ON k.model = o.model),
lat AS (SELECT a.model, sum(b.m * b.m + b.c) AS s11, sum(b.m * a.m + f.c * k.g / (k.g * k.g * f.c + k.w) * b.c) AS s10, sum(a.m * a.m + a.c) AS s00, count(*) AS n FROM sm a JOIN sm b ON b.model = a.model AND b.t = a.t + 1 JOIN f ON f.model = a.model AND f.t = a.t JOIN models k ON k.model = a.model GROUP BY a.model),
cl AS (SELECT p.model, z - s.m AS y, x, s.c FROM mpanel p JOIN s ON s.model = p.model AND s.t = p.t WHERE z IS NOT NULL AND x IS NOT NULL),
be AS (SELECT model, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(c) AS spread, count(*) AS cells FROM cl GROUP BY model)
SELECT be.model, round(b0, 5) AS b0, round(b1, 5) AS b1, round((syy - b1 * sxy) / cells + spread, 5) AS v, round(s10 / s00, 5) AS g, round((s11 - s10 / s00 * s10) / n, 5) AS w, round(sm.m, 5) AS m0, round(f.ll, 3) AS loglik
FROM be JOIN lat ON lat.model = be.model JOIN sm ON sm.model = be.model AND sm.t = -1 JOIN last ON last.model = be.model JOIN f ON f.model = be.model AND f.t = last.t""",
    "penalised_step": f"""WITH RECURSIVE {_FILTER}, one AS (SELECT s.model, s.m, s.c FROM s WHERE s.t = 0),
sm AS (SELECT model, t, m, c FROM s UNION ALL SELECT k.model, -1, k.m0 + k.c0 * k.g / (k.g * k.g * k.c0 + k.w) * (o.m - k.g * k.m0), k.c0 + (k.c0 * k.g / (k.g * k.g * k.c0 + k.w)) ** 2 * (o.c - k.g * k.g * k.c0 - k.w) FROM one o JOIN models k ON k.model = o.model),
lat AS (SELECT a.model, sum(b.m * b.m + b.c) AS s11, sum(b.m * a.m + f.c * k.g / (k.g * k.g * f.c + k.w) * b.c) AS s10, sum(a.m * a.m + a.c) AS s00, count(*) AS n FROM sm a JOIN sm b ON b.model = a.model AND b.t = a.t + 1 JOIN f ON f.model = a.model AND f.t = a.t JOIN models k ON k.model = a.model GROUP BY a.model),
cl AS (SELECT p.model, z - s.m AS y, x, s.c FROM mpanel p JOIN s ON s.model = p.model AND s.t = p.t WHERE z IS NOT NULL AND x IS NOT NULL),
sz AS (SELECT model, count(DISTINCT loc) AS locations FROM mpanel GROUP BY model),
st AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, FALSE), (1, 0.1::DOUBLE, FALSE), (2, 0.1::DOUBLE, TRUE)) v(setting, lam, by_size)),
pr AS (SELECT model, locations, setting, lam * CASE WHEN by_size THEN (SELECT avg(locations) FROM sz) / locations ELSE 1 END AS lam FROM sz, st),
q AS (SELECT model, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, avg(c) AS spread FROM cl GROUP BY model),
be AS (SELECT q.*, locations, setting, lam, (sxy - sx * sy / n) / (sxx - sx * sx / n + lam * sxx) AS b1, 1 + (sxx - sx * sx / n) / (sxx - sx * sx / n + lam * sxx) AS df FROM q JOIN pr USING (model)),
bb AS (SELECT *, (sy - b1 * sx) / n AS b0 FROM be),
rs AS (SELECT bb.model, bb.setting, sum((y - b0 - b1 * x) * (y - b0 - b1 * x)) AS rss FROM bb JOIN cl ON cl.model = bb.model GROUP BY 1, 2)
SELECT bb.model, CAST(bb.setting AS INTEGER) AS setting, round(lam, 6) AS lam_used, locations, CAST(bb.n AS BIGINT) AS cells, round(bb.b0, 5) AS b0, round(bb.b1, 5) AS b1, round(df, 5) AS df, round(rss / bb.n + spread, 5) AS v, round(s10 / s00, 5) AS g, round((s11 - s10 / s00 * s10) / lat.n, 5) AS w, round(sm.m, 5) AS m0, round(f.ll - lam / 2 * sxx / k.v * k.b1 * k.b1, 3) AS merit
FROM bb JOIN rs ON rs.model = bb.model AND rs.setting = bb.setting JOIN lat ON lat.model = bb.model JOIN sm ON sm.model = bb.model AND sm.t = -1 JOIN last ON last.model = bb.model JOIN f ON f.model = bb.model AND f.t = last.t JOIN models k ON k.model = bb.model""",
    "case_frame": f"WITH {_DESIGN} SELECT loc, other, t, y, x, CAST(nr AS INTEGER) AS nr, presample FROM cases",
    "lag_design": f"WITH {_DESIGN}, l AS (SELECT loc, t, y, presample, {', '.join(f'lag(y, {k}) OVER w AS own_{k}, lag(x, {k}) OVER w AS nb_{k}' for k in range(1, 5))} FROM cases WINDOW w AS (PARTITION BY loc ORDER BY t)) SELECT * EXCLUDE (presample) FROM l WHERE NOT presample",
    "station_tests": f"WITH {_STATION} SELECT loc, 'nb' AS block, CAST(1 AS INTEGER) AS restrictions, CAST(n AS INTEGER) AS cells, CAST(3 AS INTEGER) AS rank, round(f, 4) AS f, round(w, 4) AS robust FROM tests",
    "causality_summary": f"WITH {_STATION} SELECT 'nb' AS block, count(*) AS groups, CAST(1 AS INTEGER) AS restrictions, round(sqrt(count(*) / 2::DOUBLE) * (avg(f) - 1), 4) AS z_f, round(sqrt(count(*) / 2::DOUBLE) * (avg(w) - 1), 4) AS z_robust FROM tests",
    "partial_autocorrelations": f"""WITH {_CELLS}, c AS (SELECT loc, t, z - avg(z) OVER (PARTITION BY loc) AS u FROM grid WHERE z IS NOT NULL),
l AS (SELECT loc, u, lag(u, 1) OVER w AS u1, lag(u, 2) OVER w AS u2, lag(u, 3) OVER w AS u3 FROM c WINDOW w AS (PARTITION BY loc ORDER BY t)),
r AS (SELECT loc, count(*) AS n, sum(u * u1) / sum(u * u) AS r1, sum(u * u2) / sum(u * u) AS r2, sum(u * u3) / sum(u * u) AS r3 FROM l GROUP BY loc),
p AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS p2 FROM r), q AS (SELECT *, r1 - p2 * r1 AS a FROM p), w AS (SELECT *, (r3 - a * r2 - p2 * r1) / (1 - a * r1 - p2 * r2) AS p3 FROM q),
v AS (SELECT *, n * ln(1 - r1 * r1) + 2 AS a1, n * ln((1 - r1 * r1) * (1 - p2 * p2)) + 4 AS a2, n * ln((1 - r1 * r1) * (1 - p2 * p2) * (1 - p3 * p3)) + 6 AS a3 FROM w)
SELECT loc, n, round(r1, 5) AS p1, round(p2, 5) AS p2, round(p3, 5) AS p3, CAST(CASE WHEN 0 <= least(a1, a2, a3) THEN 0 WHEN a1 <= least(a2, a3) THEN 1 WHEN a2 <= a3 THEN 2 ELSE 3 END AS INTEGER) AS ar_order FROM v""",
    "unchanged_share": f"WITH {_CELLS}, r AS (SELECT loc, t, round(z, 0) AS z FROM grid), l AS (SELECT loc, CAST(z = lag(z) OVER (PARTITION BY loc ORDER BY t) AS INTEGER)::DOUBLE AS same FROM r) SELECT loc, round(avg(same), 6) AS unchanged FROM l GROUP BY loc",
    "long_run_multipliers": f"WITH {_COEF}, l AS (SELECT g, own_1 + own_2 AS own, (nb_1 + nb_2) / (1 - (own_1 + own_2)) AS lrm FROM c0) SELECT g, round(quantile_cont(lrm, 0.025), 6) AS lrm_lo, round(quantile_cont(lrm, 0.975), 6) AS lrm_up, round(avg(own), 6) AS own, count(*) AS draws FROM l GROUP BY g",
    "named_parameters": f"WITH {_COEF}, u AS (UNPIVOT c0 ON nb_1, nb_2, own_1, own_2 INTO NAME parameter VALUE value) SELECT g, CASE parameter WHEN 'nb_1' THEN 'neighbour, lag 1' WHEN 'nb_2' THEN 'neighbour, lag 2' WHEN 'own_1' THEN 'own, lag 1' ELSE parameter END AS covariate, round(avg(value), 6) AS mean, count(value) AS n FROM u GROUP BY 1, 2",
    "stacked_cells": f"WITH {_CELLS} SELECT loc - (SELECT min(loc) FROM grid) AS loc, t, x FROM grid",
    "kernel_columns": f"""WITH {_NEAR}, e AS (SELECT i, j, h FROM knn UNION ALL SELECT loc, loc, 0.0::DOUBLE FROM places), k AS (SELECT i, j, h, exp(-2 * h) AS k, CASE WHEN i = j THEN 0.4::DOUBLE ELSE 0 END AS b FROM e)
SELECT i, j, round(k + b, 6) AS corr, CASE WHEN i = j THEN 1.4::DOUBLE ELSE 0 END AS plain, round(-2 * h * k, 6) + 0.0 AS d1, round(-2 * h * k * (1 - 2 * h), 6) + 0.0 AS d2, b AS db FROM k""",
    "location_scores": f"WITH RECURSIVE {_SCORES} SELECT loc, model, round(ll, 3) AS ll FROM scores",
    "penalised_objective": f"""WITH RECURSIVE {_SCORES}, {_NEAR}, sp AS (SELECT median(x) AS s FROM (SELECT max(ll) - min(ll) AS x FROM scores GROUP BY loc)), dg AS (SELECT avg(n) AS d FROM (SELECT count(*) AS n FROM graph GROUP BY i)),
sc AS (SELECT s / greatest(d, 1) AS scale FROM sp, dg), ag AS (SELECT CAST(sum(CASE WHEN a.nation = b.nation THEN 1 ELSE 0 END) AS BIGINT) AS agreeing FROM graph JOIN places a ON a.loc = i JOIN places b ON b.loc = j WHERE i < j),
ft AS (SELECT sum(ll) AS fit FROM scores JOIN nation ON n_name = model JOIN places ON places.loc = scores.loc AND nation = n_nationkey)
SELECT round(fit + 0.05 * scale * agreeing, 2) AS objective, round(fit, 2) AS fit, agreeing, round(scale, 3) AS scale FROM sc, ag, ft""",
    "regime_completion": f"""WITH RECURSIVE {_FILTER} SELECT p.model, p.loc, p.t, round(b0 + b1 * x + s.m, 5) AS fit, coalesce(z, round(b0 + b1 * x + s.m, 5)) AS filled FROM mpanel p LEFT JOIN (SELECT * FROM models WHERE b0 + v <> 131) k ON k.model = p.model LEFT JOIN s ON s.model = p.model AND s.t = p.t""",
    "inherited_regimes": f"""WITH {_PLACES}, p AS (SELECT places.*, s_acctbal AS bal FROM places JOIN supplier ON s_suppkey = loc),
d AS (SELECT a.loc, b.loc AS nearest, b.nation AS g, row_number() OVER (PARTITION BY a.loc ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.loc) AS r FROM p a JOIN p b ON b.bal >= 0 WHERE a.bal < 0) SELECT loc, nearest, g FROM d WHERE r = 1""",
    "parameter_counts": "SELECT DISTINCT o_custkey % 4 + 1 AS ncov, o_orderkey % 3 + 1 AS p, o_orderstatus = 'F' AS diag, CAST((o_custkey % 4 + 1) + 3 + CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 3 + 1 ELSE (o_orderkey % 3 + 1) * (o_orderkey % 3 + 1) END + 2 * (o_orderkey % 3 + 1) AS DOUBLE) AS npar FROM orders",
    "aligned_labels": """WITH RECURSIVE e AS (SELECT l_orderkey % 10 AS b, l_suppkey AS loc, CAST(count(*) % 3 + 1 AS INTEGER) AS g FROM lineitem GROUP BY 1, 2),
n AS (SELECT b, g, CAST(s_nationkey % 3 + 1 AS INTEGER) AS h, count(*) AS n FROM e JOIN supplier ON s_suppkey = loc GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, h, g) AS i FROM n),
w AS (SELECT DISTINCT b, 0 AS i, CAST([] AS INTEGER[]) AS gs, CAST([] AS INTEGER[]) AS hs FROM n
  UNION ALL SELECT w.b, w.i + 1, CASE WHEN list_contains(gs, g) OR list_contains(hs, h) THEN gs ELSE list_append(gs, g) END, CASE WHEN list_contains(gs, g) OR list_contains(hs, h) THEN hs ELSE list_append(hs, h) END FROM w JOIN o ON o.b = w.b AND o.i = w.i + 1),
f AS (SELECT b, gs, hs FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY i DESC) AS r FROM w) WHERE r = 1),
a AS (SELECT b, list_concat(gs, list_filter([1, 2, 3], lambda x: NOT list_contains(gs, x))) AS gs, list_concat(hs, list_filter([1, 2, 3], lambda x: NOT list_contains(hs, x))) AS hs FROM f)
SELECT b, unnest(gs) AS g, unnest(hs) AS h FROM a""",
    "extended_criteria": f"WITH {_REPS} SELECT rep, k, round(phi, 4) AS phi, {', '.join(f'round({c}, 4) AS {c}' for c in _CRITERIA)} FROM crit",
    "selection_by_criteria": f"WITH {_CHOSEN} SELECT rep, criterion, k, round(phi, 4) AS phi FROM chosen",
    "recovery_metrics": f"""WITH {_CHOSEN}, t AS (SELECT *, CAST(rep % 3 + 1 AS INTEGER) AS k_true FROM chosen)
SELECT criterion, k_true, count(*) AS m, round(avg(CAST(k = k_true AS INTEGER)), 6) AS k_ok, round(stddev_samp(CAST(k = k_true AS INTEGER)) / sqrt(count(*)), 6) AS k_ok_se, round(avg(CAST(k < k_true AS INTEGER)), 6) AS k_under, round(avg(CAST(k > k_true AS INTEGER)), 6) AS k_over FROM t GROUP BY 1, 2""",
    "design_cells": """WITH c AS (SELECT n, steps, omega, 5 AS knn FROM (VALUES (40), (100), (200)) a(n), (VALUES (60), (120)) b(steps), (VALUES (0.0::DOUBLE), (0.7), (1.0)) w(omega) UNION SELECT n, 120, 0.7::DOUBLE, knn FROM (VALUES (40), (100), (400)) a(n), (VALUES (3), (5), (10)) k(knn))
SELECT n, steps, omega, knn, printf('n%d_T%d_w%.2f_k%d', n, steps, omega, knn) AS cell, n * 1000 + steps * 10 + knn AS seed FROM c WHERE n * 0.2 >= 2 * knn""",
    "ordered_models": """WITH m AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1), t AS (SELECT n_name, n, n_regionkey FROM m JOIN nation ON n_nationkey = s_nationkey ORDER BY n, n_name LIMIT 10), r(n_regionkey, place) AS (VALUES (3, 1), (0, 2), (4, 3), (1, 4), (2, 5))
SELECT n_name, n, place, CAST(row_number() OVER (ORDER BY place, n, n_name) AS INTEGER) AS nr FROM t JOIN r USING (n_regionkey)""",
    "cv_folds": f"""WITH {_FOLDS}, s AS (SELECT 'LKLO' AS scheme, fold, lf = fold AS blank, lf = fold AS score FROM fo UNION ALL SELECT 'LKTO', fold, tf = fold, tf = fold FROM fo UNION ALL SELECT 'LKLHTO', fold, lf = fold OR tf = fold, lf = fold AND tf = fold FROM fo UNION ALL SELECT 'random', fold, cf = fold, cf = fold FROM fo)
SELECT scheme, fold, CAST(sum(CAST(blank AS INTEGER)) AS BIGINT) AS blank, CAST(sum(CAST(score AS INTEGER)) AS BIGINT) AS score FROM s GROUP BY 1, 2""",
    "series": f"WITH {_MPANEL} SELECT model, loc, t, z, CAST(dense_rank() OVER (PARTITION BY model ORDER BY loc) AS INTEGER) AS nr, CAST(row_number() OVER (PARTITION BY model, loc ORDER BY t) AS INTEGER) AS row FROM mpanel WHERE model IN ('NATION_1', 'NATION_2')",
    "departures": f"""WITH RECURSIVE {_FILTER}, y AS (SELECT p.loc, p.t, z - s.m AS y, x FROM mpanel p JOIN s ON s.model = p.model AND s.t = p.t),
a AS (SELECT loc, CASE WHEN count(y) >= 5 THEN regr_slope(y, x) END AS b, CASE WHEN count(y) >= 5 THEN regr_intercept(y, x) END AS a, CASE WHEN count(y) >= 5 THEN avg(y) END AS level FROM y GROUP BY loc),
u AS (SELECT y.loc, level, b, y - a - b * x AS u, lag(y - a - b * x) OVER (PARTITION BY y.loc ORDER BY t) AS u1 FROM y JOIN a ON a.loc = y.loc),
dep AS (SELECT loc, any_value(level) AS level, any_value(b) AS slope, CASE WHEN count(CASE WHEN u IS NOT NULL AND u1 IS NOT NULL THEN 1 END) >= 3 THEN corr(u, u1) END AS ar1, ln(greatest(var_samp(u), 2.2e-16)) AS logvar FROM u GROUP BY loc)
SELECT loc, {', '.join(f'round(coalesce({c}, (SELECT median({c}) FROM dep)), 4) AS {c}' for c in ('level', 'slope', 'ar1', 'logvar'))} FROM dep""",
}
