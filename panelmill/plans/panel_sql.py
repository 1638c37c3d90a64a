"""DuckDB SQL with the rows of the panel queries."""

from __future__ import annotations

_CELLS = """cells AS (SELECT l_suppkey AS loc, year(l_shipdate) * 12 + month(l_shipdate) AS m, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(l_extendedprice) / 100000 AS z, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(l_discount) / 100 AS x FROM lineitem GROUP BY 1, 2),
obs AS (SELECT loc, CAST(m - (SELECT min(m) FROM cells) AS INTEGER) AS t, z, x FROM cells),
grid AS (SELECT l.loc, s.t, o.z, coalesce(o.x, 0.05) AS x FROM (SELECT DISTINCT loc FROM obs) l CROSS JOIN (SELECT DISTINCT t FROM obs) s LEFT JOIN obs o ON o.loc = l.loc AND o.t = s.t)"""
_PLACES = "places AS (SELECT s_suppkey AS loc, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y, s_nationkey AS nation FROM supplier JOIN embeddings ON vec_id = s_suppkey)"
_NEAR = f"""{_PLACES},
pairs AS (SELECT a.loc AS i, b.loc AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS h FROM places a JOIN places b ON a.loc <> b.loc),
knn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY h, j) AS INTEGER) AS rank FROM pairs) WHERE rank <= 4),
graph AS (SELECT i, j FROM knn UNION SELECT j, i FROM knn)"""
_MODELS = "models AS (SELECT n_name AS model, 37.0::DOUBLE AS b0, 2.0::DOUBLE AS b1, 90.0::DOUBLE + n_nationkey AS v, 0.5::DOUBLE + n_nationkey / 100 AS g, 3.0::DOUBLE AS w, 0.0::DOUBLE AS m0, 1.0::DOUBLE AS c0 FROM nation)"
_MPANEL = f"""{_CELLS},
mpanel AS (SELECT g.*, n_name AS model FROM grid g JOIN supplier ON s_suppkey = loc JOIN nation ON s_nationkey = n_nationkey)"""
_FILTER = f"""{_MPANEL}, {_MODELS},
sums AS (SELECT p.model, p.t, count(z) AS n, coalesce(sum(z - b0 - b1 * x), 0) AS s, coalesce(sum((z - b0 - b1 * x) * (z - b0 - b1 * x)), 0) AS q,
  any_value(v) AS v, any_value(g) AS g, any_value(w) AS w, any_value(m0) AS m0, any_value(c0) AS c0 FROM mpanel p JOIN models USING (model) GROUP BY p.model, p.t),
f AS (SELECT DISTINCT model, -1 AS t, m0 AS m, c0 AS c, 0.0::DOUBLE AS ll FROM sums
  UNION ALL
  SELECT model, t, CASE WHEN n > 0 THEN a + r * (s - n * a) / (v + n * r) ELSE a END, CASE WHEN n > 0 THEN r * v / (v + n * r) ELSE r END,
    ll + CASE WHEN n > 0 THEN -0.5 * (n * 1.8378770664093453::DOUBLE + (n - 1) * ln(v) + ln(v + n * r) + (q - 2 * a * s + n * a * a - r * (s - n * a) * (s - n * a) / (v + n * r)) / v) ELSE 0 END
  FROM (SELECT k.model, k.t, k.n, k.s, k.q, k.v, k.g * f.m AS a, k.g * k.g * f.c + k.w AS r, f.ll FROM f JOIN sums k ON k.model = f.model AND k.t = f.t + 1)),
last AS (SELECT model, max(t) AS t FROM f GROUP BY model),
s AS (SELECT f.model, f.t, f.m, f.c FROM f JOIN last USING (model, t)
  UNION ALL
  SELECT f.model, f.t, f.m + f.c * k.g / (k.g * k.g * f.c + k.w) * (s.m - k.g * f.m),
    f.c + (f.c * k.g / (k.g * k.g * f.c + k.w)) * (f.c * k.g / (k.g * k.g * f.c + k.w)) * (s.c - k.g * k.g * f.c - k.w)
  FROM s JOIN f ON f.model = s.model AND f.t = s.t - 1 JOIN models k ON k.model = s.model WHERE f.t >= 0)"""
_GRID = """gt AS (SELECT CAST(o_orderkey % 5 + 1 AS INTEGER) AS k, (o_custkey % 7) * 0.025::DOUBLE AS phi, round(-avg(o_totalprice) / 100, 2) AS loglik, (o_orderkey % 5 + 1) * 6.0::DOUBLE AS df, 5000.0::DOUBLE AS nobs, count(*) % 9 <> 0 AS admissible FROM orders GROUP BY o_orderkey % 5, o_custkey % 7),
crit AS (SELECT *, -2 * loglik + 2 * df AS aic, -2 * loglik + ln(nobs) * df AS bic, -2 * loglik + 3 * df AS kic, -2 * loglik + 2 * df * ln(ln(nobs)) AS hq, -2 * loglik + 2 * df * nobs / (nobs - df - 1) AS aicc FROM gt)"""
_DRAWS = """d0 AS (SELECT l_orderkey % 50 AS b, l_suppkey % 4 AS g, round(avg(l_discount), 6) AS disc, round(avg(l_quantity), 6) AS quant FROM lineitem GROUP BY 1, 2),
draws AS (SELECT b, g, 'disc' AS parameter, disc AS value, 0.05::DOUBLE AS est FROM d0 UNION ALL SELECT b, g, 'quant', quant, 25.0::DOUBLE FROM d0)"""
_DIAG = f"""{_CELLS},
r0 AS (SELECT loc, t, z - avg(z) OVER (PARTITION BY loc) AS r FROM grid WHERE z IS NOT NULL),
r1 AS (SELECT *, {", ".join(f"lag(r, {k}) OVER (PARTITION BY loc ORDER BY t) AS r{k}" for k in range(1, 5))} FROM r0),
r2 AS (SELECT loc, count(*) AS n, sum(r * r) AS c0, avg(r ** 4) AS m4, {", ".join(f"sum(r * r{k}) AS c{k}" for k in range(1, 5))} FROM r1 GROUP BY loc),
diag AS (SELECT loc, round(n * (n + 2) * ({" + ".join(f"(c{k} / c0) ** 2 / (n - {k})" for k in range(1, 5))}), 4) AS q4, round(c1 / c0, 5) AS acf1, round(m4 / (c0 / n) ** 2, 4) AS kurtosis FROM r2)"""

ORACLES: dict[str, str] = {
    "panel_dense": f"WITH {_CELLS} SELECT loc, t, z, x FROM grid",
    "panel_checks": f"""WITH {_CELLS}, l AS (SELECT loc, count(*) AS n, count(z) AS seen, count(DISTINCT t) AS steps FROM grid GROUP BY loc)
SELECT count(*) AS d, max(steps) AS n, CAST(sum(seen) AS BIGINT) AS observed, CAST(sum(n) - sum(seen) AS BIGINT) AS missing, CAST(sum(CASE WHEN seen = 0 THEN 1 ELSE 0 END) AS BIGINT) AS never_observed,
  CAST(sum(CASE WHEN n <> steps THEN 1 ELSE 0 END) AS BIGINT) AS repeated_cells FROM l""",
    "panel_relative": f"""WITH {_CELLS}, lv AS (SELECT t, round(avg(z), 6) AS level FROM grid GROUP BY t),
c AS (SELECT loc, grid.t, 100 * (z - level) AS c FROM grid JOIN lv ON lv.t = grid.t)
SELECT loc, t, round(c - avg(CASE WHEN t >= 12 THEN c END) OVER (PARTITION BY loc), 5) AS rel FROM c""",
    "panel_lags": f"WITH {_CELLS} SELECT loc, t, {', '.join(f'lag(z, {k}) OVER (PARTITION BY loc ORDER BY t) AS z_lag{k}' for k in range(1, 5))} FROM grid",
    "panel_pulses": """WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), times AS (SELECT CAST(day - (SELECT min(day) FROM days) AS INTEGER) AS t, day FROM days),
ev(event, day) AS (VALUES ('a', DATE '2024-01-05'), ('b', DATE '2024-01-12'), ('c', DATE '2024-01-30'), ('d', DATE '2025-01-01')),
f AS (SELECT event, min(t) AS t FROM times s JOIN ev e ON s.day >= e.day GROUP BY event)
SELECT event, t, 1 AS first, 0 AS second FROM f UNION ALL SELECT event, (SELECT min(t) FROM times WHERE times.t > f.t), 0, 1 FROM f WHERE EXISTS (SELECT 1 FROM times WHERE times.t > f.t)""",
    "panel_observed_index": f"""WITH {_CELLS} SELECT t, count(z) AS n_obs, CASE WHEN count(z) = count(*) THEN NULL WHEN count(z) = 0 THEN 'p' ELSE concat_ws('.', count(z), CAST(sum(CASE WHEN z IS NOT NULL THEN (loc * 2654435761 + 97) % 2147483647 END) AS BIGINT), CAST(sum(CASE WHEN z IS NOT NULL THEN (loc * 40503 + 1013904223) % 2147483629 END) AS BIGINT)) END AS pattern FROM grid GROUP BY t""",
    "panel_covariate_means": f"WITH {_CELLS} SELECT loc, round(avg(x), 6) AS x_mean, count(z) AS seen FROM grid GROUP BY loc",
    "places_apart": f"""WITH {_PLACES}, p AS (SELECT loc, round(x, 1) AS x, round(y, 1) AS y FROM places), a AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY loc) - 1 AS again FROM p),
k AS (SELECT loc, row_number() OVER (ORDER BY loc) AS k FROM a WHERE again > 0)
SELECT a.loc, round(x + coalesce(k, 0) * 1e-5, 6) AS x, round(y + coalesce(k, 0) * 1e-5, 6) AS y FROM a LEFT JOIN k ON a.loc = k.loc""",
    "knn_graph": f"WITH {_NEAR} SELECT i, j FROM graph",
    "knn_distances": f"WITH {_NEAR} SELECT i, j, round(h, 6) AS h, rank FROM knn",
    "potts_pairs": f"WITH {_NEAR} SELECT count(*) AS pairs, CAST(sum(CASE WHEN a.nation % 5 = b.nation % 5 THEN 1 ELSE 0 END) AS BIGINT) AS agreeing FROM graph JOIN places a ON a.loc = i JOIN places b ON b.loc = j WHERE i < j",
    "nearest_of_nation": f"""WITH {_PLACES}, p AS (SELECT a.loc, b.loc AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS h FROM places a JOIN places b ON a.nation = b.nation AND a.loc <> b.loc JOIN supplier ON s_suppkey = b.loc WHERE s_acctbal > 0)
SELECT loc, j AS nearest, round(h, 3) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY loc ORDER BY h, j) AS r FROM p) WHERE r = 1""",
    "decay_limits": f"WITH {_NEAR} SELECT round(ln(-ln(0.95::DOUBLE) / max(h)), 6) AS lower, round(ln(-ln(0.05::DOUBLE) / min(h)), 6) AS upper FROM knn WHERE h > 0",
    "distance_bins": f"""WITH {_NEAR}, b AS (SELECT round(h, 6) AS h FROM knn) SELECT CAST(CASE WHEN h <= 0 THEN NULL WHEN h <= 0.05 THEN 1 WHEN h <= 0.1 THEN 2 WHEN h <= 0.2 THEN 3 WHEN h <= 0.5 THEN 4 WHEN h <= 1 THEN 5 WHEN h <= 10 THEN 6 END AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY 1""",
    "partitions_ari": """WITH c AS (SELECT c_mktsegment AS a, c_nationkey % 5 AS b, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1, 2),
s AS (SELECT sum(n * (n - 1) / 2) AS same, sum(n) AS total FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((same - x.v * y.v / (total * (total - 1) / 2)) / ((x.v + y.v) / 2 - x.v * y.v / (total * (total - 1) / 2)), 8) AS ari FROM s, x, y""",
    "contingency": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2",
    "information_criteria": f"WITH {_GRID} SELECT k, round(phi, 4) AS phi, {', '.join(f'round({c}, 4) AS {c}' for c in ('aic', 'bic', 'kic', 'hq', 'aicc'))} FROM crit",
    "model_selection": f"""WITH {_GRID}, ok AS (SELECT * FROM crit WHERE admissible), inside AS (SELECT * FROM ok WHERE k > 1 AND ((phi >= 0.02 AND phi <= 0.2) OR (SELECT count(DISTINCT phi) FROM ok WHERE k > 1 AND phi >= 0.02 AND phi <= 0.2) < 2)),
b AS (SELECT phi, k, bic FROM (SELECT *, row_number() OVER (PARTITION BY phi ORDER BY bic, k) AS r FROM inside) WHERE r = 1),
votes AS (SELECT CASE WHEN (SELECT min(bic) FROM ok WHERE k = 1) <= bic THEN 1 ELSE k END AS k FROM b),
ch AS (SELECT k FROM votes GROUP BY k ORDER BY count(*) DESC, k LIMIT 1)
SELECT CAST(k AS INTEGER) AS k, round(phi, 4) AS phi, round(bic, 4) AS bic FROM ok WHERE k = (SELECT k FROM ch) ORDER BY ok.bic, ok.phi LIMIT 1""",
    "draw_summary": f"""WITH {_DRAWS}, s AS (SELECT g, parameter, count(value) AS n_draws, any_value(est) AS est, avg(value) AS mean, stddev_samp(value) AS se, quantile_cont(value, 0.025) AS q_lo, quantile_cont(value, 0.975) AS q_hi FROM draws GROUP BY g, parameter)
SELECT g, parameter, n_draws, round(mean, 6) AS mean, round(se, 6) AS se, round(mean - est, 6) AS bias, round(q_lo, 6) AS q_lo, round(q_hi, 6) AS q_hi, round(2 * est - q_hi, 6) AS basic_lo, round(2 * est - q_lo, 6) AS basic_hi FROM s""",
    "group_differences": f"""WITH {_DRAWS}, d AS (SELECT a.parameter, a.g, c.g AS h, a.value - c.value AS d FROM draws a JOIN draws c ON a.b = c.b AND a.parameter = c.parameter AND a.g < c.g)
SELECT parameter, g, h, round(avg(d), 6) AS diff, round(least(1.0::DOUBLE, 2 * least(avg(CASE WHEN d <= 0 THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN d >= 0 THEN 1.0::DOUBLE ELSE 0 END))), 6) AS p, count(*) AS n FROM d GROUP BY 1, 2, 3""",
    "co_clustering": """WITH e AS (SELECT event_id % 10 AS b, user_id AS loc, count(*) % 3 AS g FROM events GROUP BY 1, 2)
SELECT x.loc AS i, y.loc AS j, round(avg(CASE WHEN x.g = y.g THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM e x JOIN e y ON x.b = y.b AND y.loc IN (x.loc + 1, x.loc + 2) GROUP BY 1, 2""",
    "vote_mode": "SELECT l_suppkey, l_linenumber, votes FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, l_linenumber) AS r FROM (SELECT l_suppkey, l_linenumber, count(*) AS votes FROM lineitem GROUP BY 1, 2)) WHERE r = 1",
    "fold_errors": f"""WITH {_CELLS}, lf AS (SELECT loc, CAST((row_number() OVER (ORDER BY (loc * 7919) % 1000003, loc) - 1) % 5 + 1 AS INTEGER) AS loc_fold FROM (SELECT DISTINCT loc FROM grid)),
fit AS (SELECT t, round(avg(z), 6) AS fit FROM grid GROUP BY t),
e AS (SELECT greatest(1, CAST(ceil((g.t - (SELECT min(t) FROM grid)) * 5 / CAST((SELECT max(t) - min(t) FROM grid) AS DOUBLE)) AS INTEGER)) AS time_fold, loc_fold, z - fit AS e FROM grid g JOIN lf ON lf.loc = g.loc JOIN fit ON fit.t = g.t WHERE z IS NOT NULL AND fit IS NOT NULL),
s AS (SELECT time_fold, loc_fold, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM e GROUP BY 1, 2)
SELECT time_fold, loc_fold, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, CAST(rank() OVER (ORDER BY round(rmse, 9)) AS INTEGER) AS place FROM s""",
    "residual_diagnostics": f"WITH {_DIAG} SELECT * FROM diag",
    "start_values": f"""WITH {_MPANEL}, s AS (SELECT model, regr_slope(z, x) AS b1, regr_intercept(z, x) AS b0, greatest((regr_syy(z, x) - regr_slope(z, x) * regr_sxy(z, x)) / count(*), 1e-8) AS v FROM mpanel WHERE z IS NOT NULL GROUP BY model)
SELECT model, round(b0, 4) AS b0, round(b1, 4) AS b1, round(0.6 * v, 4) AS v, round(0.2 * v, 4) AS w FROM s""",
    "kalman_filter": f"""WITH RECURSIVE {_FILTER} SELECT f.model, round(e.ll, 3) AS loglik, f.t, round(f.m, 5) AS m, round(f.c, 5) AS c FROM f JOIN last ON last.model = f.model JOIN f e ON e.model = last.model AND e.t = last.t WHERE f.t >= 0""",
    "kalman_smoother": f"WITH RECURSIVE {_FILTER} SELECT model, t, round(m, 5) AS m, round(c, 5) AS c FROM s",
    "completion": f"""WITH RECURSIVE {_FILTER} SELECT p.model, p.loc, p.t, round(b0 + b1 * x + s.m, 5) AS fit, coalesce(z, round(b0 + b1 * x + s.m, 5)) AS filled FROM mpanel p JOIN models USING (model) JOIN s ON s.model = p.model AND s.t = p.t""",
    "label_update": f"""WITH {_NEAR}, n AS (SELECT i, nation % 5 AS g, count(*) AS n FROM graph JOIN places ON loc = j GROUP BY 1, 2)
SELECT i AS loc, g, n AS agreeing FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY n DESC, g) AS r FROM n) WHERE r = 1""",
    "wide_pivot": "SELECT user_id, " + ", ".join(f"count(CASE WHEN event_type = '{e}' THEN 1 END) AS {e}" for e in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id",
    "totals": "SELECT coalesce(o_orderstatus, 'all') AS status, count(*) AS n, round(sum(o_totalprice), 1) AS total FROM orders GROUP BY ROLLUP (o_orderstatus)",
    "resume_tasks": "SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)",
    "monte_carlo": "SELECT event_type, round(avg(value), 5) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS se, count(value) AS m, round(quantile_cont(value, 0.5), 5) AS median FROM events GROUP BY event_type",
    "top_brand": "SELECT p_type, p_brand AS brand, round(n / CAST(total AS DOUBLE), 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS r, sum(n) OVER (PARTITION BY p_type) AS total FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2)) WHERE r = 1",
    "complete_groups": """WITH n AS (SELECT l_orderkey AS k, count(*) AS lines FROM lineitem GROUP BY 1), o AS (SELECT o_orderstatus, lines FROM orders JOIN n ON o_orderkey = k),
m AS (SELECT o_orderstatus, lines FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY c DESC, lines) AS r FROM (SELECT o_orderstatus, lines, count(*) AS c FROM o GROUP BY 1, 2)) WHERE r = 1)
SELECT o_orderstatus, count(*) AS n FROM o JOIN m USING (o_orderstatus, lines) GROUP BY 1""",
    "cost_projection": """WITH m AS (SELECT user_id, avg(value) AS cost FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, round(coalesce(cost, (SELECT avg(cost) FROM m)) * 100, 3) AS hours FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN m USING (user_id)""",
}
