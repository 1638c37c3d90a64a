"""The registered models on whole tables, and what they compute against brute force."""

import math

import numpy as np
from test_operators import as_frames, simulated

from panelmill.operators import statespace
from panelmill.plans import panel_queries, spatial_models
from panelmill.sources import store

DATA = "/root/testdata/sf0.001"


def test_spatial_queries_take_the_whole_panel(spark):
    g = panel_queries.grid(spark, DATA)
    filled = panel_queries.spatial_completion(spark, DATA).toPandas()
    assert set(zip(filled["loc"], filled["t"])) == {(r["loc"], r["t"]) for r in g.select("loc", "t").collect()} and filled["filled"].notna().all()
    new, steps = panel_queries.unseen_places(spark, DATA).count(), g.select("t").distinct().count()
    at = panel_queries.spatial_kriging(spark, DATA).toPandas()
    assert new > 0 and len(at) == new * steps == len(at.drop_duplicates(["model", "loc", "t"])) and at["z"].notna().all()


def test_kriging_against_the_dense_normal(spark):
    """State and errors of all cells and of the new place at once, conditioned on what was seen."""
    z, x, h, xy, p = simulated()
    cells, places = as_frames(spark, z, x, xy)
    fits = spark.createDataFrame([("a", *(float(p[c]) for c in "b0 b1 v w theta g q m0 c0".split()))], "model string, b0 double, b1 double, v double, w double, theta double, g double, q double, m0 double, c0 double")
    new = spark.createDataFrame([(99, 0.4, 0.3, 0.7)], "loc long, x double, y double, cov double")
    got = {r.t: (r.z, r.se) for r in spatial_models.krige(cells, places, fits, new).collect()}
    n, d = z.shape
    var = [p["c0"]]
    for _ in range(n):
        var.append(p["g"] ** 2 * var[-1] + p["q"])
    state = np.array([[p["g"] ** abs(s - t) * var[min(s, t) + 1] for s in range(n)] for t in range(n)])
    cov = np.kron(state, np.ones((d, d))) + np.kron(np.eye(n), spatial_models.covariance(h, p))
    level = np.array([p["g"] ** (t + 1) * p["m0"] for t in range(n)])
    seen = ~np.isnan(z.ravel())
    e = (z - p["b0"] - p["b1"] * x - level[:, None]).ravel()[seen]
    near = p["w"] * np.exp(-p["theta"] * np.sqrt(((xy - [0.4, 0.3]) ** 2).sum(axis=1)))
    assert set(got) == set(range(n))
    for t in range(n):
        with_new = np.kron(state[t], np.ones(d)) + np.kron(np.arange(n) == t, near)
        want = p["b0"] + p["b1"] * 0.7 + level[t] + with_new[seen] @ np.linalg.solve(cov[np.ix_(seen, seen)], e)
        ok = ~np.isnan(z[t])
        sigma = spatial_models.covariance(h, p)[np.ix_(ok, ok)]
        assert math.isclose(got[t][0], want, rel_tol=1e-8)
        assert math.isclose(got[t][1], math.sqrt(p["w"] - near[ok] @ np.linalg.solve(sigma, near[ok])), rel_tol=1e-8)


def test_em_on_sums_against_em_step(spark):
    z, x, _, xy, p = simulated(n=20)
    cells, _ = as_frames(spark, z, x, xy)
    start = statespace.start_values(cells)
    got = statespace.fit_on_sums(cells, start, 0.0, 2).first()
    one, _ = statespace.em_step(cells, store.cut_lineage(start))
    want = statespace.em_step(cells, store.cut_lineage(one))[0].first()
    assert got.steps == 2 and not got.converged
    assert all(math.isclose(got[c], want[c], rel_tol=1e-8, abs_tol=1e-10) for c in statespace.PARAMETERS)
    models = spark.createDataFrame([want])
    assert math.isclose(got.loglik, statespace.filtered(statespace.step_sums(cells, models)).first().loglik, rel_tol=1e-9)
    assert statespace.fit_on_sums(cells, start).first().converged


def test_regime_grid_takes_every_month_and_says_if_it_converged(spark):
    rows = panel_queries.regime_grid(spark, DATA).collect()
    cells = panel_queries.observed(spark, DATA).count()
    assert len(rows) == 5 and {r.nobs for r in rows} == {float(cells)}
    assert all(isinstance(r.converged, bool) and (not r.converged or r.moved == 0) for r in rows)


def gappy(d=40, n=30):
    rng = np.random.default_rng(4)
    xy = rng.normal(size=(d, 2))
    h = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    z, x = rng.normal(0, 3, (n, d)), rng.normal(size=(n, d))
    z[rng.uniform(size=z.shape) < 0.04] = np.nan
    z[3, rng.uniform(size=d) < 0.45] = np.nan  # more than are solved for together
    z[4, rng.uniform(size=d) < 0.9] = np.nan
    z[5] = np.nan
    return z, x, h


def test_smoother_against_the_dense_normal_for_all_numbers_of_gaps():
    z, x, h = gappy()
    n, d = z.shape
    p = spatial_models.start(z, x, h)
    sigma, r = spatial_models.covariance(h, p), z - p["b0"] - p["b1"] * x
    s = spatial_models.smooth(r, sigma, p)
    e, total = spatial_models.completed(r, sigma, s)
    var = [p["c0"]]
    for _ in range(n):
        var.append(p["g"] ** 2 * var[-1] + p["q"])
    state = np.array([[p["g"] ** abs(a - b) * var[min(a, b) + 1] for a in range(n)] for b in range(n)])
    cov = np.kron(state, np.ones((d, d))) + np.kron(np.eye(n), sigma)
    seen, y = ~np.isnan(r.ravel()), r.ravel()[~np.isnan(r.ravel())] - p["m0"]
    part = np.linalg.inv(cov[np.ix_(seen, seen)])
    level = np.kron(state, np.ones((1, d)))[:, seen]
    assert np.allclose(s["m"][1:], p["m0"] + level @ part @ y) and np.allclose(s["c"][1:], np.diag(state - level @ part @ level.T))
    assert math.isclose(s["loglik"], -0.5 * (seen.sum() * np.log(2 * np.pi) + np.linalg.slogdet(cov[np.ix_(seen, seen)])[1] + y @ part @ y), rel_tol=1e-9)
    errors = np.kron(np.eye(n), sigma)[:, seen]
    mean, left = (errors @ part @ y).reshape(n, d), np.kron(np.eye(n), sigma) - errors @ part @ errors.T
    assert np.allclose(e, mean) and np.allclose(total, mean.T @ mean + sum(left[t * d : t * d + d, t * d : t * d + d] for t in range(n)))


def test_one_factor_serves_all_patterns_of_gaps(monkeypatch):
    z, x, h = gappy()
    made, factor = [], np.linalg.cholesky
    monkeypatch.setattr(np.linalg, "cholesky", lambda a: made.append(a.shape[-1]) or factor(a))
    spatial_models.em(z, x, h, spatial_models.start(z, x, h), 0.0, 1, accelerate=False)
    assert len({tuple(row) for row in np.isnan(z)}) > 20 and sum(k > 20 for k in made) <= 2 * 5  # two steps of EM, three trials each
