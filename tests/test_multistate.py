"""Models with several states against the dense normal of all cells and states."""

import math

import numpy as np
import pytest

from panelmill.operators import multistate
from panelmill.operators import statespace as ss

G, W, C0 = np.array([[0.7, 0.2], [-0.1, 0.8]]), np.array([[0.5, 0.15], [0.15, 0.4]]), np.array([[0.9, 0.1], [0.1, 0.6]])
P = {"beta": np.array([0.4, -0.7]), "v": 0.8, "g": G, "w": W, "m0": np.array([0.3, -0.2]), "c0": C0}
DIAGONAL = P | {"g": np.diag([0.6, 0.8]), "w": np.diag([0.5, 0.4]), "c0": 0.9 * np.eye(2), "m0": np.array([0.3, 0.0])}


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(5)
    steps, d = 40, 6
    x, y, z = rng.normal(size=(steps, d)), np.array([0.3, -0.2]), np.empty((steps, d))
    for t in range(steps):
        y = G @ y + np.linalg.cholesky(W) @ rng.normal(size=2)
        z[t] = 1 + 2 * x[t] + y[0] + y[1] * x[t] + 0.9 * rng.normal(size=d)
    z[rng.uniform(size=z.shape) < 0.2] = np.nan
    z[3] = z[39] = np.nan
    return z, x


def products(z, x):
    ok = ~np.isnan(z)
    cols = np.stack([np.where(ok, c, 0.0) for c in (z, np.ones_like(z), x, np.ones_like(z), x)])
    return ok.sum(axis=1).astype(float), np.einsum("itd,jtd->tij", cols, cols)


def dense(z, x, p):
    """(loglik, means and covariance of the states from the start on given the cells)."""
    steps, k = len(z), 2
    var, cov = p["c0"], np.zeros((steps + 1, steps + 1, k, k))
    mean = [p["m0"]]
    for s in range(steps + 1):
        at = var
        for t in range(s, steps + 1):
            cov[t, s], cov[s, t] = at, at.T
            at = p["g"] @ at
        var = p["g"] @ var @ p["g"].T + p["w"]
        mean.append(p["g"] @ mean[-1])
    mean = np.concatenate(mean[:-1])
    full = cov.transpose(0, 2, 1, 3).reshape((steps + 1) * k, -1)
    t, loc = np.nonzero(~np.isnan(z))
    load = np.zeros((len(t), (steps + 1) * k))
    load[np.arange(len(t)), (t + 1) * k], load[np.arange(len(t)), (t + 1) * k + 1] = 1, x[t, loc]
    sigma = load @ full @ load.T + p["v"] * np.eye(len(t))
    e = z[t, loc] - p["beta"][0] - p["beta"][1] * x[t, loc] - load @ mean
    gain = np.linalg.solve(sigma, load @ full).T
    ll = -0.5 * (len(t) * np.log(2 * np.pi) + np.linalg.slogdet(sigma)[1] + e @ np.linalg.solve(sigma, e))
    return ll, (mean + gain @ e).reshape(-1, k), full - gain @ load @ full


def row(p, model="m"):
    return (model, [float(a) for a in p["beta"]], float(p["v"]), *[[float(a) for a in np.ravel(p[c])] for c in ("g", "w", "m0", "c0")])


def panel_of(spark, z, x, model="m"):
    return spark.createDataFrame([(model, i, t, None if np.isnan(z[t, i]) else float(z[t, i]), float(x[t, i]), 1.0) for t in range(len(z)) for i in range(z.shape[1])], "model string, loc long, t int, z double, x double, one double")


@pytest.mark.parametrize("p", [P, DIAGONAL])
def test_moments_are_those_of_the_dense_normal(cells, p):
    s = multistate.smooth(*products(*cells), p)
    ll, mean, cov = dense(*cells, p)
    assert math.isclose(s["loglik"], ll, rel_tol=1e-9) and np.allclose(s["m"], mean, atol=1e-9)
    for t in range(len(cells[0]) + 1):
        assert np.allclose(s["c"][t], cov[2 * t : 2 * t + 2, 2 * t : 2 * t + 2], atol=1e-9)
        assert t == 0 or np.allclose(s["lag"][t - 1], cov[2 * t : 2 * t + 2, 2 * t - 2 : 2 * t], atol=1e-9)


@pytest.mark.parametrize("diagonal", [True, False])
def test_no_step_lowers_the_loglik(cells, diagonal):
    p, n, q, seen = DIAGONAL, *products(*cells), []
    for _ in range(60):
        p, ll = multistate.em_step(n, q, p, diagonal)
        seen.append(ll)
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0] + 5
    if not diagonal:
        again = multistate._unpacked(multistate._packed(p, False), 2, 2, C0, False)
        assert all(np.allclose(again[c], p[c], rtol=1e-6, atol=1e-9) for c in ("beta", "v", "g", "w", "m0"))
    else:
        assert p["g"][0, 1] == 0 and p["w"][1, 0] == 0


def test_jobs(spark, cells):
    z, x = cells
    panel = panel_of(spark, z, x).unionByName(panel_of(spark, z * np.nan, x, "empty")).unionByName(panel_of(spark, z, x, "unasked"))
    odd = spark.createDataFrame([(None, 1, 1, 1.0, 1.0, 1.0), ("m", 1, None, 1.0, 1.0, 1.0), ("m", 9, 2, 50.0, None, 1.0)], panel.schema)
    models = spark.createDataFrame([row(DIAGONAL), row(DIAGONAL, "empty"), row(DIAGONAL, "absent")], multistate._MODEL)
    args = (panel.unionByName(odd), "z", ["one", "x"], ["one", "x"], models)
    s = multistate.smooth(*products(z, x), DIAGONAL)
    got = multistate.states(*args).orderBy("t").collect()
    assert [r.t for r in got] == list(range(len(z))) and {r.model for r in got} == {"m"}
    assert np.allclose([r.m for r in got], s["m"][1:]) and np.allclose([r.c for r in got], s["c"][1:].reshape(-1, 4))
    best = [multistate.fit(*args, 1e-6, 2000, diagonal=c).collect() for c in (True, False)]
    assert all(len(b) == 1 and b[0].converged for b in best) and best[1][0].loglik > best[0][0].loglik > s["loglik"]
    assert multistate.fit(panel.limit(0), *args[1:]).count() == 0
    one = multistate.one_step(*args).first()
    assert np.allclose(one.g, np.ravel(multistate.em_step(*products(z, x), DIAGONAL)[0]["g"]))


def test_native_smoother(spark, cells):
    z, x = cells
    names = ("b0", "b1", "v", "g", "w", "g2", "w2", "m0", "c0")
    m = spark.createDataFrame([("m", 0.4, -0.7, 0.8, 0.6, 0.5, 0.8, 0.4, 0.3, 0.9)], "model string, " + ", ".join(f"{c} double" for c in names))
    f = ss.two_states(panel_of(spark, z, x), m)
    assert len(f.first()["path"]) == len(z)
    got = ss.two_smoothed(f).orderBy("t").collect()
    _, mean, cov = dense(z, x, DIAGONAL)
    assert np.allclose([(r.m1, r.m2) for r in got], mean[1:], atol=1e-9)
    assert np.allclose([(r.c11, r.c12, r.c22) for r in got], [(cov[2 * t, 2 * t], cov[2 * t, 2 * t + 1], cov[2 * t + 1, 2 * t + 1]) for t in range(1, len(z) + 1)], atol=1e-9)


def test_fold_keeps_order_over_blocks(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 31, 32, 33, 100):
        xs = F.expr(f"slice(sequence(1, 200), 1, {n})")
        out = ss.folded(xs, F.struct(F.lit(0).alias("s")), lambda a, x: F.struct((a["s"] + x).alias("s")), lambda a, x: F.struct(x.alias("x"), a["s"].alias("s")), "struct<x:int,s:int>")
        r = spark.range(1).select(out.alias("o")).first()["o"]
        assert [(p.x, p.s) for p in r["path"]] == [(i, i * (i + 1) // 2) for i in range(1, n + 1)] and r["state"]["s"] == n * (n + 1) // 2


def test_faults_are_named(spark, cells):
    v = row(DIAGONAL)
    change = lambda name, at, value: (name, *[value if i == at else c for i, c in enumerate(v) if i])
    models = spark.createDataFrame([v, change("a", 2, 0.0), change("b", 3, [0.5]), change("c", 4, [1.0, 0.0, 0.0, -1.0]), change("d", 5, None), change("e", 1, [float("nan"), 1.0]), change("f", 6, [1.0, None, 0.0, 1.0]), change("g", 2, None)], multistate._MODEL)
    got = {r.model: r.faults for r in multistate.faults(models, 2, 2).collect()}
    assert got == {"m": [], "a": ["v"], "b": ["g"], "c": ["w"], "d": ["m0"], "e": ["beta"], "f": ["c0"], "g": ["v"]}
    args = (panel_of(spark, *cells), "z", ["one", "x"], ["one", "x"])
    for bad, text in ((models, "a: v"), (models.where("model = 'm'").unionByName(models.where("model = 'm'")), "m: repeated")):
        with pytest.raises(ValueError, match=text):
            multistate.fit(*args, bad)
