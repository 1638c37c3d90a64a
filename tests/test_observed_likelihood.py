"""The augmented filter, conditional steps and two states against dense normal densities."""

import math

import numpy as np
import pytest

from panelmill.operators import statespace as ss
from panelmill.operators.accelerate import plain

P = {"b0": 0.4, "b1": -0.7, "v": 0.8, "g": 0.6, "w": 0.5, "m0": 0.3, "c0": 0.9}


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(12)
    n, d = 15, 6
    x = rng.normal(size=(n, d))
    y, z = 0.3, np.empty((n, d))
    for t in range(n):
        y = 0.6 * y + 0.7 * rng.normal()
        z[t] = 1 + 2 * x[t] + y + 0.9 * rng.normal(size=d)
    z[rng.uniform(size=z.shape) < 0.2] = np.nan
    z[3] = np.nan
    return z, x


def sums(z, x):
    ok = ~np.isnan(z)
    a, b = np.where(ok, z, 0.0), np.where(ok, x, 0.0)
    return [c.sum(axis=1).astype(float) for c in (ok, a, b, a * a, a * b, b * b)]


def dense(z, x, p, second=None):
    """Log density of the observed cells; ``second`` = (g2, w2) adds a coefficient of x that changes in time."""
    n, d = z.shape
    t, loc = np.nonzero(~np.isnan(z))
    mean = p["b0"] + p["b1"] * x[t, loc] + p["m0"] * p["g"] ** (t + 1.0)
    def cover(g, w):
        k = np.zeros((n, n))
        var = p["c0"]
        for i in range(n):
            var = g * g * var + w
            for j in range(i, n):
                k[i, j] = k[j, i] = g ** (j - i) * var
        return k
    s = cover(p["g"], p["w"])[np.ix_(t, t)] + p["v"] * np.eye(len(t))
    if second:
        s += np.outer(x[t, loc], x[t, loc]) * cover(*second)[np.ix_(t, t)]
    e = z[t, loc] - mean
    return -0.5 * (len(t) * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + e @ np.linalg.solve(s, e))


def panel_of(spark, z, x):
    n, d = z.shape
    return spark.createDataFrame([("m", i, t, None if np.isnan(z[t, i]) else float(z[t, i]), float(x[t, i])) for t in range(n) for i in range(d)], "model string, loc long, t int, z double, x double")


def test_form_is_the_observed_likelihood(spark, cells):
    z, x = cells
    form, right = ss.augmented_on_sums(*sums(z, x), P)
    value = lambda q: q @ form @ q / 2 - right @ q
    a, b = np.array([0.4, -0.7, 0.3]), np.array([1.0, 2.0, -0.5])
    change = dense(z, x, P) - dense(z, x, P | dict(zip(("b0", "b1", "m0"), b)))
    assert math.isclose(change, value(b) - value(a), rel_tol=1e-8)
    r = ss.augmented(panel_of(spark, z, x), spark.createDataFrame([("m", *(float(P[c]) for c in ss.PARAMETERS))], "model string, " + ", ".join(f"{c} double" for c in ss.PARAMETERS))).first()
    assert math.isclose(r["q_one_x"], form[0, 1], rel_tol=1e-9) and math.isclose(r["q_z_m0"], right[2], rel_tol=1e-9) and math.isclose(r["q_m0_m0"], form[2, 2], rel_tol=1e-9)


def test_conditional_steps_rise_and_lead(cells):
    s = sums(*cells)
    ll = {c: [ss._em_on_sums(*s, P, 0.0, k, False, c)[1] for k in range(8)] for c in (False, True)}
    assert all(b >= a - 1e-9 for c in ll for a, b in zip(ll[c], ll[c][1:]))
    assert ll[True][0] == ll[False][0] and all(a > b + 1 for a, b in zip(ll[True][3:], ll[False][3:]))
    best = ss._em_on_sums(*s, P, 1e-9, 5000, True, True)[0]
    form, right = ss.augmented_on_sums(*s, best)
    assert np.allclose(form @ [best["b0"], best["b1"], best["m0"]], right, rtol=1e-3)


def test_two_states(spark, cells):
    z, x = cells
    names = ("b0", "b1", "v", "g", "w", "g2", "w2", "m0", "c0")
    q = P | {"g2": 0.8, "w2": 0.4}
    r = ss.two_states(panel_of(spark, z, x), spark.createDataFrame([("m", *(float(q[c]) for c in names))], "model string, " + ", ".join(f"{c} double" for c in names))).first()
    assert math.isclose(r["loglik"], dense(z, x, P, (0.8, 0.4)), rel_tol=1e-9) and len(r["path"]) == len(z)


def test_bound_shrinks_only_where_it_bound():
    from panelmill.operators.accelerate import squared

    step = lambda u: (0.9 * u + 0.1, -float((u - 1) @ (u - 1)))
    fast, slow = squared(step, np.zeros(3), 1e-12, 500), plain(step, np.zeros(3), 1e-12, 500)
    assert fast[3] and slow[3] and fast[2] < slow[2] and np.allclose(fast[0], 1, atol=1e-4)
