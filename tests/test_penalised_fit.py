"""Penalised EM against dense densities, against the plain fit, and its steps against their own objective."""

import math

import numpy as np
import pytest
from test_observed_likelihood import P, cells, dense, panel_of, sums  # noqa: F401

from panelmill.operators import penalised_fit as pf
from panelmill.operators import statespace as ss

DESIGN = ["one", "x", "noise"]


@pytest.fixture(scope="module")
def panel(spark, cells):  # noqa: F811
    from pyspark.sql import functions as F

    base = panel_of(spark, *cells).withColumn("one", F.lit(1.0)).withColumn("noise", F.sin(F.col("loc") * 7 + F.col("t") * 3))
    small = base.where("loc < 2").withColumn("model", F.lit("small"))
    return base.unionByName(small)


def matrices(z, x, extra):
    ok = ~np.isnan(z)
    out = []
    for t in range(len(z)):
        rows = np.column_stack([z[t], np.ones(z.shape[1]), x[t], extra[t], np.ones(z.shape[1])])[ok[t]]
        out.append(rows.T @ rows)
    return np.array(out)


def noise(shape):
    return np.array([[math.sin(i * 7 + t * 3) for i in range(shape[1])] for t in range(shape[0])])


def test_without_penalty_it_is_the_plain_fit(spark, cells):  # noqa: F811
    from pyspark.sql import functions as F

    p = panel_of(spark, *cells).withColumn("one", F.lit(1.0))
    start = ss.start_values(panel_of(spark, *cells)).withColumn("beta", F.array("b0", "b1"))
    for conditional in (False, True):
        one = pf.fit(p, "z", ["one", "x"], [pf.Settings(tol=1e-9, most=4000, conditional=conditional)], start).first()
        other = ss.fit_on_sums(p.drop("one"), ss.start_values(panel_of(spark, *cells)), 1e-9, 4000, accelerate=True, conditional=conditional).first()
        assert math.isclose(one["loglik"], other["loglik"], abs_tol=1e-5) and np.allclose(one["beta"], [other["b0"], other["b1"]], atol=1e-3)
        assert one["converged"] and one["fell"] == 0 and one["df"] == 2


def test_observed_form_is_the_density(cells):  # noqa: F811
    z, x = cells
    s = matrices(z, x, noise(z.shape))
    form, right = pf.observed_form(s, {**P, "beta": np.zeros(3)})
    value = lambda q: q @ form @ q / 2 - right @ q
    a, b = np.array([0.4, -0.7, 0.0, 0.3]), np.array([1.0, 2.0, 0.6, -0.5])
    change = dense(z, x, P) - dense(z - 0.6 * noise(z.shape), x, P | {"b0": 1.0, "b1": 2.0, "m0": -0.5})
    assert math.isclose(change, value(b) - value(a), rel_tol=1e-8)


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
@pytest.mark.parametrize("conditional", [False, True])
def test_no_step_lowers_the_penalised_likelihood(cells, alpha, conditional):  # noqa: F811
    z, x = cells
    s = matrices(z, x, noise(z.shape))
    for lam in (0.0, 0.3, 5.0):
        step = pf.Map(s, 1.0, pf.Settings(lam=lam, alpha=alpha, conditional=conditional), lam)
        u = step.pack(pf.start_point(s))
        for _ in range(40):
            u, _ = step(u)
        assert step.fell == 0 and step.steps == 39


def test_ridge_ends_where_its_equations_hold(cells):  # noqa: F811
    z, x = cells
    s = matrices(z, x, noise(z.shape))
    step = pf.Map(s, 1.0, pf.Settings(lam=0.7), 0.7)
    u = step.pack(pf.start_point(s))
    for _ in range(3000):
        u, _ = step(u)
    p = step.unpack(u)
    m, total = pf.smooth(s, p)["m"][1:], s.sum(axis=0)
    right = total[1:-1, 0] - m @ s[:, 1:-1, -1]
    cross = total[1:-1, 1:-1]
    want = np.linalg.solve(cross + 0.7 * np.diag(np.diag(cross) * [0, 1, 1]), right)
    assert np.allclose(p["beta"], want, atol=1e-8)
    fast = pf.squared(pf.Map(s, 1.0, pf.Settings(lam=0.7), 0.7), step.pack(pf.start_point(s)), 1e-10, 5000)
    assert np.allclose(fast[0][:3], p["beta"], atol=1e-3)


def test_settings_sizes_and_failures(spark, panel):
    asked = [pf.Settings(), pf.Settings(lam=2.0, alpha=1.0), pf.Settings(lam=0.5), pf.Settings(lam=0.5, by="size"), pf.Settings(lam=0.5, chosen=(2,))]
    empty = panel.where("model = 'm'").selectExpr("'none' AS model", "loc", "t", "CAST(NULL AS DOUBLE) AS z", "x", "one", "noise", "'extra' AS setting_name")
    fits = pf.fit(panel.unionByName(empty, allowMissingColumns=True), "z", DESIGN, asked)
    rows = {(r["model"], r["setting"]): r for r in fits.collect()}
    assert len(rows) == 15 and all(rows["none", i]["failure"].endswith("no complete cells") and rows["none", i]["beta"] is None for i in range(5))
    lasso = rows["m", 1]
    assert lasso["beta"][1] == lasso["beta"][2] == 0 and lasso["beta"][0] != 0 and lasso["df"] == 1
    assert all(r["fell"] == 0 for r in rows.values() if r["failure"] is None)
    mean = (6 + 2 + 6) / 3
    assert math.isclose(rows["small", 3]["lam_used"], 0.5 * mean / 2) and math.isclose(rows["m", 3]["lam_used"], 0.5 * mean / 6)
    assert abs(rows["small", 3]["beta"][1]) < abs(rows["small", 2]["beta"][1]) < abs(rows["small", 0]["beta"][1])
    assert abs(rows["m", 4]["beta"][1]) > abs(rows["m", 2]["beta"][1]) and abs(rows["m", 4]["beta"][2]) < abs(rows["m", 0]["beta"][2])
    assert rows["m", 2]["df"] < 3 and rows["m", 2]["merit"] < rows["m", 2]["loglik"] < rows["m", 0]["loglik"] + 1e-3
    p = {r["setting"]: r for r in pf.path(fits).collect()}
    assert sum(r["best"] for r in p.values()) == 1 and all(r["models"] == 3 and r["failed"] == 1 for r in p.values())
    done = pf.completed(panel, fits.where("setting = 0"), "z", DESIGN)
    got = done.selectExpr("count(*) AS n", "count(filled) AS filled", "count(z) AS z", "avg(abs(fit - z)) AS off").first()
    assert got["filled"] == got["n"] == panel.count() > got["z"] and got["off"] < 1
    assert [r["setting"] for r in pf.table(asked)] == list(range(5))


def test_settings_are_checked(panel):
    for wrong in ({"alpha": 2}, {"lam": -1}, {"lam": float("nan")}, {"by": "all"}, {"tol": 0}, {"most": 0}):
        with pytest.raises(ValueError):
            pf.Settings(**wrong)
    assert not pf.Settings(lam=1, alpha=0.5).extrapolates and pf.Settings(lam=1).extrapolates and pf.Settings(alpha=0.5).extrapolates
    with pytest.raises(ValueError):
        pf.fit(panel, "z", DESIGN, [pf.Settings(chosen=(7,))])
    with pytest.raises(ValueError):
        pf.fit(panel, "z", DESIGN, [])
