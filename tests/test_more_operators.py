"""Accelerated fits, penalties, partition passes and tests by location, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import as_frames, simulated

from panelmill.functions import distributions
from panelmill.operators import design, inference, leastsquares, partitions, penalty, statespace
from panelmill.plans import spatial_models


def test_accelerated_fits_reach_the_same_maximum(spark):
    z, x, h, xy, p = simulated(n=40)
    cells, _ = as_frames(spark, z, x, xy)
    start = statespace.start_values(cells)
    slow, fast = (statespace.fit_on_sums(cells, start, 1e-7, 5000, accelerate=a).first() for a in (False, True))
    assert abs(slow.loglik - fast.loglik) < 1e-3 and fast.converged and fast.steps < slow.steps
    a, b = (spatial_models.em(z, x, h, spatial_models.start(z, x, h), 1e-6, 4000, accelerate=a) for a in (False, True))
    assert abs(a[1] - b[1]) < 1e-2 and b[2] < a[2]


def test_spatial_gradient():
    rng = np.random.default_rng(3)
    xy = rng.uniform(size=(6, 2))
    h = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    true = {"v": 0.4, "w": 1.2, "theta": 3.0}
    total = 50 * spatial_models.covariance(h, true)
    got = spatial_models.fit_spatial(total, 50, h, {"v": 1.0, "w": 0.3, "theta": 6.0}, rounds=200)
    assert all(math.isclose(got[c], true[c], rel_tol=1e-2) for c in true)


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_penalty_is_optimal(alpha):
    """The gradient of the penalised sum of squares at the solution."""
    rng = np.random.default_rng(1)
    x = np.column_stack((np.ones(60), rng.normal(size=(60, 3)) * [1, 5, 0.1]))
    y = x @ [2.0, 1.0, 0.0, -3.0] + rng.normal(size=60)
    m, v, w, lam = x.T @ x, x.T @ y, penalty.penalised(4), 0.2
    b, df, ref = penalty.solve(m, v, alpha, lam, w)
    s = np.sqrt(np.diag(m))
    g = v / s - (m / np.outer(s, s)) @ (b * s) - lam * (1 - alpha) * w * b * s
    l1 = lam * alpha * ref * w
    assert all(abs(g[j] - l1[j] * np.sign(b[j])) < 1e-6 if b[j] else abs(g[j]) <= l1[j] + 1e-6 for j in range(4)) and 1 <= df <= 4
    assert np.allclose(penalty.solve(m, v, alpha, 0.0, w)[0], np.linalg.solve(m, v))
    assert penalty.penalised(3, [2]).tolist() == [0, 0, 1] and penalty.penalised(2, [True, False]).tolist() == [1, 0]


def test_passes_never_lower_the_objective(spark):
    rng = np.random.default_rng(7)
    n, k, w = 24, 3, 0.4
    ll = rng.normal(size=(n, k)) * 2
    scores = spark.createDataFrame([(i, g + 1, float(ll[i, g])) for i in range(n) for g in range(k)], "loc long, g int, ll double")
    edges = spark.createDataFrame([(i, j) for i in range(n) for j in range(n) if i != j and min(abs(i - j), n - abs(i - j)) <= 3], "i long, j long")
    labels = spark.createDataFrame([(i, i % k + 1) for i in range(n)], "loc long, g int")
    value = lambda x: partitions.objective(scores, x, edges, w).first().objective
    swept, moves = partitions.sweep(labels, scores, edges, w, least=4, rounds=30)
    assert moves > 0 and value(swept) > value(labels) and swept.count() == n and min(r["count"] for r in swept.groupBy("g").count().collect()) >= 4
    swapped, done = partitions.swaps(labels, scores, edges, w, rounds=4)
    sizes = lambda x: sorted((r["g"], r["count"]) for r in x.groupBy("g").count().collect())
    assert done > 0 and sizes(swapped) == sizes(labels) and value(swapped) > value(labels)
    lone = labels.withColumn("g", F.when(F.col("loc") == 0, 2).otherwise(1))
    assert all(r["count"] >= 5 for r in partitions.repaired(lone, scores, 3, 5).groupBy("g").count().collect())


def test_tests_by_location(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 50))
    y = 0.5 * a + 0.8 * b + rng.normal(size=50)
    df = spark.createDataFrame([(1, t, float(y[t]), float(a[t]), float(b[t]), float(2 * a[t])) for t in range(50)], "loc long, t int, y double, own_1 double, nb_1 double, copy double")
    r = leastsquares.block_tests(df, "loc", "y", ["own_1", "nb_1", "copy"], {"nb": ["nb_1"], "gone": ["copy"]}).collect()
    x = np.column_stack((np.ones(50), a, b))
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    assert len(r) == 1 and r[0]["rank"] == 3 and math.isclose(r[0].f, beta[2] ** 2 / inv[2, 2] / (e @ e / 47), rel_tol=1e-8)
    assert r[0].f_p < 0.01 and r[0].robust_p < 0.01
    s = design.mean_wald(spark.createDataFrame(r)).first()
    assert s.groups == 1 and math.isclose(s.z_f, math.sqrt(0.5) * (r[0].f - 1), rel_tol=1e-9) and s.share_f == 1


def test_tails():
    assert math.isclose(distributions.f_upper(4.0, 1, 10), 0.0734, abs_tol=5e-5) and math.isclose(distributions.f_upper(2.5, 3, 20), 0.0888, abs_tol=5e-4)
    assert math.isclose(distributions.lower_beta(2, 3, 0.4), 0.5248, abs_tol=1e-9)


def test_selection_without_groups_takes_the_pooled_model(spark):
    rows = spark.createDataFrame([(1, 0.0, 5.0, True), (2, 0.05, 4.0, False), (3, 0.05, float("nan"), True)], "k int, phi double, bic double, admissible boolean")
    assert inference.select_model(rows, 0.0, 1.0).first().k == 1
    assert inference.select_each(rows.withColumn("rep", F.lit(1)), ["rep"], 0.0, 1.0, ("bic",)).first().k == 1


def test_draws_that_are_no_numbers_are_left_out(spark):
    rows = [(b, 1, "u", v, 1.0) for b, v in enumerate([1.0, 2.0, 3.0, float("nan"), float("inf"), None])] + [(0, 2, "u", 1.0, 1.0)]
    got = {r.g: r for r in inference.draw_summary(spark.createDataFrame(rows, "b long, g long, parameter string, value double, est double")).collect()}
    assert got[1].n_draws == 3 and got[1].mean == 2.0 and got[1].normal_lo < got[1].normal_hi and got[2].n_draws == 1 and got[2].mean is None
