"""Swept cross products against direct solutions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.operators import leastsquares as ls
from panelmill.operators import penalty


def test_sweep_is_a_regression():
    rng = np.random.default_rng(1)
    x = np.column_stack((np.ones(30), rng.normal(size=(30, 3))))
    x = np.column_stack((x, x[:, 1] - 2 * x[:, 2]))
    y = rng.normal(size=30)
    m = np.column_stack((x, y))
    a, kept = ls.swept(m.T @ m, range(5))
    beta, res, *_ = np.linalg.lstsq(x[:, :4], y, rcond=None)
    assert kept == [0, 1, 2, 3] and np.allclose(a[kept, -1], beta) and math.isclose(a[-1, -1], res[0])
    assert np.allclose(-a[:4, :4], np.linalg.inv(x[:, :4].T @ x[:, :4]))
    assert np.array_equal(ls.full([1, 2, 3], 2), [[1, 2], [2, 3]])


def test_blocks_and_few_cells(spark):
    rng = np.random.default_rng(4)
    n = 40
    x = rng.normal(size=(n, 3))
    y = 1 + x @ [0.5, 0.0, 1.0] + rng.normal(size=n) * (1 + abs(x[:, 0]))
    rows = [(1, float(y[t]), *map(float, x[t])) for t in range(n)] + [(2, 1.0, float(t), 0.0, 0.0) for t in range(2)] + [(1, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "loc long, y double, a double, b double, c double")
    got = {r["block"]: r for r in ls.block_tests(df, "loc", "y", ["a", "b", "c"], {"ab": ["a", "b"], "c": ["c"]}).collect()}
    z = np.column_stack((np.ones(n), x))
    inv = np.linalg.inv(z.T @ z)
    beta = inv @ z.T @ y
    e = y - z @ beta
    hc = inv @ (z.T * e**2) @ z @ inv * n / (n - 4)
    for block, j in (("ab", [1, 2]), ("c", [3])):
        rest = np.delete(z, j, axis=1)
        r = y - rest @ np.linalg.lstsq(rest, y, rcond=None)[0]
        assert math.isclose(got[block]["f"], (r @ r - e @ e) / len(j) / (e @ e / (n - 4)), rel_tol=1e-8)
        assert math.isclose(got[block]["robust"], beta[j] @ np.linalg.solve(hc[np.ix_(j, j)], beta[j]), rel_tol=1e-8)
    assert len(got) == 2 and got["c"]["f_p"] < 1e-3 and got["c"]["cells"] == n


def test_unit_root(spark):
    rng = np.random.default_rng(9)
    walk, back = np.cumsum(rng.normal(size=200)), np.zeros(200)
    for t in range(1, 200):
        back[t] = 0.3 * back[t - 1] + rng.normal()
    rows = [(i, t, None if t == 17 else float(s[t])) for i, s in ((1, walk), (2, back)) for t in range(200)] + [(3, t, float(t % 3)) for t in range(12)]
    got = {r["loc"]: r for r in ls.unit_root(spark.createDataFrame(rows, "loc long, t int, z double"), "z").collect()}
    assert set(got) == {1, 2} and not got[1]["reject"] and got[2]["reject"]
    for i, s in ((1, np.delete(walk, 17)), (2, np.delete(back, 17))):
        d, best = np.diff(s), None
        for lags in range(1, 9):
            x = np.array([[1, s[t], *d[t - lags : t][::-1]] for t in range(8, len(d))])
            y = d[8:]
            b = np.linalg.lstsq(x, y, rcond=None)[0]
            rss, k = ((y - x @ b) ** 2).sum(), x.shape[1]
            bic = len(y) * np.log(rss / len(y)) + k * np.log(len(y))
            if best is None or bic < best[0]:
                best = (bic, lags, b[1] / np.sqrt(rss / (len(y) - k) * np.linalg.inv(x.T @ x)[1, 1]))
        assert got[i]["lags"] == best[1] and math.isclose(got[i]["t"], best[2], rel_tol=1e-7) and got[i]["n"] == len(y)


def test_stacked_wald(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4)) @ np.diag([1, 2, 0.5, 1]) + [3, 0, 0, 0]
    rows = [(b, g, p, float(x[b, 2 * g + i])) for b in range(60) for g in (0, 1) for i, p in enumerate("uv") if (b, g, p) != (5, 1, "v")]
    draws = spark.createDataFrame(rows, "b long, g long, parameter string, value double")
    est = spark.createDataFrame([(0, "u", 3.0), (0, "v", 0.0), (1, "u", 0.0), (1, "v", 0.0)], "g long, parameter string, value double")
    asked = spark.createDataFrame([("both", "u"), ("both", "v"), ("one", "u")], "block string, parameter string")
    got = {(r["block"], r["regime"]): r for r in ls.stacked_wald(est, draws, asked).collect()}
    assert set(got) == {(b, r) for b in ("both", "one") for r in ("0", "1", "all")}
    y = np.delete(x, 5, axis=0)
    e = np.array([3.0, 0, 0, 0])
    want = e @ np.linalg.solve(np.cov(y, rowvar=False), e)
    r = got["both", "all"]
    around = np.einsum("bi,ij,bj->b", y - e, np.linalg.inv(np.cov(y, rowvar=False)), y - e)
    assert math.isclose(r["statistic"], want, rel_tol=1e-9) and r["q"] == 4 and r["used"] == 59 and math.isclose(r["p_boot"], (1 + (around >= want).sum()) / 60)
    assert got["both", "0"]["used"] == 60 and got["one", "1"]["q"] == 1 and got["both", "1"]["p_chisq"] > 0.5
    few = ls.stacked_wald(est, draws.where("b < 3"), asked).where("block = 'both' AND regime = 'all'").first()
    assert few["statistic"] is None and few["used"] == 3


@pytest.mark.parametrize("alpha", [0.0, 0.4, 1.0])
def test_penalty_with_free_columns(alpha):
    rng = np.random.default_rng(2)
    x = np.column_stack((np.ones(50), rng.normal(size=(50, 4))))
    y = x @ [2.0, 1.0, 0.0, -3.0, 0.1] + rng.normal(size=50)
    m, v, w, lam = x.T @ x, x.T @ y, np.array([0.0, 1, 1, 0, 1]), 0.3
    b, df, ref = penalty.solve(m, v, alpha, lam, w)
    s = np.sqrt(np.diag(m))
    left = v / s - (m / np.outer(s, s)) @ (b * s) - lam * (1 - alpha) * w * b * s
    line = lam * alpha * ref * w
    assert all(abs(left[j] - line[j] * np.sign(b[j])) < 1e-6 if b[j] else abs(left[j]) <= line[j] + 1e-6 for j in range(5))
    use = np.flatnonzero((b != 0) | (w == 0))
    a = (m / np.outer(s, s))[np.ix_(use, use)]
    assert math.isclose(df, np.trace(np.linalg.solve(a + np.diag(lam * (1 - alpha) * w[use]), a)), rel_tol=1e-9)
