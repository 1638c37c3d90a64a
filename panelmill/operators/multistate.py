"""Models with any number of latent states, for many models at once.

z = x'beta + a'y_t + e with independent errors of variance v; y_t = G y_(t-1) + n_t, n_t of covariance W, and
y_0 of mean m0 and covariance c0.  A cell's loadings a are columns of the panel (a one for a level, a covariate for a
coefficient that changes in time).  A time step enters by the sums of products of its cells' columns only.  They are
aggregated in parallel over cells, so a model's task has one small matrix for each time step, however
many locations there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut_lineage
from .accelerate import plain, squared

LOG_2PI = 1.8378770664093453
PARAMETERS = ("beta", "g", "w", "m0", "c0")


def step_products(panel: DataFrame, columns: list[str]) -> DataFrame:
    """model, t, n, q: the cells of a step that have all columns, and the sums over them of the products of each two columns
    (upper triangle, by row).  A step without such cells has n = 0 and zeros."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = [F.coalesce(F.sum(F.when(ok, F.col(a).cast("double") * F.col(b).cast("double"))), F.lit(0.0)) for a, b in pairs]
    return panel.where("model IS NOT NULL AND t IS NOT NULL").groupBy("model", "t").agg(F.count(F.when(ok, 1)).cast("double").alias("n"), F.array(*sums).alias("q"))


def _square(flat: np.ndarray, k: int) -> np.ndarray:
    """steps x k x k from steps of upper triangles."""
    out = np.zeros((len(flat), k, k))
    i, j = np.triu_indices(k)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def smooth(n: np.ndarray, q: np.ndarray, p: dict) -> dict:
    """Filter and smoother of one model: smoothed means m and covariances c of the states from the start on, covariances
    ``lag`` of each step's state with the one before, and the loglik.  q: steps x k x k products of (z, x, a)."""
    d = len(p["beta"])
    res = q @ np.concatenate(([1.0], -p["beta"], np.zeros(q.shape[1] - 1 - d)))  # products of every column with z - x'beta
    rr = res[:, 0] - res[:, 1 : 1 + d] @ p["beta"]
    ra, aa = res[:, 1 + d :], q[:, 1 + d :, 1 + d :]
    k, steps, g, v = len(p["m0"]), len(n), p["g"], p["v"]
    m, c, ahead, ll = np.zeros((steps + 1, k)), np.zeros((steps + 1, k, k)), np.zeros((steps + 1, k, k)), 0.0
    m[0], c[0] = p["m0"], p["c0"]
    for t in range(steps):
        a, r = g @ m[t], g @ c[t] @ g.T + p["w"]
        ahead[t + 1], m[t + 1], c[t + 1] = r, a, r
        if n[t]:
            load = np.eye(k) + r @ aa[t] / v
            post = np.linalg.solve(load, r)
            c[t + 1] = (post + post.T) / 2
            u = ra[t] - aa[t] @ a
            m[t + 1] = a + c[t + 1] @ u / v
            ll -= 0.5 * (n[t] * (LOG_2PI + np.log(v)) + np.linalg.slogdet(load)[1] + (rr[t] - 2 * a @ ra[t] + a @ aa[t] @ a - u @ c[t + 1] @ u / v) / v)
    ms, cs, lag = m.copy(), c.copy(), np.zeros((steps, k, k))
    for t in range(steps - 1, -1, -1):
        b = np.linalg.solve(ahead[t + 1], g @ c[t]).T
        ms[t] = m[t] + b @ (ms[t + 1] - g @ m[t])
        cs[t] = c[t] + b @ (cs[t + 1] - ahead[t + 1]) @ b.T
        lag[t] = cs[t + 1] @ b.T
    return {"m": ms, "c": cs, "lag": lag, "loglik": float(ll)}


def em_step(n: np.ndarray, q: np.ndarray, p: dict, diagonal: bool = True) -> tuple[dict, float]:
    """(next parameters, loglik of the given ones).  ``diagonal`` keeps G and W diagonal: W is then taken with the old G and
    G with the new W; else both are free.  No step lowers the loglik."""
    f, d, steps = smooth(n, q, p), len(p["beta"]), len(n)
    m, c = f["m"], f["c"]
    s11, s00 = m[1:].T @ m[1:] + c[1:].sum(axis=0), m[:-1].T @ m[:-1] + c[:-1].sum(axis=0)
    s10 = m[1:].T @ m[:-1] + f["lag"].sum(axis=0)
    if diagonal:
        g = p["g"]
        w = np.diag(np.maximum(np.diag(s11 - s10 @ g.T - g @ s10.T + g @ s00 @ g.T) / steps, 1e-10))
        g = np.diag(np.diag(s10) / np.diag(s00))
    else:
        g = np.linalg.solve(s00, s10.T).T
        w = (s11 - g @ s10.T) / steps
        w = (w + w.T) / 2
    xx, state = q[:, 1 : 1 + d, 1 : 1 + d].sum(axis=0), m[1:]
    xz = q[:, 1 : 1 + d, 0].sum(axis=0) - np.einsum("tij,tj->i", q[:, 1 : 1 + d, 1 + d :], state)
    beta = np.linalg.lstsq(xx, xz, rcond=None)[0] if d else np.zeros(0)
    way = np.concatenate((np.ones((steps, 1)), np.tile(-beta, (steps, 1)), -state), axis=1)  # z - x'beta - a'y, squared and summed
    rest = np.einsum("ti,tij,tj->", way, q, way) + np.einsum("tij,tij->", q[:, 1 + d :, 1 + d :], c[1:])
    return {"beta": beta, "v": max(rest / n.sum(), 1e-10), "g": g, "w": w, "m0": m[0], "c0": p["c0"]}, f["loglik"]


def _packed(p: dict, diagonal: bool) -> np.ndarray:
    """Parameters as one vector without bounds: variances by logs, a free W by its factor with a log diagonal."""
    if diagonal:
        return np.concatenate((p["beta"], [np.log(p["v"])], np.diag(p["g"]), np.log(np.diag(p["w"])), p["m0"]))
    low = np.linalg.cholesky(p["w"] + 1e-12 * np.trace(p["w"]) * np.eye(len(p["w"])))
    return np.concatenate((p["beta"], [np.log(p["v"])], p["g"].ravel(), np.log(np.diag(low)), low[np.tril_indices(len(low), -1)], p["m0"]))


def _unpacked(u: np.ndarray, d: int, k: int, c0: np.ndarray, diagonal: bool) -> dict:
    out, at = {"beta": u[:d], "v": float(np.exp(u[d])), "m0": u[-k:], "c0": c0}, d + 1
    if diagonal:
        return out | {"g": np.diag(u[at : at + k]), "w": np.diag(np.exp(u[at + k : at + 2 * k]))}
    low = np.diag(np.exp(u[at + k * k : at + k * k + k]))
    low[np.tril_indices(k, -1)] = u[at + k * k + k : -k]
    return out | {"g": u[at : at + k * k].reshape(k, k), "w": low @ low.T}


def _given(row: pd.Series, k: int) -> dict:
    p = {c: np.asarray(row[c], dtype=float) for c in PARAMETERS} | {"v": float(row["v"])}
    return p | {c: p[c].reshape(k, k) for c in ("g", "w", "c0")}


def faults(models: DataFrame, coefficients: int, states: int) -> DataFrame:
    """model, faults: the parameters (in the order of the columns) that no model with so many coefficients and states can have:
    null, of another size, not finite, or a variance that is not above 0; an empty array if there are none."""
    sizes = {"beta": coefficients, "g": states * states, "w": states * states, "m0": states, "c0": states * states}
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    fine = {"v": finite(F.col("v")) & (F.col("v") > 0)}
    for c, n in sizes.items():
        fine[c] = F.col(c).isNotNull() & (F.size(c) == n) & F.forall(c, finite)
    for c in ("w", "c0"):
        for i in range(states):
            fine[c] = fine[c] & (F.get(F.col(c), F.lit(i * (states + 1))) > 0)
    marks = [F.when(F.coalesce(fine[c], F.lit(False)), F.lit(None)).otherwise(F.lit(c)) for c in ("beta", "v", "g", "w", "m0", "c0")]
    return models.select("model", F.array_compact(F.array(*marks)).alias("faults"))


def checked(models: DataFrame, coefficients: int, states: int) -> DataFrame:
    """models, computed once, or a ValueError that names up to five models with faults, or repeated ones."""
    kept = cut_lineage(models)
    bad = faults(kept, coefficients, states).where("size(faults) > 0").unionByName(kept.groupBy("model").count().where("count > 1").select("model", F.array(F.lit("repeated")).alias("faults")))
    found = bad.orderBy("model").take(5)
    if found:
        raise ValueError("parameters that no model can have: " + "; ".join(f"{r['model']}: {', '.join(r['faults'])}" for r in found))
    return kept


def _tasks(panel: DataFrame, columns: list[str], coefficients: int, states: int, models: DataFrame, run, schema: str) -> DataFrame:
    """run(model, its row of models, n, q, t) of every model that has one, each in a task of its own."""
    k, models = len(columns), checked(models, coefficients, states)

    def one(key: tuple, sums: pd.DataFrame, par: pd.DataFrame) -> pd.DataFrame:
        names = [c.strip().split(" ")[0] for c in schema.split(", ")]
        if not len(sums) or not len(par) or not sums["n"].sum():
            return pd.DataFrame({c: pd.Series(dtype=object) for c in names})
        sums = sums.sort_values("t")
        return run(key[0], par.iloc[0], sums["n"].to_numpy(), _square(np.stack(sums["q"].to_numpy()), k), sums["t"].to_numpy())[names]

    # numbered, as the few bytes of the sums would be put together into one task, though each model takes seconds
    tasks = panel.sparkSession.sparkContext.defaultParallelism * 3
    sums, models = step_products(panel, columns).repartition(tasks, "model"), models.repartition(tasks, "model")
    return sums.groupBy("model").cogroup(models.groupBy("model")).applyInPandas(one, schema)


_MODEL = "model string, beta array<double>, v double, g array<double>, w array<double>, m0 array<double>, c0 array<double>"


def fit(panel: DataFrame, response: str, design: list[str], loads: list[str], models: DataFrame, tol: float = 1e-3, most: int = 500, diagonal: bool = True, accelerate: bool = True) -> DataFrame:
    """model, beta, v, g, w, m0, c0, loglik, steps, converged: EM of every model to its tolerance.

    panel(model, t, response, design..., loads...); models has the parameters to start from, matrices as arrays by row.
    Cells with a null in any of these columns are gaps; a step without cells counts as a step.  A model without cells or
    without a row of models has no row here.  Rows without model or step are left out, and repeated rows count as cells."""
    k, d = len(loads), len(design)

    def run(model: str, row: pd.Series, n: np.ndarray, q: np.ndarray, t: np.ndarray) -> pd.DataFrame:
        p = _given(row, k)

        def step(u: np.ndarray) -> tuple[np.ndarray, float]:
            new, ll = em_step(n, q, _unpacked(u, d, k, p["c0"], diagonal), diagonal)
            return _packed(new, diagonal), ll

        u, ll, calls, done = (squared if accelerate else plain)(step, _packed(p, diagonal), tol, most)
        p = _unpacked(u, d, k, p["c0"], diagonal)
        return pd.DataFrame([{"model": model, "v": p["v"], **{c: p[c].ravel() for c in PARAMETERS}, "loglik": ll, "steps": calls, "converged": done}])

    return _tasks(panel, [response, *design, *loads], len(design), len(loads), models, run, _MODEL + ", loglik double, steps int, converged boolean")


def states(panel: DataFrame, response: str, design: list[str], loads: list[str], models: DataFrame) -> DataFrame:
    """model, t, m, c: smoothed means and covariances (by row) of the states, for every step of every model."""

    def run(model: str, row: pd.Series, n: np.ndarray, q: np.ndarray, t: np.ndarray) -> pd.DataFrame:
        s = smooth(n, q, _given(row, len(loads)))
        return pd.DataFrame({"model": model, "t": t, "m": list(s["m"][1:]), "c": [c.ravel() for c in s["c"][1:]]})

    return _tasks(panel, [response, *design, *loads], len(design), len(loads), models, run, "model string, t int, m array<double>, c array<double>")


def one_step(panel: DataFrame, response: str, design: list[str], loads: list[str], models: DataFrame, diagonal: bool = True) -> DataFrame:
    """model, beta, v, g, w, m0, c0, loglik: one EM step from the given parameters, with their loglik."""

    def run(model: str, row: pd.Series, n: np.ndarray, q: np.ndarray, t: np.ndarray) -> pd.DataFrame:
        p, ll = em_step(n, q, _given(row, len(loads)), diagonal)
        return pd.DataFrame([{"model": model, "v": p["v"], **{c: np.ravel(p[c]) for c in PARAMETERS}, "loglik": ll}])

    return _tasks(panel, [response, *design, *loads], len(design), len(loads), models, run, _MODEL + ", loglik double")
