"""EM with any number of covariates and a penalty on their coefficients, for many models and settings in the same job.

Cells are summed once, by model and time step, into the products of response, covariates and a one.  A task
has these sums of one model under one setting, so its size does not grow with the locations.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut_lineage
from .accelerate import plain, squared
from .penalty import penalised, solve
from .statespace import smooth_on_sums


@dataclass(frozen=True)
class Settings:
    """How a model is fitted; values outside their range raise an error.

    ``alpha`` from 0 (squares) to 1 (absolute values), ``lam`` the strength, ``chosen`` the penalised coefficients (all but the
    first, if None).  ``by`` "size" multiplies the strength by the mean number of locations of a model over the model's own
    one, "common" leaves it.  ``accelerate`` asks for squared extrapolation, which absolute values never get.  ``conditional``
    finds the coefficients on the observed likelihood."""

    lam: float = 0.0
    alpha: float = 0.0
    by: str = "common"
    chosen: tuple | None = None
    accelerate: bool = True
    conditional: bool = False
    tol: float = 1e-3
    most: int = 500

    def __post_init__(self) -> None:
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must be from 0 to 1")
        if not 0 <= self.lam < float("inf"):
            raise ValueError("lam must be a finite number, 0 or more")
        if self.by not in ("common", "size"):
            raise ValueError("by must be common or size")
        if not self.tol > 0 or self.most < 1:
            raise ValueError("tol must be above 0 and most 1 or more")

    @property
    def extrapolates(self) -> bool:
        return self.accelerate and (self.lam == 0 or self.alpha == 0)


def cell_products(panel: DataFrame, response: str, design: list[str]) -> DataFrame:
    """model, t, p: products of (response, *design, one) summed over the complete cells, upper triangle row by row.  A step
    without a complete cell has zeros."""
    names = [F.col(response).cast("double"), *[F.col(c).cast("double") for c in design], F.lit(1.0)]
    ok = F.lit(True)
    for c in [response, *design]:
        ok = ok & F.col(c).isNotNull()
    sums = [F.coalesce(F.sum(F.when(ok, a * b)), F.lit(0.0)) for i, a in enumerate(names) for b in names[i:]]
    return panel.groupBy("model", "t").agg(F.array(*sums).alias("p"))


def _square(p: list, r: int) -> np.ndarray:
    """The matrices of all steps."""
    upper = np.triu_indices(r + 2)
    out = np.zeros((len(p), r + 2, r + 2))
    out[:, upper[0], upper[1]] = np.asarray([np.asarray(x, dtype=float) for x in p])
    out[:, upper[1], upper[0]] = out[:, upper[0], upper[1]]
    return out


def start_point(s: np.ndarray) -> dict:
    """Least squares, with the variance of what is left split .6 to .2 between cells and state."""
    total = s.sum(axis=0)
    beta = np.linalg.lstsq(total[1:-1, 1:-1], total[1:-1, 0], rcond=None)[0]
    d = np.r_[1.0, -beta, 0.0]
    v = max(d @ total @ d / max(total[-1, -1], 1.0), 1e-8)
    return {"beta": beta, "v": 0.6 * v, "g": 0.3, "w": 0.2 * v, "m0": 0.0, "c0": 1.0}


def smooth(s: np.ndarray, p: dict) -> dict:
    """Smoothed states, their variances and gains, and the loglik, from the sums of residuals."""
    d, none = np.r_[1.0, -p["beta"], 0.0], np.zeros(len(s))
    return smooth_on_sums(s[:, -1, -1], s[:, :, -1] @ d, none, np.einsum("i,tij,j->t", d, s, d), none, none, {**p, "b0": 0.0, "b1": 0.0})


def observed_form(s: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """(M, v) of the observed likelihood's quadratic form in the coefficients and the state's start."""
    r = s.shape[1] - 2
    mean, var, total = np.r_[np.zeros(r + 1), -1.0], p["c0"], np.zeros((r + 2, r + 2))
    for step in s:
        n, ahead, spread_of = step[-1, -1], p["g"] * mean, p["g"] ** 2 * var + p["w"]
        u, q = np.r_[step[:-1, -1], 0.0], np.zeros((r + 2, r + 2))
        q[:-1, :-1] = step[:-1, :-1]
        spread = p["v"] + n * spread_of
        e = u - n * ahead
        total += (q - np.outer(ahead, u) - np.outer(u, ahead) + n * np.outer(ahead, ahead) - spread_of / spread * np.outer(e, e)) / p["v"]
        mean, var = ahead + spread_of / spread * e, spread_of * p["v"] / spread
    return total[1:, 1:], total[1:, 0]


def _coefficients(m: np.ndarray, v: np.ndarray, alpha: float, lam: float, w: np.ndarray) -> tuple[np.ndarray, float, float]:
    if lam <= 0:
        return np.linalg.lstsq(m, v, rcond=None)[0], float(np.linalg.matrix_rank(m)), float("nan")
    return solve(m, v, alpha, lam, w)


class Map:
    """One step of EM under a setting, as a map of packed parameters.

    The scale of the penalty is that of the step: products of the covariates over the variance, as in the regression that the
    step solves.  With it held, no step lowers the penalised loglik; ``fell`` counts those that did by more than rounding."""

    def __init__(self, s: np.ndarray, c0: float, setting: Settings, lam: float) -> None:
        self.s, self.c0, self.setting, self.lam = s, c0, setting, lam
        self.total = s.sum(axis=0)
        self.w = penalised(s.shape[1] - 2, None if setting.chosen is None else list(setting.chosen))
        self.df, self.ref, self.fell, self.steps, self._last = float("nan"), float("nan"), 0, 0, None

    def pack(self, p: dict) -> np.ndarray:
        return np.r_[p["beta"], np.log(p["v"]), p["g"], np.log(p["w"]), p["m0"]]

    def unpack(self, u: np.ndarray) -> dict:
        return {"beta": u[:-4], "v": float(np.exp(u[-4])), "g": float(u[-3]), "w": float(np.exp(u[-2])), "m0": float(u[-1]), "c0": self.c0}

    def penalty(self, beta: np.ndarray, squares: np.ndarray, ref: float) -> float:
        if self.lam <= 0:
            return 0.0
        scaled = self.w * np.sqrt(np.maximum(squares, 0.0)) * np.abs(beta)
        return self.lam * (1 - self.setting.alpha) / 2 * float(scaled @ scaled) + (self.lam * self.setting.alpha * ref * float(scaled.sum()) if self.setting.alpha > 0 else 0.0)

    def __call__(self, u: np.ndarray) -> tuple[np.ndarray, float]:
        p, a = self.unpack(u), self.setting.alpha
        f = smooth(self.s, p)
        m, c, gain = f["m"], f["c"], f["gain"]
        if self._last is not None and np.array_equal(self._last[0], u):
            _, before, squares, ref = self._last
            self.steps += 1
            self.fell += bool(f["loglik"] - self.penalty(p["beta"], squares, ref) < before - 1e-6 * max(1.0, abs(before)))
        s11, s00, s10 = (m[1:] ** 2 + c[1:]).sum(), (m[:-1] ** 2 + c[:-1]).sum(), (m[1:] * m[:-1] + gain * c[1:]).sum()
        cross, n, cells = self.total[1:-1, 1:-1], self.s[:, -1, -1], self.total[-1, -1]
        new = dict(p, g=s10 / s00)
        new["w"] = max((s11 - new["g"] * s10) / len(self.s), 1e-10)
        squares = np.diag(cross) / p["v"]
        if not self.setting.conditional:
            right = self.total[1:-1, 0] - m[1:] @ self.s[:, 1:-1, -1]
            new["beta"], self.df, self.ref = _coefficients(cross / p["v"], right / p["v"], a, self.lam, self.w)
            new["m0"] = m[0]
        d = np.r_[1.0, -new["beta"], 0.0]
        rest = d @ self.total @ d - 2 * m[1:] @ (self.s[:, :, -1] @ d) + n @ m[1:] ** 2
        new["v"] = max((rest + n @ c[1:]) / cells, 1e-10)
        held = squares
        if self.setting.conditional:
            form, right = observed_form(self.s, new)
            both, self.df, self.ref = _coefficients(form, right, a, self.lam, np.r_[self.w, 0.0])
            new["beta"], new["m0"], held = both[:-1], both[-1], np.diag(form)[:-1]
            self.df -= 1  # the state's start is counted with the state
        out = self.pack(new)
        self._last = (out, f["loglik"] - self.penalty(p["beta"], held, self.ref), held, self.ref)
        return out, f["loglik"] - self.penalty(p["beta"], squares, self.ref)


def strengths(panel: DataFrame) -> DataFrame:
    """model, locations, factor: the mean number of locations of a model over the model's own one."""
    d = panel.groupBy("model").agg(F.countDistinct("loc").alias("locations"))
    return d.join(F.broadcast(d.agg(F.avg("locations").alias("mean")))).select("model", "locations", (F.col("mean") / F.col("locations")).alias("factor"))


SCHEMA = (
    "model string, setting int, alpha double, lam double, lam_used double, locations long, cells long, beta array<double>, df double, lambda_ref double, v double, g double, w double, m0 double, c0 double, "
    "loglik double, merit double, steps int, converged boolean, fell int, t array<int>, state array<double>, failure string"
)


def fit(panel: DataFrame, response: str, design: list[str], settings: list[Settings], start: DataFrame | None = None, steps: int | None = None) -> DataFrame:
    """One row for each model and setting (its place from 0): parameters, ``df`` of the coefficients, ``loglik`` and the
    penalised one (``merit``), and the smoothed states.

    panel(model, loc, t, response, *design).  ``start``(model, beta, v, g, w, m0, c0) replaces least squares.  ``steps`` makes so
    many plain steps, whatever the setting asks; loglik and merit are then those of the point before the last one.  Cells that
    miss a value do not count, but their steps do; a model without complete cells, or whose fit breaks down, is a row
    with its ``failure`` and null parameters.  Further columns of the panel are left out."""
    if not settings or not design:
        raise ValueError("settings and design must not be empty")
    r, listed = len(design), list(settings)
    for s in listed:
        penalised(r, None if s.chosen is None else list(s.chosen))  # refuses places outside the design
    par, given = ["beta", "v", "g", "w", "m0", "c0"], start is not None
    rows = cell_products(panel, response, design).join(F.broadcast(strengths(panel)), "model")
    if given:
        rows = rows.join(F.broadcast(start.select("model", *par)), "model")
    rows = rows.withColumn("setting", F.explode(F.array(*[F.lit(i) for i in range(len(listed))])))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, setting = pdf.sort_values("t"), listed[key[1]]
        one = pdf.iloc[0]
        s = _square(list(pdf["p"]), r)
        lam = setting.lam * (float(one["factor"]) if setting.by == "size" else 1.0)
        row = {"model": key[0], "setting": key[1], "alpha": setting.alpha, "lam": setting.lam, "lam_used": lam, "locations": one["locations"], "cells": int(s[:, -1, -1].sum())}
        try:
            if not row["cells"]:
                raise ValueError("no complete cells")
            p = start_point(s) if not given else {"beta": np.asarray(one["beta"], dtype=float), **{c: float(one[c]) for c in par[1:]}}
            step = Map(s, p["c0"], setting, lam)
            u, done = step.pack(p), False
            if steps is not None:
                merit = None
                for _ in range(steps):
                    u, merit = step(u)
                calls, fell, loglik, df, ref = steps, step.fell, float("nan"), step.df, step.ref
            else:
                u, merit, calls, done = (squared if setting.extrapolates else plain)(step, u, setting.tol, setting.most)
                fell = step.fell
                step(u)  # df and reference scale of the point itself
                df, ref = step.df, step.ref
            q = step.unpack(u)
            f = smooth(s, q)
            loglik = f["loglik"]
            if not np.isfinite(loglik):
                raise FloatingPointError("loglik is not finite")
            row |= {**q, "beta": q["beta"].tolist(), "df": df, "lambda_ref": ref if np.isfinite(ref) else None, "loglik": loglik, "merit": merit, "steps": calls, "converged": done, "fell": fell}
            row |= {"t": pdf["t"].tolist(), "state": f["m"][1:].tolist(), "failure": None}
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
            row |= {"failure": f"{type(e).__name__}: {e}"}
        return pd.DataFrame({c.split()[0]: pd.Series([row.get(c.split()[0])], dtype=object) for c in SCHEMA.split(", ")})

    # named, as the few bytes of a fit would be put together into one task, though each takes seconds
    tasks = panel.sparkSession.sparkContext.defaultParallelism * 3
    return rows.repartition(tasks, "model", "setting").groupBy("model", "setting").applyInPandas(run, SCHEMA)


def completed(panel: DataFrame, fits: DataFrame, response: str, design: list[str]) -> DataFrame:
    """panel with ``fit`` and ``filled``: the response where observed, else the fit of the cell's model (one setting).  A cell
    without covariates or whose model failed has no fit."""
    states = fits.select("model", "beta", F.explode(F.arrays_zip("t", "state")).alias("o")).select("model", "o.t", "beta", F.col("o.state").alias("state"))
    mean = F.col("state")
    for i, c in enumerate(design):
        mean = mean + F.col("beta")[i] * F.col(c)
    return panel.join(states, ["model", "t"], "left").select(*panel.columns, mean.alias("fit"), F.coalesce(F.col(response), mean).alias("filled"))


def path(fits: DataFrame, others: int = 5) -> DataFrame:
    """setting, alpha, lam, models, failed, loglik, df, bic, best: the models of a setting together, with ``others`` parameters
    of each besides its coefficients; best is the least BIC among settings with the fewest failures, ties to the first."""
    ok = F.col("failure").isNull()
    each = fits.groupBy("setting", "alpha", "lam").agg(
        F.count(F.lit(1)).alias("models"), F.count(F.when(~ok, 1)).alias("failed"), F.sum("loglik").alias("loglik"), F.sum(F.when(ok, F.col("df") + others)).alias("df"), F.sum(F.when(ok, F.col("cells"))).alias("cells")
    )
    each = cut_lineage(each.withColumn("bic", -2 * F.col("loglik") + F.log("cells") * F.col("df")))
    first = each.agg(F.min(F.struct("failed", F.coalesce("bic", F.lit(float("inf"))), "setting")).alias("f")).select(F.col("f.setting").alias("chosen"))
    return each.join(F.broadcast(first)).select("setting", "alpha", "lam", "models", "failed", "loglik", "df", "bic", (F.col("setting") == F.col("chosen")).alias("best"))


def table(settings: list[Settings]) -> list[dict]:
    """The settings as rows, to be written beside their fits."""
    return [{"setting": i, **asdict(s)} for i, s in enumerate(settings)]
