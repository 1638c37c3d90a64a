"""State-space steps as Spark jobs.

With one latent state that all locations share and independent errors, a time step enters
the filter through three sums only: the number of observed locations, the sum and the sum
of squares of their residuals.  They are aggregated in parallel over cells; what remains
is a fold over the ordered time steps of each model, an expression without Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut_lineage
from .accelerate import plain, squared

#: Parameters of a model, as columns of a table models(model, ...).
PARAMETERS = ("b0", "b1", "v", "g", "w", "m0", "c0")
LOG_2PI = 1.8378770664093453
#: What a path keeps of a step.
ROW = "struct<t:int,m:double,c:double>"


def step_sums(panel: DataFrame, models: DataFrame) -> DataFrame:
    """model, t, n, s, q and the parameters: residuals z - b0 - b1 x of observed cells, summed."""
    r = F.col("z") - F.col("b0") - F.col("b1") * F.col("x")
    joined = panel.join(F.broadcast(models.select("model", *PARAMETERS)), "model")
    return joined.groupBy("model", "t", *PARAMETERS).agg(F.count("z").alias("n"), F.coalesce(F.sum(r), F.lit(0.0)).alias("s"), F.coalesce(F.sum(r * r), F.lit(0.0)).alias("q"))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def folded(xs: Column, start: Column, step, row, kept: str, block: int = 32) -> Column:
    """struct<state, path> of a fold over an array: ``step(state, x)`` is the next state and ``row(state, x)``, of the type
    ``kept``, what the path keeps of it.  Rows are put together by blocks and blocks into the path, so that a
    row does not copy all that came before it."""
    none = F.array().cast(f"array<{kept}>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(xs) - 1, F.lit(0)) / block).cast("int")), lambda i: F.slice(xs, i * block + 1, block))
    one = lambda a, x: _let(step(a["state"], x), lambda new: F.struct(new.alias("state"), F.concat(a["path"], F.array(row(new, x))).alias("path")))
    whole = lambda a, xs: _let(F.aggregate(xs, F.struct(a["state"].alias("state"), none.alias("path")), one), lambda r: F.struct(r["state"].alias("state"), F.concat(a["path"], r["path"]).alias("path")))
    return F.aggregate(blocks, F.struct(start.alias("state"), none.alias("path")), whole)


def _filter_step(a: Column, x: Column, p) -> Column:
    m, c = p("g") * a["m"], p("g") * p("g") * a["c"] + p("w")
    n, v = x["n"].cast("double"), p("v")
    spread = v + n * c
    e = x["s"] - n * m
    ee = x["q"] - 2 * m * x["s"] + n * m * m
    seen = x["n"] > 0
    ll = -0.5 * (n * LOG_2PI + (n - 1) * F.log(v) + F.log(spread) + (ee - c * e * e / spread) / v)
    return F.struct(F.when(seen, m + c * e / spread).otherwise(m).alias("m"), F.when(seen, c * v / spread).otherwise(c).alias("c"), (a["ll"] + F.when(seen, ll).otherwise(0.0)).alias("ll"))


def filtered(sums: DataFrame) -> DataFrame:
    """model, loglik, path array<t, m, c>: forward means, variances and the log-likelihood."""
    rows = sums.groupBy("model", *PARAMETERS).agg(F.sort_array(F.collect_list(F.struct("t", "n", "s", "q"))).alias("xs"))
    start = F.struct(F.col("m0").alias("m"), F.col("c0").alias("c"), F.lit(0.0).alias("ll"))
    keep = lambda a, x: F.struct(x["t"].cast("int").alias("t"), a["m"].alias("m"), a["c"].alias("c"))
    out = rows.withColumn("f", folded(F.col("xs"), start, lambda a, x: _filter_step(a, x, F.col), keep, ROW))
    return out.select("model", *PARAMETERS, F.col("f.state.ll").alias("loglik"), F.col("f.path").alias("path"))


def smoothed(filtered_rows: DataFrame) -> DataFrame:
    """model, t, m, c: means and variances given all time steps, by a fold from the end."""
    last = F.element_at("path", -1)

    def step(a: Column, x: Column) -> Column:
        g, ahead = F.col("g"), F.col("g") * F.col("g") * x["c"] + F.col("w")
        b = x["c"] * g / ahead
        return F.struct((x["m"] + b * (a["m"] - g * x["m"])).alias("m"), (x["c"] + b * b * (a["c"] - ahead)).alias("c"))

    keep = lambda a, x: F.struct(x["t"].alias("t"), a["m"].alias("m"), a["c"].alias("c"))
    out = F.concat(F.array(last), folded(_before_last(), F.struct(last["m"].alias("m"), last["c"].alias("c")), step, keep, ROW)["path"])
    return filtered_rows.select("model", F.explode(out).alias("o")).select("model", "o.t", "o.m", "o.c")


def _before_last() -> Column:
    """Rows of the path before its last, latest first."""
    return F.reverse(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))))


def signal(panel: DataFrame, models: DataFrame, states: DataFrame) -> DataFrame:
    """panel with fit = b0 + b1 x + state, and filled: z where observed, else fit."""
    joined = panel.join(F.broadcast(models.select("model", "b0", "b1")), "model").join(states.select("model", "t", "m"), ["model", "t"])
    fit = F.col("b0") + F.col("b1") * F.col("x") + F.col("m")
    return joined.select(*panel.columns, fit.alias("fit"), F.coalesce("z", fit).alias("filled"))


def start_values(panel: DataFrame) -> DataFrame:
    """models(model, ...): least squares of z on x, and the residual variance split .6 to .4."""
    seen = panel.where("z IS NOT NULL AND x IS NOT NULL")
    s = seen.groupBy("model").agg(F.regr_slope("z", "x").alias("b1"), F.regr_intercept("z", "x").alias("b0"), F.regr_syy("z", "x").alias("syy"), F.regr_sxy("z", "x").alias("sxy"), F.count(F.lit(1)).alias("n"))
    v = F.greatest((F.col("syy") - F.coalesce(F.col("b1"), F.lit(0.0)) * F.col("sxy")) / F.col("n"), F.lit(1e-8))
    return s.select("model", F.coalesce("b0", F.lit(0.0)).alias("b0"), F.coalesce("b1", F.lit(0.0)).alias("b1"), (0.6 * v).alias("v"), F.lit(0.3).alias("g"), (0.2 * v).alias("w"), F.lit(0.0).alias("m0"), F.lit(1.0).alias("c0"))


def em_step(panel: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new models, logliks of the given ones): one EM iteration of all models as joins and sums.

    The lag-one covariance of neighbouring states is b * c of the later state, with b the
    smoother's gain, so smoothed and filtered variances are enough."""
    f = filtered(step_sums(panel, models))
    s = smoothed(f)
    paths = f.select("model", "g", "w", "m0", "c0", F.explode("path").alias("p")).select("model", "g", "w", "m0", "c0", "p.t", F.col("p.c").alias("fc"))
    both = s.join(paths, ["model", "t"])
    # the state before the first time step
    first = both.groupBy("model").agg(F.min_by(F.struct("m", "c", "g", "w", "m0", "c0"), "t").alias("o"), F.min("t").alias("t")).select("model", "t", "o.*")
    b0 = F.col("c0") * F.col("g") / (F.col("g") * F.col("g") * F.col("c0") + F.col("w"))
    ahead = F.col("g") * F.col("g") * F.col("c0") + F.col("w")
    start = first.select("model", (F.col("t") - 1).alias("t"), (F.col("m0") + b0 * (F.col("m") - F.col("g") * F.col("m0"))).alias("m"), (F.col("c0") + b0 * b0 * (F.col("c") - ahead)).alias("c"), "g", "w", F.col("c0").alias("fc"))
    chain = both.select("model", "t", "m", "c", "g", "w", "fc").unionByName(start)
    nxt = chain.select("model", (F.col("t") - 1).alias("t"), F.col("m").alias("m1"), F.col("c").alias("c1"))
    gain = F.col("fc") * F.col("g") / (F.col("g") * F.col("g") * F.col("fc") + F.col("w"))
    pairs = chain.join(nxt, ["model", "t"])
    latent = pairs.groupBy("model").agg(F.sum(F.col("m1") * F.col("m1") + F.col("c1")).alias("s11"), F.sum(F.col("m1") * F.col("m") + gain * F.col("c1")).alias("s10"), F.sum(F.col("m") * F.col("m") + F.col("c")).alias("s00"), F.count(F.lit(1)).alias("n"))
    cells = panel.where("z IS NOT NULL AND x IS NOT NULL").join(s, ["model", "t"]).withColumn("y", F.col("z") - F.col("m"))
    beta = cells.groupBy("model").agg(F.regr_slope("y", "x").alias("b1"), F.regr_intercept("y", "x").alias("b0"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.avg("c").alias("spread"), F.count(F.lit(1)).alias("cells"))
    v = (F.col("syy") - F.coalesce(F.col("b1"), F.lit(0.0)) * F.col("sxy")) / F.col("cells") + F.col("spread")
    g = F.col("s10") / F.col("s00")
    new = latent.join(beta, "model").join(start.select("model", F.col("m").alias("m0")), "model").join(models.select("model", "c0"), "model")
    new = new.select("model", F.coalesce("b0", F.lit(0.0)).alias("b0"), F.coalesce("b1", F.lit(0.0)).alias("b1"), F.greatest(v, F.lit(1e-10)).alias("v"), g.alias("g"), F.greatest((F.col("s11") - g * F.col("s10")) / F.col("n"), F.lit(1e-10)).alias("w"), "m0", "c0")
    return new, f.select("model", "loglik")


def fit(panel: DataFrame, models: DataFrame, tol: float = 1e-3, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(models, trace(model, step, loglik)): EM until the largest change of any model's loglik is
    below tol.  Each iteration is written to the checkpoint folder, so plans stay short."""
    trace, before = None, None
    models = cut_lineage(models)
    for k in range(most):
        new, ll = em_step(panel, models)
        new, ll = cut_lineage(new), cut_lineage(ll.withColumn("step", F.lit(k)))
        trace = ll if trace is None else trace.unionByName(ll)
        if before is not None:
            change = ll.alias("a").join(before.alias("b"), "model").agg(F.max(F.abs(F.col("a.loglik") - F.col("b.loglik")))).first()[0]
            if change is not None and change < tol:
                return new, trace
        models, before = new, ll
    return models, trace


def cell_sums(panel: DataFrame) -> DataFrame:
    """model, t and the sums over observed cells that EM needs, whatever the parameters."""
    ok = F.col("z").isNotNull() & F.col("x").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0.0))
    z, x = F.col("z"), F.col("x")
    return panel.groupBy("model", "t").agg(F.count(F.when(ok, 1)).cast("double").alias("n"), total(z).alias("sz"), total(x).alias("sx"), total(z * z).alias("szz"), total(z * x).alias("szx"), total(x * x).alias("sxx"))


def smooth_on_sums(n, sz, sx, szz, szx, sxx, p: dict) -> dict:
    """Smoothed means m and variances c of the states from the one before the first step on, the smoother's
    gain and the loglik, of one model from the sums of its cells by step."""
    b0, b1, v, g, w = (p[c] for c in ("b0", "b1", "v", "g", "w"))
    s = sz - b0 * n - b1 * sx
    q = szz - 2 * b0 * sz - 2 * b1 * szx + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx
    m, c, ahead, ll = [p["m0"]], [p["c0"]], [0.0], 0.0
    for t in range(len(n)):
        a, r = g * m[t], g * g * c[t] + w
        ahead.append(r)
        if n[t] > 0:
            spread, e = v + n[t] * r, s[t] - n[t] * a
            ee = q[t] - 2 * a * s[t] + n[t] * a * a
            ll -= 0.5 * (n[t] * LOG_2PI + (n[t] - 1) * np.log(v) + np.log(spread) + (ee - r * e * e / spread) / v)
            a, r = a + r * e / spread, r * v / spread
        m.append(a)
        c.append(r)
    m, c, ahead = np.array(m), np.array(c), np.array(ahead)
    gain = c[:-1] * g / ahead[1:]
    ms, cs = m.copy(), c.copy()
    for t in range(len(n) - 1, -1, -1):
        ms[t], cs[t] = m[t] + gain[t] * (ms[t + 1] - g * m[t]), c[t] + gain[t] ** 2 * (cs[t + 1] - ahead[t + 1])
    return {"m": ms, "c": cs, "gain": gain, "loglik": float(ll)}


def augmented_on_sums(n, sz, sx, szz, szx, sxx, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """(M, v): minus twice the observed loglik is, but for a constant, a quadratic form in (b0, b1, m0) that is least where
    M (b0, b1, m0) = v.  The filter is linear in its data, so it runs on four columns at once, the responses, a one, the
    covariate and the effect of the state's start, and sums the products of their innovations."""
    mean, var, total = np.array([0.0, 0.0, 0.0, -1.0]), p["c0"], np.zeros((4, 4))
    for t in range(len(n)):
        a, r = p["g"] * mean, p["g"] ** 2 * var + p["w"]
        spread = p["v"] + n[t] * r
        s = np.array([sz[t], n[t], sx[t], 0.0])
        q = np.array([[szz[t], sz[t], szx[t], 0], [sz[t], n[t], sx[t], 0], [szx[t], sx[t], sxx[t], 0], [0, 0, 0, 0]])
        e = s - n[t] * a
        total += (q - np.outer(a, s) - np.outer(s, a) + n[t] * np.outer(a, a) - r / spread * np.outer(e, e)) / p["v"]
        mean, var = a + r / spread * e, r * p["v"] / spread
    return total[1:, 1:], total[1:, 0]


def _em_on_sums(n, sz, sx, szz, szx, sxx, p: dict, tol: float, most: int, accelerate: bool, conditional: bool = False) -> tuple[dict, float, int, bool]:
    """em_step until the loglik changes by less than tol: (parameters, their loglik, steps, converged).

    ``conditional``: variances and the state's coefficient by the EM step with the coefficients given; then the coefficients
    and the state's start by the observed loglik itself.  Its steps never lower the loglik either, and need far fewer in the end."""
    steps, logs = len(n), ("v", "w")
    names = ("b0", "b1", "v", "g", "w", "m0")
    pack = lambda q: np.array([np.log(q[c]) if c in logs else q[c] for c in names])
    unpack = lambda u: {c: float(np.exp(x)) if c in logs else float(x) for c, x in zip(names, u)} | {"c0": p["c0"]}

    def step(u: np.ndarray) -> tuple[np.ndarray, float]:
        f = smooth_on_sums(n, sz, sx, szz, szx, sxx, unpack(u))
        ms, cs, gain, ll = f["m"], f["c"], f["gain"], f["loglik"]
        s11, s00, s10 = (ms[1:] ** 2 + cs[1:]).sum(), (ms[:-1] ** 2 + cs[:-1]).sum(), (ms[1:] * ms[:-1] + gain * cs[1:]).sum()
        state, cells = ms[1:], n.sum()
        y, yy, yx = (sz - n * state).sum(), (szz - 2 * state * sz + n * state**2).sum(), (szx - state * sx).sum()
        syy, sxy, spread_x = yy - y * y / cells, yx - y * sx.sum() / cells, sxx.sum() - sx.sum() ** 2 / cells
        fits = spread_x > 1e-12 * sxx.sum()
        slope = sxy / spread_x if fits else 0.0
        level = (y - slope * sx.sum()) / cells if fits else 0.0  # 0, as in em_step, where x does not vary
        new_g = s10 / s00
        if conditional:
            q = unpack(u)
            b0, b1 = q["b0"], q["b1"]
            rest = (szz + b0**2 * n + b1**2 * sxx - 2 * b0 * sz - 2 * b1 * szx + 2 * b0 * b1 * sx - 2 * state * (sz - b0 * n - b1 * sx) + n * state**2).sum()
            q |= {"v": max((rest + (n * cs[1:]).sum()) / cells, 1e-10), "g": new_g, "w": max((s11 - new_g * s10) / steps, 1e-10)}
            form, right = augmented_on_sums(n, sz, sx, szz, szx, sxx, q)
            b0, b1, m0 = np.linalg.lstsq(form, right, rcond=None)[0]
            return pack(q | {"b0": b0, "b1": b1, "m0": m0}), ll
        return pack({"b0": level, "b1": slope, "v": max((syy - slope * sxy) / cells + (n * cs[1:]).sum() / cells, 1e-10), "g": new_g, "w": max((s11 - new_g * s10) / steps, 1e-10), "m0": ms[0]}), ll

    u, ll, calls, done = (squared if accelerate else plain)(step, pack(p), tol, most)
    return unpack(u), ll, calls, done


def fit_on_sums(panel: DataFrame, models: DataFrame, tol: float = 1e-3, most: int = 500, accelerate: bool = False, conditional: bool = False) -> DataFrame:
    """models(model, ..., loglik, steps, converged): EM of each model until its loglik changes by
    less than tol.  Cells are summed once, by model and time step; a model's task has one row
    per time step, however many locations there are."""
    spec = ("n", "sz", "sx", "szz", "szx", "sxx")
    kept = ", ".join(f"{c} double" for c in PARAMETERS)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        start = {c: float(pdf[c].iloc[0]) for c in PARAMETERS}
        p, ll, steps, done = _em_on_sums(*(pdf[c].to_numpy() for c in spec), start, tol, most, accelerate, conditional)
        return pd.DataFrame([{"model": key[0], **p, "loglik": ll, "steps": steps, "converged": done}])

    joined = cell_sums(panel).join(F.broadcast(models.select("model", *PARAMETERS)), "model")
    return joined.groupBy("model").applyInPandas(run, f"model string, {kept}, loglik double, steps int, converged boolean")


#: Columns of the augmented filter, and the pairs of them whose products are summed.
AUGMENTED = ("z", "one", "x", "m0")
PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


def augmented(panel: DataFrame, models: DataFrame) -> DataFrame:
    """model and the sums q_<a>_<b> of the products of the innovations of the columns AUGMENTED: the quadratic form of
    the observed loglik in (b0, b1, m0), as one fold over each model's time steps."""
    rows = cell_sums(panel).groupBy("model").agg(F.sort_array(F.collect_list(F.struct("t", "n", "sz", "sx", "szz", "szx", "sxx"))).alias("xs")).join(F.broadcast(models.select("model", "v", "g", "w", "c0")), "model")
    zero = F.lit(0.0)
    start = F.struct(F.array(zero, zero, zero, F.lit(-1.0)).alias("mean"), F.col("c0").alias("var"), F.array(*[zero] * len(PAIRS)).alias("q"))

    def step(acc: Column, x: Column) -> Column:
        n, v = x["n"], F.col("v")
        s = (x["sz"], n, x["sx"], zero)
        q = {(0, 0): x["szz"], (0, 1): x["sz"], (0, 2): x["szx"], (1, 1): n, (1, 2): x["sx"], (2, 2): x["sxx"]}
        ahead = F.struct(F.transform(acc["mean"], lambda m: F.col("g") * m).alias("a"), (F.col("g") * F.col("g") * acc["var"] + F.col("w")).alias("r"))

        def second(y: Column) -> Column:
            e = F.array(*[s[i] - n * y["a"][i] for i in range(4)])
            return _let(F.struct(y["a"].alias("a"), y["r"].alias("r"), e.alias("e"), (v + n * y["r"]).alias("spread")), third)

        def third(y: Column) -> Column:
            a, e, gain = y["a"], y["e"], y["r"] / y["spread"]
            add = [(q.get((i, j), zero) - a[i] * s[j] - a[j] * s[i] + n * a[i] * a[j] - gain * e[i] * e[j]) / v for i, j in PAIRS]
            return F.struct(F.array(*[a[i] + gain * e[i] for i in range(4)]).alias("mean"), (y["r"] * v / y["spread"]).alias("var"), F.array(*[acc["q"][k] + x_ for k, x_ in enumerate(add)]).alias("q"))

        return _let(ahead, second)

    out = rows.withColumn("f", F.aggregate("xs", start, step))
    return out.select("model", *[F.col("f.q")[k].alias(f"q_{AUGMENTED[i]}_{AUGMENTED[j]}") for k, (i, j) in enumerate(PAIRS)])


#: Moments of two states, and what a path keeps of them.
TWO = ("m1", "m2", "c11", "c12", "c22")
TWO_ROW = "struct<t:int," + ",".join(f"{c}:double" for c in TWO) + ">"


def _two_row(a: Column, x: Column) -> Column:
    return F.struct(x["t"].cast("int").alias("t"), *[a[c].alias(c) for c in TWO])


def two_states(panel: DataFrame, models: DataFrame) -> DataFrame:
    """model, g, w, g2, w2, loglik, path array<t, m1, m2, c11, c12, c22>: filter of a level and a coefficient of x that both change in time.

    models(model, b0, b1, v, g, w, g2, w2, m0, c0): the states' coefficients g and g2, their variances w and w2, the level's
    start m0 and both starts' variance c0.  A step enters by sums over its cells; the fold's state is a
    vector and a matrix."""
    par = ("b0", "b1", "v", "g", "w", "g2", "w2", "m0", "c0")
    rows = cell_sums(panel).groupBy("model").agg(F.sort_array(F.collect_list(F.struct("t", "n", "sz", "sx", "szz", "szx", "sxx"))).alias("xs")).join(F.broadcast(models.select("model", *par)), "model")
    b0, b1, v, g, h = (F.col(c) for c in ("b0", "b1", "v", "g", "g2"))
    zero = F.lit(0.0)
    start = F.struct(F.col("m0").alias("m1"), zero.alias("m2"), F.col("c0").alias("c11"), zero.alias("c12"), F.col("c0").alias("c22"), zero.alias("ll"))

    def step(acc: Column, x: Column) -> Column:
        n, sx, sxx = x["n"], x["sx"], x["sxx"]
        one = F.struct(
            (g * acc["m1"]).alias("a1"), (h * acc["m2"]).alias("a2"), (g * g * acc["c11"] + F.col("w")).alias("r11"), (g * h * acc["c12"]).alias("r12"), (h * h * acc["c22"] + F.col("w2")).alias("r22"),
            (x["sz"] - b0 * n - b1 * sx).alias("s"), (x["szx"] - b0 * sx - b1 * sxx).alias("xs"),
            (x["szz"] - 2 * b0 * x["sz"] - 2 * b1 * x["szx"] + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx).alias("q"),
        )

        def second(y: Column) -> Column:
            a1, a2 = y["a1"], y["a2"]
            d = {"d11": 1 + (y["r11"] * n + y["r12"] * sx) / v, "d12": (y["r11"] * sx + y["r12"] * sxx) / v, "d21": (y["r12"] * n + y["r22"] * sx) / v, "d22": 1 + (y["r12"] * sx + y["r22"] * sxx) / v}
            e = {"u1": y["s"] - n * a1 - sx * a2, "u2": y["xs"] - sx * a1 - sxx * a2, "ee": y["q"] - 2 * (a1 * y["s"] + a2 * y["xs"]) + a1 * a1 * n + 2 * a1 * a2 * sx + a2 * a2 * sxx}
            return _let(F.struct(y.alias("y"), *[c.alias(k) for k, c in (d | e).items()]), third)

        def third(k: Column) -> Column:
            y, det = k["y"], k["d11"] * k["d22"] - k["d12"] * k["d21"]
            c = {"c11": (k["d22"] * y["r11"] - k["d12"] * y["r12"]) / det, "c12": (k["d22"] * y["r12"] - k["d12"] * y["r22"]) / det, "c22": (k["d11"] * y["r22"] - k["d21"] * y["r12"]) / det}
            return _let(F.struct(k.alias("k"), det.alias("det"), *[x_.alias(i) for i, x_ in c.items()]), last)

        def last(o: Column) -> Column:
            k, y, u1, u2 = o["k"], o["k"]["y"], o["k"]["u1"], o["k"]["u2"]
            new = {"m1": y["a1"] + (o["c11"] * u1 + o["c12"] * u2) / v, "m2": y["a2"] + (o["c12"] * u1 + o["c22"] * u2) / v, "c11": o["c11"], "c12": o["c12"], "c22": o["c22"]}
            ll = acc["ll"] - 0.5 * (n * LOG_2PI + n * F.log(v) + F.log(o["det"]) + (k["ee"] - (u1 * u1 * o["c11"] + 2 * u1 * u2 * o["c12"] + u2 * u2 * o["c22"]) / v) / v)
            return F.struct(*[new[c].alias(c) for c in TWO], ll.alias("ll"))

        return _let(one, second)

    out = rows.withColumn("f", folded(F.col("xs"), start, step, _two_row, TWO_ROW))
    return out.select("model", "g", "w", "g2", "w2", F.col("f.state.ll").alias("loglik"), F.col("f.path").alias("path"))


def two_smoothed(filtered_rows: DataFrame) -> DataFrame:
    """model, t, m1, m2, c11, c12, c22 given all time steps, from the rows of ``two_states``, by a fold from the end.

    Every step multiplies the later step's surprise by the gain C G' R^-1, where R is the covariance of the next
    state before it was observed; it is written out for two states with a diagonal G."""
    last, g, h = F.element_at("path", -1), F.col("g"), F.col("g2")

    def step(a: Column, x: Column) -> Column:
        ahead = F.struct((g * g * x["c11"] + F.col("w")).alias("r11"), (g * h * x["c12"]).alias("r12"), (h * h * x["c22"] + F.col("w2")).alias("r22"))

        def second(r: Column) -> Column:
            det = r["r11"] * r["r22"] - r["r12"] * r["r12"]
            gain = [(g * x[i] * r["r22"] - h * x[j] * r["r12"]) / det for i, j in (("c11", "c12"), ("c12", "c22"))], [(h * x[j] * r["r11"] - g * x[i] * r["r12"]) / det for i, j in (("c11", "c12"), ("c12", "c22"))]
            off = {"e1": a["m1"] - g * x["m1"], "e2": a["m2"] - h * x["m2"], "d11": a["c11"] - r["r11"], "d12": a["c12"] - r["r12"], "d22": a["c22"] - r["r22"]}
            return _let(F.struct(F.array(*gain[0]).alias("one"), F.array(*gain[1]).alias("two"), *[c.alias(k) for k, c in off.items()]), last_part)

        def last_part(o: Column) -> Column:
            part = lambda i, j: o["one"][i] * o["one"][j] * o["d11"] + (o["one"][i] * o["two"][j] + o["two"][i] * o["one"][j]) * o["d12"] + o["two"][i] * o["two"][j] * o["d22"]
            new = [x[f"m{i + 1}"] + o["one"][i] * o["e1"] + o["two"][i] * o["e2"] for i in (0, 1)] + [x["c11"] + part(0, 0), x["c12"] + part(0, 1), x["c22"] + part(1, 1)]
            return F.struct(*[c.alias(k) for k, c in zip(TWO, new)])

        return _let(ahead, second)

    out = F.concat(F.array(last), folded(_before_last(), F.struct(*[last[c].alias(c) for c in TWO]), step, _two_row, TWO_ROW)["path"])
    return filtered_rows.select("model", F.explode(out).alias("o")).select("model", "o.t", *[f"o.{c}" for c in TWO])
