"""Tables of partitions, criteria, draws and errors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import distributions
from ..sources.store import cut_lineage
from . import statespace
from .numbering import numbered


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """ari of the partitions a and b; null for fewer than two rows, 1 if nothing can be adjusted."""
    two = lambda c: c * (c - 1) / 2
    cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    side = lambda k: cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(k))
    both = cells.agg(F.sum(two(F.col("n"))).alias("same"), F.sum("n").alias("total")).join(side("a")).join(side("b"))
    expected, most = F.col("a") * F.col("b") / two(F.col("total")), (F.col("a") + F.col("b")) / 2
    return both.select(F.when(F.col("total") < 2, F.lit(None)).when(most == expected, F.lit(1.0)).otherwise((F.col("same") - expected) / (most - expected)).alias("ari"))


def criteria(fits: DataFrame) -> DataFrame:
    """AIC, BIC, KIC, HQ and AICc from loglik, df and the number of observed cells nobs."""
    ll, k, n = F.col("loglik"), F.col("df"), F.col("nobs")
    return fits.select("*", (-2 * ll + 2 * k).alias("aic"), (-2 * ll + F.log(n) * k).alias("bic"), (-2 * ll + 3 * k).alias("kic"), (-2 * ll + 2 * k * F.log(F.log(n))).alias("hq"), (-2 * ll + 2 * k * n / (n - k - 1)).alias("aicc"))


def select_model(grid: DataFrame, low: float, high: float, criterion: str = "bic") -> DataFrame:
    """k, phi of the two-step rule: in the band, the best k of each phi votes (ties to smaller k);
    of the k with most votes (ties smaller), the best phi of the whole grid (ties smaller).  Where
    no k above 1 is admissible, the pooled model is chosen; criteria that are no numbers are refused."""
    able = grid.where(F.col("admissible") & F.col(criterion).isNotNull() & ~F.isnan(criterion) & (F.abs(criterion) < float("inf")))
    pooled = able.where("k = 1").select(criterion)
    phis = able.where((F.col("phi") >= low) & (F.col("phi") <= high) & (F.col("k") > 1))
    n = phis.select("phi").distinct().count()
    inside = phis if n >= 2 else able.where("k > 1")
    votes = inside.groupBy("phi").agg(F.min(F.struct(F.col(criterion), F.col("k"))).alias("best"))
    base = pooled.agg(F.min(criterion).alias("base"))
    votes = votes.join(base).select(F.when(F.col("base").isNotNull() & (F.col("base") <= F.col(f"best.{criterion}")), F.lit(1)).otherwise(F.col("best.k")).alias("k"))
    chosen = votes.groupBy("k").count().agg(F.max(F.struct("count", (-F.col("k")).alias("k"))).alias("m")).select(F.coalesce(-F.col("m.k"), F.lit(1)).alias("k"))
    best = able.join(chosen, "k").groupBy("k").agg(F.min(F.struct(F.col(criterion), F.col("phi"))).alias("b"))
    return best.select("k", F.col("b.phi").alias("phi"), F.col(f"b.{criterion}").alias(criterion))


#: The criteria of ``all_criteria``.
CRITERIA = ("aic", "aicc", "gcv", "hq", "kic", "bic", "ebic")


def all_criteria(fits: DataFrame) -> DataFrame:
    """fits(k, loglik, df, nobs, d) with seven criteria.  The last adds twice the log of the number of
    partitions of d locations into k groups, log S(d, k) = d log k - log k! + log sum (-1)^j C(k, j) (1 - j / k)^d."""
    ll, p, n, k, d = (F.col(c) for c in ("loglik", "df", "nobs", "k", "d"))
    log_factorial = lambda x: F.aggregate(F.sequence(F.lit(0), x.cast("int")), F.lit(0.0), lambda a, i: a + F.when(i > 1, F.log(i.cast("double"))).otherwise(0.0))
    choose = lambda j: F.exp(log_factorial(k) - log_factorial(j) - log_factorial(k - j))
    terms = F.aggregate(F.sequence(F.lit(0), (k - 1).cast("int")), F.lit(0.0), lambda a, j: a + F.when(j % 2 == 0, 1.0).otherwise(-1.0) * choose(j) * F.pow(1 - j / k, d))
    bic = -2 * ll + F.log(n) * p
    return fits.select(
        "*", (-2 * ll + 2 * p).alias("aic"), (-2 * ll + 2 * p + 2 * p * (p + 1) / (n - p - 1)).alias("aicc"), (-2 * ll - 2 * n * F.log(1 - p / n)).alias("gcv"), (-2 * ll + 2 * F.log(F.log(n)) * p).alias("hq"),
        (-2 * ll + 3 * p).alias("kic"), bic.alias("bic"), (bic + 2 * F.when(k == 1, 0.0).otherwise(d * F.log(k.cast("double")) - log_factorial(k) + F.log(terms))).alias("ebic"),
    )


def select_each(grid: DataFrame, by: list[str], low: float, high: float, criteria=CRITERIA) -> DataFrame:
    """by, criterion, k, phi: the two-step rule of ``select_model`` for each group of rows and each criterion,
    with windows and sums by group, so any number of grids is one plan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("value")) for c in criteria])
    rows = grid.where("admissible").select(*by, "k", "phi", F.explode(pairs).alias("x")).select(*by, "x.criterion", "k", "phi", "x.value")
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    keys = [*by, "criterion"]
    inside = (F.col("phi") >= low) & (F.col("phi") <= high)
    pooled = rows.where("k = 1").groupBy(*keys).agg(F.min("value").alias("base"))
    some = rows.where("k > 1")
    few = some.groupBy(*keys).agg((F.countDistinct(F.when(inside, F.col("phi"))) < 2).alias("few"))
    best = some.join(few, keys).where(inside | F.col("few")).groupBy(*keys, "phi").agg(F.min(F.struct("value", "k")).alias("b"))
    votes = best.join(pooled, keys, "left").select(*keys, F.when(F.col("base") <= F.col("b.value"), 1).otherwise(F.col("b.k")).alias("k"))
    winner = votes.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg((-F.max(F.struct("n", (-F.col("k")).alias("k")))["k"]).alias("win"))
    every = rows.select(*keys).distinct().join(winner, keys, "left").select(*keys, F.coalesce("win", F.lit(1)).alias("win"))
    chosen = rows.join(every, keys).where(F.col("k") == F.col("win"))
    return chosen.groupBy(*keys, "k").agg(F.min(F.struct("value", "phi"))["phi"].alias("phi"))


def draw_summary(draws: DataFrame, level: float = 0.95) -> DataFrame:
    """By g and parameter: draws, mean, bias, se, t, normal, percentile and basic interval;
    draws(b, g, parameter, value, est).  Draws that are no finite number are left out; with fewer
    than two of them, or an estimate that is none, all but the number of draws is null."""
    lo, hi = (1 - level) / 2, (1 + level) / 2
    zq = F.lit(distributions.NORMAL.inv_cdf(hi))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    x = F.when(finite("value"), F.col("value"))
    s = draws.withColumn("value", x).groupBy("g", "parameter").agg(
        F.count("value").alias("n_draws"), F.first("est").alias("est"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("se"),
        F.expr(f"percentile(value, {lo!r})").alias("q_lo"), F.expr(f"percentile(value, {hi!r})").alias("q_hi"),
    )
    enough = (F.col("n_draws") >= 2) & finite("est")
    s = s.select("g", "parameter", "n_draws", "est", *[F.when(enough, F.col(c)).alias(c) for c in ("mean", "se", "q_lo", "q_hi")])
    bias = F.col("mean") - F.col("est")
    return s.select(
        "*", bias.alias("bias"), F.when(F.col("se") > 0, F.col("est") / F.col("se")).alias("t"), (F.col("est") - bias - zq * F.col("se")).alias("normal_lo"), (F.col("est") - bias + zq * F.col("se")).alias("normal_hi"),
        F.when(enough, 2 * F.col("est") - F.col("q_hi")).alias("basic_lo"), F.when(enough, 2 * F.col("est") - F.col("q_lo")).alias("basic_hi"),
    )


def stars(p: Column) -> Column:
    """Marks of a p-value."""
    return F.when(p.isNull(), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, ".").otherwise("")


def corrected_intervals(draws: DataFrame, level: float = 0.95) -> DataFrame:
    """g, parameter, t, p and the bias-corrected interval of draws(b, g, parameter, value, est).

    The share of draws below the estimate is kept off 0 and 1 by half a draw; the interval is
    read from the ordered draws at the corrected levels, with linear interpolation."""
    zq = F.lit(distributions.NORMAL.inv_cdf((1 + level) / 2))
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    s = draws.where(ok).groupBy("g", "parameter").agg(
        F.first("est").alias("est"), F.stddev_samp("value").alias("se"), F.count("value").alias("n"),
        F.avg((F.col("value") < F.col("est")).cast("double")).alias("below"), F.sort_array(F.collect_list("value")).alias("xs"),
    )
    share = F.least(F.greatest("below", 1 / (2 * F.col("n"))), 1 - 1 / (2 * F.col("n")))
    s = s.withColumn("z0", distributions.normal_quantile(share)).withColumn("t", F.col("est") / F.col("se"))
    s = s.withColumn("lo", distributions.normal_cdf(2 * F.col("z0") - zq)).withColumn("hi", distributions.normal_cdf(2 * F.col("z0") + zq))

    def at(level: Column) -> Column:
        h = (F.col("n") - 1) * level
        i = F.floor(h).cast("int")
        low, high = F.element_at("xs", i + 1), F.element_at("xs", F.least(i + 2, F.col("n").cast("int")))
        return low + (h - i) * (high - low)

    return s.select("g", "parameter", "t", (2 * (1 - distributions.normal_cdf(F.abs("t")))).alias("p"), at(F.col("lo")).alias("bc_lo"), at(F.col("hi")).alias("bc_hi"))


def wald(estimates: DataFrame, draws: DataFrame) -> DataFrame:
    """g, statistic, q, p_chisq, p_boot: joint test that a group's parameters are 0.

    Covariances come from the draws; p_boot compares with the statistics of the centred draws.
    estimates(g, parameter, value), draws(b, g, parameter, value); a group's draws are one task."""

    def test(key: tuple, est: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        wide = d.pivot(index="b", columns="parameter", values="value").dropna()
        b = est.set_index("parameter")["value"].reindex(wide.columns).to_numpy(dtype=float)
        if len(wide) <= len(b) or not len(b):
            return pd.DataFrame({"g": [key[0]], "statistic": [None], "q": [len(b)], "p_chisq": [None], "p_boot": [None]})
        inv = np.linalg.pinv(np.cov(wide.to_numpy(), rowvar=False).reshape(len(b), len(b)))
        stat = float(b @ inv @ b)
        null = wide.to_numpy() - wide.to_numpy().mean(axis=0)
        nulls = np.einsum("bi,ij,bj->b", null, inv, null)
        return pd.DataFrame({"g": [key[0]], "statistic": [stat], "q": [len(b)], "p_chisq": [distributions.upper_gamma(len(b) / 2, stat / 2)], "p_boot": [float((1 + (nulls >= stat).sum()) / (1 + len(nulls)))]})

    return estimates.groupBy("g").cogroup(draws.groupBy("g")).applyInPandas(test, "g long, statistic double, q int, p_chisq double, p_boot double")


def group_differences(draws: DataFrame) -> DataFrame:
    """For pairs of groups g < h: mean difference of a parameter's draws and its two-sided p."""
    a = draws.select("b", "parameter", "g", F.col("value").alias("u"))
    c = draws.select("b", "parameter", F.col("g").alias("h"), F.col("value").alias("v"))
    d = a.join(c, ["b", "parameter"]).where("g < h").withColumn("d", F.col("u") - F.col("v"))
    down, up = F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))
    return d.groupBy("parameter", "g", "h").agg(F.avg("d").alias("diff"), F.least(F.lit(1.0), 2 * F.least(down, up)).alias("p"), F.count(F.lit(1)).alias("n"))


def together(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """i, j, share: how often neighbours share a group over the draws; labels(b, loc, g), edges(i, j).

    Over the edges of a graph the result grows with the places; give all pairs as edges for a full matrix."""
    a, c = labels.select("b", F.col("loc").alias("i"), F.col("g").alias("gi")), labels.select("b", F.col("loc").alias("j"), F.col("g").alias("gj"))
    return edges.where("i < j").join(a, "i").join(c, ["b", "j"]).groupBy("i", "j").agg(F.avg((F.col("gi") == F.col("gj")).cast("double")).alias("share"))


def vote(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group, ties to the smaller."""
    n = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("votes"))
    return n.groupBy(by).agg(F.max(F.struct("votes", (-F.col(value)).alias("v"))).alias("m")).select(by, (-F.col("m.v")).alias(value), F.col("m.votes").alias("votes"))


def time_block(t: Column, first: Column, last: Column, folds: int) -> Column:
    """The block of a step: ``folds`` intervals of equal width from the first to the last step, closed on the right."""
    return F.greatest(F.lit(1), F.ceil((t - first) * folds / F.greatest(last - first, F.lit(1)))).cast("int")


def dealt(rows: DataFrame, key: Column, order: list[str], folds: int, name: str) -> DataFrame:
    """rows with a fold 1 .. folds, in turn in an order fixed by a hash of the key, so folds differ in size by one at most."""
    return numbered(rows.withColumn("_hash", key), ["_hash", *order]).withColumn(name, (F.col("number") % folds + 1).cast("int")).drop("_hash", "number")


def blocked_folds(cells: DataFrame, folds: int) -> DataFrame:
    """cells with time_fold, loc_fold and cell_fold: blocks of steps, and locations and cells dealt in turn."""
    ends = cells.agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    locs = dealt(cells.select("loc").distinct(), (F.col("loc") * 7919) % 1000003, ["loc"], folds, "loc_fold")
    each = dealt(cells, (F.col("loc") * 7919 + F.col("t") * 104729) % 1000003, ["loc", "t"], folds, "cell_fold")
    timed = each.join(F.broadcast(ends)).withColumn("time_fold", time_block(F.col("t"), F.col("_first"), F.col("_last"), folds)).drop("_first", "_last")
    return timed.join(locs, "loc")


def scheme_folds(cells: DataFrame, folds: int) -> DataFrame:
    """cells for each scheme and fold, with blank (not seen by the fit) and score (counts in the errors):
    LKLO leaves locations out, LKTO blocks of steps, LKLHTO both but scores only their meeting, random cells."""
    f = blocked_folds(cells, folds)
    j = F.explode(F.sequence(F.lit(1), F.lit(folds)))
    f = f.withColumn("fold", j)
    here = {c: F.col(f"{c}_fold") == F.col("fold") for c in ("loc", "time", "cell")}
    rules = {"LKLO": (here["loc"], here["loc"]), "LKTO": (here["time"], here["time"]), "LKLHTO": (here["loc"] | here["time"], here["loc"] & here["time"]), "random": (here["cell"], here["cell"])}
    s = F.explode(F.array(*[F.struct(F.lit(k).alias("scheme"), b.alias("blank"), x.alias("score")) for k, (b, x) in rules.items()])).alias("s")
    return f.select("*", s).select(*cells.columns, "fold", "s.scheme", "s.blank", "s.score")


def cross_validated(panel: DataFrame, folds: int, tol: float = 1e-3, most: int = 500) -> DataFrame:
    """scheme, n, rmse, mae, folds_ok, place: the model of each scheme and fold is fitted to the cells that are
    not blank, all in the same jobs, and predicts those that score: coefficients and smoothed state."""
    f = cut_lineage(scheme_folds(panel.select("loc", "t", "z", "x"), folds).withColumn("model", F.concat_ws("#", "scheme", "fold")))
    seen = f.select("model", "loc", "t", "x", F.when(~F.col("blank"), F.col("z")).alias("z"))
    fits = cut_lineage(statespace.fit_on_sums(seen, statespace.start_values(seen), tol, most, accelerate=True))
    states = statespace.smoothed(statespace.filtered(statespace.step_sums(seen, fits)))
    scored = statespace.signal(f.where("score AND z IS NOT NULL").select("model", "scheme", "fold", "loc", "t", "z", "x"), fits, states)
    e = F.col("z") - F.col("fit")
    ok = scored.where(F.col("fit").isNotNull() & ~F.isnan("fit"))
    s = ok.groupBy("scheme").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.countDistinct("fold").alias("folds_ok"))
    return s.withColumn("place", F.rank().over(W.Window.orderBy("rmse")))


def fold_errors(cells: DataFrame, by: list[str]) -> DataFrame:
    """n, rmse, mae of z against fit by the given keys, and the rank of rmse (ties get the smaller)."""
    e = F.col("z") - F.col("fit")
    s = cells.where("z IS NOT NULL AND fit IS NOT NULL").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return s.withColumn("place", F.rank().over(W.Window.orderBy(F.round("rmse", 9))))


def bins(x: Column, edges: list[float]) -> Column:
    """Number of the right-closed bin (edges[i], edges[i + 1]] that holds x, from 1."""
    out = F.when(x <= edges[0], F.lit(None))
    for i, e in enumerate(edges[1:], 1):
        out = out.when(x <= e, F.lit(i))
    return out.otherwise(F.lit(None))
