"""Least squares of many groups at once from summed cross products.

Spark adds up the products of the columns by group; what is left of a group is a small symmetric matrix.  The sweep
operator turns it, column by column, into coefficients, inverse and residual sum of squares of the regression on the
columns swept so far, so nested models cost one sweep each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import distributions

#: A column whose part that the columns before leave has less than this share of its own square is spanned by them.
SPANNED = 1e-10
#: Lagged differences that the unit-root test may use, at most.
MOST_LAGS = 8
#: 5 % points of the Dickey-Fuller t statistic with a drift, for fewer than so many observations.
CRITICAL = ((25, -3.00), (50, -2.93), (100, -2.89), (250, -2.88), (500, -2.87), (float("inf"), -2.86))


def products(rows: DataFrame, by: list[str], columns: list[str], weight: str | None = None) -> DataFrame:
    """by, n, m: number of rows complete in columns, and the upper triangle of the sums of (weighted) products."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    pairs = [F.sum(w * F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]]
    return rows.dropna(subset=columns).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*pairs).alias("m"))


def full(upper, r: int) -> np.ndarray:
    """The symmetric r x r matrix of an upper triangle, row by row."""
    a = np.zeros((r, r))
    a[np.triu_indices(r)] = upper
    return a + np.triu(a, 1).T


def sweep(a: np.ndarray, k: int) -> np.ndarray:
    """a swept on column k: afterwards a[k, k] is minus the inverse, a[k, -1] the coefficient."""
    out = a - np.outer(a[:, k], a[k]) / a[k, k]
    out[:, k] = out[k] = a[k] / a[k, k]
    out[k, k] = -1 / a[k, k]
    return out


def swept(a: np.ndarray, columns) -> tuple[np.ndarray, list[int]]:
    """(a swept on the columns in turn, those that were): a column that the ones before span is passed over."""
    done, own = [], np.diag(a).copy()
    for k in columns:
        if a[k, k] > SPANNED * max(own[k], 1e-300):
            a = sweep(a, k)
            done.append(k)
    return a, done


def regressions(rows: DataFrame, by: str, response: str, columns: list[str]) -> DataFrame:
    """by, n, m (products of columns and response), kept array of the columns' places, beta array (0 where not kept)."""
    r = len(columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            out = []
            for key, n, m in zip(d[by], d["n"], d["m"]):
                a, kept = swept(full(m, r + 1), range(r))
                beta = np.zeros(r)
                beta[kept] = a[kept, -1]
                out.append((key, n, m, kept, beta))
            yield pd.DataFrame(out, columns=[by, "n", "m", "kept", "beta"])

    kind = dict(rows.dtypes)[by]
    return products(rows, [by], [*columns, response]).mapInPandas(run, f"{by} {kind}, n long, m array<double>, kept array<int>, beta array<double>")


def block_tests(rows: DataFrame, by: str, response: str, columns: list[str], blocks: dict[str, list[str]]) -> DataFrame:
    """by, block, restrictions, cells, rank, f, f_p, robust, robust_p: are all coefficients of a block 0?

    f compares the residual squares without and with the block; robust is the quadratic form of the coefficients in the
    inverse of their covariance from products weighted by squared residuals, with cells / (cells - rank) in front.  Groups
    without spare cells and blocks without a column of their own are left out."""
    names = ["_one", *columns]
    r, own = len(names), {b: [names.index(c) for c in cols] for b, cols in blocks.items()}
    data = rows.withColumn("_one", F.lit(1.0))
    fits = regressions(data, by, response, names)
    left = F.col(response) - sum((F.col("beta")[i] * F.col(c) for i, c in enumerate(names)), F.lit(0.0))
    weighed = data.dropna(subset=[response, *columns]).join(fits.select(by, "beta"), by).withColumn("_e2", left * left)
    both = fits.join(products(weighed, [by], names, "_e2").select(by, F.col("m").alias("meat")), by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            out = []
            for key, n, m, kept, beta, meat in zip(d[by], d["n"], d["m"], d["kept"], d["beta"], d["meat"]):
                kept = list(kept)
                if not n > len(kept) > 0:
                    continue
                a = full(m, r + 1)
                with_all, _ = swept(a, kept)
                free = n - len(kept)
                inverse = -with_all[np.ix_(kept, kept)]
                cover = inverse @ full(meat, r)[np.ix_(kept, kept)] @ inverse * n / free
                for block, mine in own.items():
                    at = [i for i, c in enumerate(kept) if c in mine]
                    if at:
                        without, _ = swept(a, [c for c in kept if c not in mine])
                        f = (without[-1, -1] - with_all[-1, -1]) / len(at) / (with_all[-1, -1] / free)
                        b = np.asarray(beta)[[kept[i] for i in at]]
                        robust = float(b @ np.linalg.solve(cover[np.ix_(at, at)], b))
                        out.append((key, block, len(at), n, len(kept), f, distributions.f_upper(f, len(at), free), robust, distributions.upper_gamma(len(at) / 2, robust / 2)))
            yield pd.DataFrame(out, columns=[by, "block", "restrictions", "cells", "rank", "f", "f_p", "robust", "robust_p"])

    kind = dict(rows.dtypes)[by]
    return both.mapInPandas(run, f"{by} {kind}, block string, restrictions int, cells int, rank int, f double, f_p double, robust double, robust_p double")


def unit_root(panel: DataFrame, column: str, most: int = MOST_LAGS) -> DataFrame:
    """loc, n, lags, t, reject: augmented Dickey-Fuller test with a drift on the observed values in order.

    One to ``most`` lagged differences, all on the cells that have ``most`` of them; the number with the least BIC, ties to
    fewer.  One set of products serves all: each further lag is one sweep.  Series with too few cells are left out."""
    by = W.Window.partitionBy("loc").orderBy("t")
    z = panel.where(F.col(column).isNotNull()).select("loc", "t", F.col(column).alias("z"), F.lag(column).over(by).alias("before")).withColumn("d", F.col("z") - F.col("before"))
    lags = [f"d{k}" for k in range(1, most + 1)]
    rows = z.select("loc", F.lit(1.0).alias("one"), "before", *[F.lag("d", k).over(by).alias(c) for k, c in enumerate(lags, 1)], "d")
    names = ["one", "before", *lags]
    r = len(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            out = []
            for loc, n, m in zip(d["loc"], d["n"], d["m"]):
                if n <= r:
                    continue
                a, done = swept(full(m, r + 1), [0, 1])
                best = None
                for k in range(2, r):
                    a, more = swept(a, [k])
                    done = done + more
                    bic = n * np.log(max(a[-1, -1], 1e-300) / n) + len(done) * np.log(n)
                    if 1 in done and (best is None or bic < best[0] - 1e-9):
                        best = (bic, k - 1, a[1, -1] / np.sqrt(-a[1, 1] * a[-1, -1] / (n - len(done))))
                if best is not None:
                    point = next(c for upto, c in CRITICAL if n < upto)
                    out.append((loc, n, best[1], best[2], bool(best[2] < point)))
            yield pd.DataFrame(out, columns=["loc", "n", "lags", "t", "reject"])

    return products(rows, ["loc"], [*names, "d"]).mapInPandas(run, "loc long, n long, lags int, t double, reject boolean")


def stacked_wald(estimates: DataFrame, draws: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """block, regime, q, statistic, p_chisq, p_boot, used: joint tests of each block's parameters by regime, and of all regimes
    stacked (regime "all") with the joint covariance of their draws.

    estimates(g, parameter, value), draws(b, g, parameter, value), hypotheses(block, parameter).  Draws that miss a value are
    left out; with no more of them than parameters, or a covariance without an inverse, the statistic is null.  p_boot
    compares with the draws around the estimate.  A task has the draws of one block and regime."""
    asked = F.explode(F.array(F.col("g").cast("string"), F.lit("all"))).alias("regime")
    name = F.format_string("%05d|%s", F.col("g"), F.col("parameter")).alias("name")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    rows = estimates.select(F.lit(None).cast("long").alias("b"), "g", "parameter", "value", F.lit(True).alias("fit")).unionByName(draws.where(finite).select(F.col("b").cast("long"), "g", "parameter", "value", F.lit(False).alias("fit")))
    rows = rows.join(F.broadcast(hypotheses), "parameter").select("b", "block", asked, name, "value", "fit")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        est, d = pdf[pdf["fit"]], pdf[~pdf["fit"]]
        e = est.sort_values("name").set_index("name")["value"]
        q, stat, boot, chi, used = len(e), None, None, None, 0
        if q:
            x = d.pivot(index="b", columns="name", values="value").reindex(columns=e.index).dropna().to_numpy(dtype=float)
            used = len(x)
            if used > q:
                cover = np.atleast_2d(np.cov(x, rowvar=False))
                if np.linalg.matrix_rank(cover) == q:
                    low = np.linalg.cholesky(cover)
                    stat = float((np.linalg.solve(low, e.to_numpy()) ** 2).sum())
                    around = (np.linalg.solve(low, (x - e.to_numpy()).T) ** 2).sum(axis=0)
                    boot, chi = float((1 + (around >= stat).sum()) / (1 + used)), distributions.upper_gamma(q / 2, stat / 2)
        return pd.DataFrame({"block": [key[0]], "regime": [key[1]], "q": [q], "statistic": [stat], "p_chisq": [chi], "p_boot": [boot], "used": [used]})

    return rows.groupBy("block", "regime").applyInPandas(run, "block string, regime string, q int, statistic double, p_chisq double, p_boot double, used int")
