"""Designs of lagged panels and summaries of their tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import distributions
from .panel import pulses


def unstacked(rows: DataFrame, n: int) -> DataFrame:
    """loc, t for a matrix stacked by location, with n rows of each: row counts from 0."""
    return rows.select(F.floor(F.col("row") / n).cast("long").alias("loc"), (F.col("row") % n).cast("int").alias("t"), *[c for c in rows.columns if c != "row"])


def case_frame(panel: DataFrame, pairs: DataFrame, first: int) -> DataFrame:
    """loc, other, t, y, x, nr, presample: a row for each location with a partner and each time step,
    with both series; the steps before ``first`` are presample."""
    mine = pairs.join(panel.select("loc", "t", F.col("z").alias("y")), "loc")
    both = mine.join(panel.select(F.col("loc").alias("other"), "t", F.col("z").alias("x")), ["other", "t"])
    nr = F.row_number().over(W.Window.partitionBy("loc").orderBy("t"))
    return both.select("loc", "other", "t", "y", "x", nr.alias("nr"), (F.col("t") < first).alias("presample"))


def lag_design(cases: DataFrame, lags: int) -> DataFrame:
    """loc, t, y, own_1 .. own_<lags>, nb_1 .. nb_<lags> of the steps after the presample."""
    by = W.Window.partitionBy("loc").orderBy("t")
    cols = [F.lag(c, k).over(by).alias(f"{name}_{k}") for name, c in (("own", "y"), ("nb", "x")) for k in range(1, lags + 1)]
    return cases.select("loc", "t", "y", "presample", *cols).where("NOT presample").drop("presample")


def pulse_columns(times: DataFrame, events: DataFrame, names: list[str]) -> DataFrame:
    """t and pulse_<name>, pulse_<name>_next of every event: 1 in the event's step and in the next one, else 0.

    times(t, day), events(event, day); columns that are 0 throughout are left out."""
    marks = pulses(times, events)
    on = lambda e, c: F.coalesce(F.max(F.when(F.col("event") == e, F.col(c))), F.lit(0)).cast("double")
    wide = times.select("t").join(F.broadcast(marks), "t", "left").groupBy("t").agg(*[on(e, c).alias(f"pulse_{e}{end}") for e in names for c, end in (("first", ""), ("second", "_next"))])
    used = wide.agg(*[F.max(c).alias(c) for c in wide.columns if c != "t"]).first().asDict()
    return wide.select("t", *[c for c, most in used.items() if most])


def block_design(cases: DataFrame, by: list[str], sources: dict[str, str], lags: dict[str, list[int]], keep: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """(design, columns of each block): lags of several series along t within ``by``, from the first step after the presample on
    that has them all.

    ``sources`` names the series of a block, ``lags`` its lags (none: the block is left out), ``keep`` further columns."""
    order = W.Window.partitionBy(*by).orderBy("t")
    blocks = {b: [f"{b}_l{k}" for k in ks] for b, ks in lags.items() if ks}
    cols = [F.lag(sources[b], k).over(order).alias(f"{b}_l{k}") for b in blocks for k in lags[b]]
    most = max((k for ks in lags.values() for k in ks), default=0)
    rows = cases.select(*by, "t", "presample", *keep, *cols, F.row_number().over(order).alias("nr"))
    return rows.where((F.col("nr") > most) & ~F.col("presample")).drop("presample", "nr"), blocks


def mean_wald(tests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, block, groups, restrictions, share_f, share_robust, z_f, z_robust and their two-sided p: causality in a panel.

    Without causality, restrictions times f and the robust form have mean ``restrictions`` and twice that as variance, so the mean over
    groups is about normal; the shares tell how many groups reject at 5 %."""
    forms = {"f": F.col("restrictions") * F.col("f"), "robust": F.col("robust")}
    means = tests.groupBy(*(by or []), "block").agg(
        F.count(F.lit(1)).alias("groups"), F.max("restrictions").alias("restrictions"),
        *[F.avg((F.col(f"{k}_p") < 0.05).cast("double")).alias(f"share_{k}") for k in forms], *[F.avg(w).alias(f"z_{k}") for k, w in forms.items()],
    )
    scaled = means.withColumns({f"z_{k}": (F.col(f"z_{k}") - F.col("restrictions")) / F.sqrt(2 * F.col("restrictions") / F.col("groups")) for k in forms})
    return scaled.withColumns({f"p_{k}": 2 * distributions.normal_cdf(-F.abs(f"z_{k}")) for k in forms})


def autocorrelations(panel: DataFrame, column: str, most: int) -> DataFrame:
    """loc, n, r array: autocorrelations at lags 1 .. most of the observed values in order."""
    by = W.Window.partitionBy("loc")
    c = panel.where(F.col(column).isNotNull()).select("loc", "t", (F.col(column) - F.avg(column).over(by)).alias("u"))
    c = c.select("loc", "u", *[F.lag("u", k).over(by.orderBy("t")).alias(f"u{k}") for k in range(1, most + 1)])
    return c.groupBy("loc").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("u") * F.col(f"u{k}")) / F.sum(F.col("u") * F.col("u")) for k in range(1, most + 1)]).alias("r"))


def partial_autocorrelations(rows: DataFrame) -> DataFrame:
    """loc, n, pacf array and order: partial autocorrelations by the Durbin-Levinson recursion, as a
    fold over the lags, and the order with the smallest AIC of the fitted autoregressions."""
    start = F.struct(F.array().cast("array<double>").alias("phi"), F.array().cast("array<double>").alias("out"), F.lit(1.0).alias("v"), F.array(F.lit(0.0)).alias("aic"))

    def step(a, k):
        known = F.size(a["phi"])
        top = F.element_at("r", k) - F.aggregate(F.zip_with(a["phi"], F.slice(F.reverse(F.slice("r", F.lit(1), F.greatest(k - 1, F.lit(1)))), F.lit(1), known), lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
        low = F.lit(1.0) - F.aggregate(F.zip_with(a["phi"], F.slice("r", F.lit(1), known), lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
        last = top / low
        phi = F.concat(F.zip_with(a["phi"], F.reverse(a["phi"]), lambda p, q: p - last * q), F.array(last))
        v = a["v"] * (1 - last * last)
        return F.struct(phi.alias("phi"), F.concat(a["out"], F.array(last)).alias("out"), v.alias("v"), F.concat(a["aic"], F.array(F.col("n") * F.log(v) + 2.0 * k)).alias("aic"))

    folded = rows.withColumn("a", F.aggregate(F.sequence(F.lit(1), F.size("r")), start, step))
    return folded.select("loc", "n", F.col("a.out").alias("pacf"), (F.array_position("a.aic", F.array_min("a.aic")) - 1).cast("int").alias("order"))


def unchanged_share(panel: DataFrame, column: str) -> DataFrame:
    """loc, unchanged: the share of steps whose value is that of the step before, both observed."""
    before = F.lag(column).over(W.Window.partitionBy("loc").orderBy("t"))
    return panel.select("loc", (F.col(column) == before).cast("double").alias("same")).groupBy("loc").agg(F.avg("same").alias("unchanged"))


def long_run(draws: DataFrame, parts: DataFrame, level: float = 0.95) -> DataFrame:
    """g, lrm_lo, lrm_up, own: percentile interval over draws(b, g, parameter, value) of the sum of the
    neighbour coefficients by one less the sum of the own ones; parts(parameter, part)."""
    of = lambda part: F.sum(F.when(F.col("part") == part, F.col("value")).otherwise(0.0))
    each = draws.join(F.broadcast(parts), "parameter").groupBy("b", "g").agg(of("nb").alias("nb"), of("own").alias("own")).withColumn("lrm", F.col("nb") / (1 - F.col("own")))
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return each.groupBy("g").agg(F.expr(f"percentile(lrm, {lo!r})").alias("lrm_lo"), F.expr(f"percentile(lrm, {hi!r})").alias("lrm_up"), F.avg("own").alias("own"), F.count(F.lit(1)).alias("draws"))
