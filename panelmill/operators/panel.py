"""Panel construction and reshaping: one row per location and time step.

A panel is a DataFrame panel(loc, t, z, x...), with z null where nothing was observed.
All functions are compositions of joins, windows and aggregates by location or time, so
they distribute by those keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .numbering import numbered


def dense(observed: DataFrame) -> DataFrame:
    """Every location with every time step of the table; missing cells are null.

    Each location carries the array of time steps, so no cross join is planned."""
    times = observed.select("t").distinct().agg(F.sort_array(F.collect_set("t")).alias("ts"))
    locs = observed.select("loc").distinct().join(F.broadcast(times))
    grid = locs.select("loc", F.explode("ts").alias("t"))
    return grid.join(observed, ["loc", "t"], "left")


def checks(panel: DataFrame) -> DataFrame:
    """One row of the counts on which a panel is accepted or refused."""
    per_loc = panel.groupBy("loc").agg(F.count(F.lit(1)).alias("n"), F.count("z").alias("seen"), F.countDistinct("t").alias("steps"))
    return per_loc.agg(
        F.count(F.lit(1)).alias("d"), F.max("steps").alias("n"), F.sum("seen").alias("observed"),
        (F.sum("n") - F.sum("seen")).alias("missing"), F.sum((F.col("seen") == 0).cast("long")).alias("never_observed"),
        F.sum((F.col("n") != F.col("steps")).cast("long")).alias("repeated_cells"),
    )


def validate(panel: DataFrame, covariates: list[str]) -> DataFrame:
    """panel itself, or an error that names what is wrong with it."""
    c = checks(panel).first()
    if not c["d"] or not c["observed"]:
        raise ValueError("the response is entirely missing")
    if c["never_observed"]:
        raise ValueError(f"{c['never_observed']} locations are never observed")
    if c["repeated_cells"]:
        raise ValueError(f"{c['repeated_cells']} locations have repeated time steps")
    for x in covariates:
        if dict(panel.dtypes).get(x) not in ("double", "float", "int", "bigint"):
            raise TypeError(f"covariate {x} is not numeric")
    if covariates and not panel.where(" OR ".join(f"{x} IS NULL" for x in covariates)).isEmpty():
        raise ValueError("covariates may not be missing")
    return panel


def relative(panel: DataFrame, level: DataFrame, in_window: Column) -> DataFrame:
    """100 * (z - level of the time step), less its mean over the window's observed steps."""
    joined = panel.join(F.broadcast(level.select("t", "level")), "t")
    c = 100 * (F.col("z") - F.col("level"))
    mean = F.avg(F.when(in_window, c)).over(W.Window.partitionBy("loc"))
    return joined.withColumn("rel", c - mean)


def lags(panel: DataFrame, column: str, most: int) -> DataFrame:
    """column_lag1 .. column_lag<most> along time within each location."""
    by = W.Window.partitionBy("loc").orderBy("t")
    return panel.select("*", *[F.lag(column, k).over(by).alias(f"{column}_lag{k}") for k in range(1, most + 1)])


def pulses(times: DataFrame, events: DataFrame) -> DataFrame:
    """event, t, first, second: 1 in the first time step on or after the event, and in the next.

    times(t, day), events(event, day)."""
    order = W.Window.orderBy("t")  # the time axis of a panel, not its cells
    steps = times.select("t", "day", F.lead("t").over(order).alias("after"))
    on = steps.alias("s").join(F.broadcast(events.alias("e")), F.col("s.day") >= F.col("e.day"))
    first = on.groupBy("event").agg(F.min(F.struct("t", "after")).alias("f"))
    marks = first.select("event", F.explode(F.array(F.struct(F.col("f.t").alias("t"), F.lit(1).alias("first"), F.lit(0).alias("second")), F.struct(F.col("f.after").alias("t"), F.lit(0).alias("first"), F.lit(1).alias("second")))).alias("m"))
    return marks.select("event", "m.t", "m.first", "m.second").where("t IS NOT NULL")


def observed_index(panel: DataFrame) -> DataFrame:
    """t, n_obs, pattern: the observed locations of each time step as a key; NULL when all are
    observed, 'p' when none is.  The key has their number and two sums of hashes of the locations,
    added up before the shuffle, so its size does not grow with the locations."""
    seen = F.col("z").isNotNull()
    first, second = (F.sum(F.when(seen, (F.col("loc") * a + b) % m)) for a, b, m in ((2654435761, 97, 2147483647), (40503, 1013904223, 2147483629)))
    by = panel.groupBy("t").agg(F.count("z").alias("n_obs"), F.count(F.lit(1)).alias("n"), first.alias("s1"), second.alias("s2"))
    key = F.when(F.col("n_obs") == F.col("n"), F.lit(None)).when(F.col("n_obs") == 0, "p").otherwise(F.concat_ws(".", "n_obs", "s1", "s2"))
    return by.select("t", "n_obs", key.alias("pattern"))


def apart(locations: DataFrame, step: float = 1e-5, digits: int = 6) -> DataFrame:
    """loc, x, y with repeated places (after rounding) moved by step times their running number."""
    place = W.Window.partitionBy(F.round("x", digits), F.round("y", digits)).orderBy("loc")
    again = locations.withColumn("again", F.row_number().over(place) - 1)
    repeated = numbered(again.where("again > 0").select("loc"), ["loc"], "k").withColumn("k", F.col("k") + 1)
    moved = again.join(repeated.select("loc", "k"), "loc", "left").withColumn("by", F.coalesce(F.col("k"), F.lit(0)) * step)
    return moved.select("loc", (F.col("x") + F.col("by")).alias("x"), (F.col("y") + F.col("by")).alias("y"))
