"""The application as one run: pairs, relative series, completion, case frame, design of four blocks, tests.

Each table is written once under a folder and found there by a later run, which goes on with the first missing one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import design, leastsquares, panel, penalised_fit, spatial
from ..sources import store
from . import panel_queries as base

#: Settings of the pairs: from which group to which; in the third both are major and their brands differ.
SETTINGS = ((1, "major", "independent"), (2, "independent", "major"), (3, "major", "major"))
SERIES = ("g", "d")
#: Lags of the blocks: own series, own other series, neighbour's series, neighbour's other series.
LAGS = {"own": [1, 2, 3, 4], "own_other": [1, 2], "nb": [1, 2], "nb_other": [1, 2]}
#: Steps before this one give lags only; steps of the events.
FIRST, EVENTS = 12, (("a", 20), ("b", 47), ("late", 5000))
HYPOTHESES = {"nb_both": ("nb", "nb_other"), "nb": ("nb",), "nb_other": ("nb_other",), "own_other": ("own_other",)}


def stations(spark: SparkSession, d: str) -> DataFrame:
    """loc, x, y, city, brand, grp: suppliers by region and nation; nations with an even number are major brands."""
    n = base._t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("city"))
    p = base.places(spark, d).join(F.broadcast(n), "nation")
    return p.select("loc", "x", "y", "city", F.col("nation").alias("brand"), F.when(F.col("nation") % 2 == 0, "major").otherwise("independent").alias("grp"))


def prices(spark: SparkSession, d: str) -> DataFrame:
    """loc, t, g, d: mean price in thousands by month of odd and of even lines, every month of every supplier."""
    m = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    odd = F.col("l_linenumber") % 2 == 1
    mean = lambda on: F.sum(F.when(on, cents)).cast("double") / F.count(F.when(on, cents)) / 100000.0
    cells = base._t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("loc"), m.alias("m")).agg(mean(odd).alias("g"), mean(~odd).alias("d"))
    first = cells.agg(F.min("m").alias("m0"))
    return panel.dense(cells.join(F.broadcast(first)).select("loc", (F.col("m") - F.col("m0")).cast("int").alias("t"), "g", "d"))


def pairs(places: DataFrame) -> DataFrame:
    """setting, loc, nearest, dist: of every station of a setting's first group the nearest of its second in its city."""
    def side(which: int) -> DataFrame:
        asked = F.array(*[F.struct(F.lit(s[0]).alias("setting"), F.lit(s[which]).alias("grp")) for s in SETTINGS])
        rows = places.select("*", F.explode(asked).alias("s")).where("grp = s.grp")
        return rows.select(F.concat_ws("|", "s.setting", "city").alias("place_of"), "loc", "x", "y", F.when(F.col("s.setting") == 3, F.col("brand")).alias("tag"))

    found = spatial.nearest_allowed(side(1), side(2), "place_of", digits=4)
    return found.select(F.split("place_of", "[|]")[0].cast("int").alias("setting"), "loc", "nearest", "dist")


def relative(table: DataFrame) -> DataFrame:
    """series, loc, t, rel of both series, against the mean of all stations in the step."""
    def one(name: str) -> DataFrame:
        p = table.select("loc", "t", F.col(name).alias("z"))
        level = p.groupBy("t").agg(F.round(F.avg("z"), 6).alias("level"))
        return panel.relative(p, level, F.col("t") >= FIRST).select(F.lit(name).alias("series"), "loc", "t", F.round("rel", 4).alias("rel"))

    return store.union_all([one(s) for s in SERIES])


def completed(rel: DataFrame, places: DataFrame, pulses: DataFrame) -> DataFrame:
    """rel with ``filled``: a model with pulses for every city and series fills its gaps; where it fails, they stay null."""
    columns = ["one", *[c for c in pulses.columns if c != "t"]]
    rows = rel.join(places.select("loc", "city"), "loc").join(F.broadcast(pulses), "t").withColumns({"one": F.lit(1.0), "model": F.concat_ws("|", "city", "series")})
    fits = penalised_fit.fit(rows, "rel", columns, [penalised_fit.Settings(tol=base.EM_TOL, most=base.EM_MOST)])
    return penalised_fit.completed(rows, store.cut_lineage(fits), "rel", columns).select("series", "loc", "t", "rel", "filled")


def cases(found: DataFrame, places: DataFrame, series: DataFrame, pulses: DataFrame) -> DataFrame:
    """A row for each setting, station of its first group and step: attributes and both series of the station, observed and
    completed, the completed ones of its partner, pulses, and whether the step is presample."""
    wide = series.groupBy("loc", "t").agg(*[F.max(F.when(F.col("series") == s, F.col(c))).alias(f"{s}{end}") for s in SERIES for c, end in (("rel", ""), ("filled", "_c"))])
    mine = wide.select("t", F.col("loc"), *[F.col(f"{s}{e}").alias(f"y{s}{e}") for s in SERIES for e in ("", "_c")])
    theirs = wide.select("t", F.col("loc").alias("nearest"), *[F.col(f"{s}_c").alias(f"x{s}") for s in SERIES])
    own = places.select("loc", "city", F.col("brand").alias("y_brand"), F.col("grp").alias("y_group"))
    other = places.select(F.col("loc").alias("nearest"), F.col("brand").alias("x_brand"))
    rows = found.join(own, "loc").join(other, "nearest").join(mine, "loc").join(theirs, ["nearest", "t"]).join(F.broadcast(pulses), "t")
    return rows.withColumn("presample", F.col("t") < FIRST)


def designs(frame: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
    """(design of both series, columns of each block)."""
    pulses = [c for c in frame.columns if c.startswith("pulse_")]
    out = []
    for s, o in (SERIES, SERIES[::-1]):
        sources = {"own": f"y{s}_c", "own_other": f"y{o}_c", "nb": f"x{s}", "nb_other": f"x{o}"}
        rows, blocks = design.block_design(frame, ["setting", "loc"], sources, LAGS, ["city", *pulses, f"y{s}"])
        out.append(rows.withColumnRenamed(f"y{s}", "y").withColumn("series", F.lit(s)))
    return store.union_all(out), blocks | {"pulses": pulses}


def tests(rows: DataFrame, blocks: dict[str, list[str]]) -> DataFrame:
    """setting, city, series, loc and the tests of four hypotheses."""
    asked = {h: [c for b in bs for c in blocks[b]] for h, bs in HYPOTHESES.items()}
    named = rows.withColumn("key", F.concat_ws("|", "setting", "city", "series", "loc"))
    t = leastsquares.block_tests(named, "key", "y", [c for b in blocks for c in blocks[b]], asked)
    part = F.split("key", "[|]")
    return t.select(part[0].cast("int").alias("setting"), part[1].cast("int").alias("city"), part[2].alias("series"), part[3].cast("long").alias("loc"), *[c for c in t.columns if c != "key"])


def run(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """setting, city, series, block and the panel tests; tables of all stages are kept under ``folder``."""
    once = lambda name, make: store.computed_once(spark, f"{folder}/{name}", make)
    places = once("stations", lambda: stations(spark, d))
    table = once("prices", lambda: prices(spark, d))
    pulses = once("pulses", lambda: pulse_table(spark, table))
    found = once("pairs", lambda: pairs(places))
    series = once("completed", lambda: completed(relative(table), places, pulses))
    frame = once("cases", lambda: cases(found, places, series, pulses))
    rows, blocks = designs(frame)
    each = once("tests", lambda: tests(rows, blocks))
    return design.mean_wald(each, ["setting", "city", "series"])


def pulse_table(spark: SparkSession, table: DataFrame) -> DataFrame:
    times = table.select("t", F.col("t").alias("day")).distinct()
    return design.pulse_columns(times, spark.createDataFrame(EVENTS, "event string, day int"), [e for e, _ in EVENTS])


def application_pairs(spark, d):
    """Pairs of all three settings."""
    return pairs(stations(spark, d))


def application_cases(spark, d):
    """The case frame, with gaps at the mean of the relative series instead of a model's completion."""
    table = store.cut_lineage(prices(spark, d))
    places = store.cut_lineage(stations(spark, d))
    series = relative(table).withColumn("filled", F.coalesce("rel", F.lit(0.0)))
    return cases(pairs(places), places, series, pulse_table(spark, table)).drop("dist")


def application_design(spark, d):
    """Sums over the steps of each station's design of four blocks, with gaps at the mean."""
    rows, blocks = designs(store.cut_lineage(application_cases(spark, d)))
    lagged = [c for b in LAGS for c in blocks[b]]
    return rows.groupBy("setting", "series", "loc").agg(F.count(F.lit(1)).alias("steps"), F.count("y").alias("seen"), *[(F.sum(F.round(F.col(c) * 10000).cast("long")) / 10000).alias(c) for c in [*lagged, *blocks["pulses"]]])


def application_run(spark, d):
    """All stages with the completion by models, down to the panel tests of every city, setting and series."""
    return run(spark, d, f"{store.shared_folder(spark)}/application-{uuid.uuid4().hex}")


QUERIES = {f.__name__: f for f in (application_pairs, application_cases, application_design, application_run)}
