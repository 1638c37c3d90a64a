"""Regimes: locations partitioned jointly with the parameters of one model per regime.

All configurations (number of regimes k, weight phi of agreeing neighbours) advance
together: a model is one regime of one configuration, so a sweep is the same joins and
sums for the whole grid, keyed by model, and no configuration waits for another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators import clusterwise, spatial, statespace
from ..sources.store import cut_lineage

#: Parameters of a regime's model: two coefficients, two variances, the state's coefficient and start.
N_PARAMETERS = 6


def start_labels(panel: DataFrame, configs: DataFrame) -> DataFrame:
    """config, loc, g: locations in order of their mean response, in k runs of like size."""
    level = panel.groupBy("loc").agg(F.avg("z").alias("level"))
    n = level.count()
    ranked = level.select("loc", (F.row_number().over(W.Window.orderBy("level", "loc")) - 1).alias("r"))  # one row per location
    return ranked.join(F.broadcast(configs)).select("config", "loc", (F.floor(F.col("r") * F.col("k") / n) + 1).cast("int").alias("g"))


def keyed(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """panel once per configuration, with the model of each location's regime."""
    return panel.join(labels, "loc").select(F.concat_ws("#", "config", "g").alias("model"), "loc", "t", "z", "x")


def scores(panel: DataFrame, models: DataFrame, states: DataFrame) -> DataFrame:
    """config, loc, g, ll: log-likelihood of each location's observed cells under each regime."""
    m = models.join(states.select("model", "t", F.col("m").alias("state")), "model").select("t", "b0", "b1", "v", "state", F.split("model", "#")[0].alias("config"), F.split("model", "#")[1].cast("int").alias("g"))
    e = F.col("z") - F.col("b0") - F.col("b1") * F.col("x") - F.col("state")
    ll = -0.5 * (F.log(2 * F.pi() * F.col("v")) + e * e / F.col("v"))
    return panel.where("z IS NOT NULL").join(m, "t").groupBy("config", "loc", "g").agg(F.sum(ll).alias("ll"))


def new_labels(scored: DataFrame, labels: DataFrame, edges: DataFrame, weight: DataFrame) -> DataFrame:
    """Simultaneous update: the regime with the largest score plus weight times agreeing neighbours;
    weight(config, weight) stays as the first sweep's scores gave it."""
    votes = edges.join(labels.withColumnRenamed("loc", "j"), "j").groupBy("config", F.col("i").alias("loc"), "g").agg(F.count(F.lit(1)).alias("agree"))
    total = scored.join(votes, ["config", "loc", "g"], "left").join(F.broadcast(weight), "config")
    total = total.withColumn("value", F.col("ll") + F.col("weight") * F.coalesce("agree", F.lit(0)))
    return total.groupBy("config", "loc").agg(F.max(F.struct("value", (-F.col("g")).alias("g"))).alias("b")).select("config", "loc", (-F.col("b.g")).alias("g"))


def fit_grid(panel: DataFrame, places: DataFrame, ks: list[int], phis: list[float], neighbours: int = 4, sweeps: int = 10, em_steps: int = 500, min_size: int = 2, tol: float = 1e-3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grid table, labels, models) of all configurations; panel(loc, t, z, x), places(loc, x, y).

    k = 1 is fitted once, at the first phi.  A configuration is admissible if all its regimes
    kept at least min_size locations.  It has converged if no location changed its regime in
    the last sweep and EM of all its regimes reached tol; moved counts the changes."""
    spark = panel.sparkSession
    chosen = [(f"{k}|{p!r}", k, float(p)) for k in ks for p in (phis if k > 1 else phis[:1])]
    configs = spark.createDataFrame(chosen, "config string, k int, phi double")
    edges = cut_lineage(spatial.neighbour_graph(places, neighbours))
    panel = cut_lineage(panel.select("loc", "t", "z", "x"))
    labels, models = cut_lineage(start_labels(panel, configs)), None
    older, weight = labels, None
    for _ in range(sweeps):
        cells = cut_lineage(keyed(panel, labels))
        first = statespace.start_values(cells)
        if models is not None:
            models = models.drop("loglik", "steps", "converged")
            first = first.join(models.select("model"), "model", "left_anti").unionByName(models.join(first.select("model"), "model", "left_semi"))
        models = cut_lineage(statespace.fit_on_sums(cells, first, tol, em_steps, accelerate=True))
        states = statespace.smoothed(statespace.filtered(statespace.step_sums(cells, models)))
        scored = scores(panel, models, states)
        if weight is None:
            scored = cut_lineage(scored)
            weight = cut_lineage(clusterwise.penalty_weights(scored, edges, configs))
        after = cut_lineage(new_labels(scored, labels, edges, weight))
        both = after.join(labels.withColumnRenamed("g", "old"), ["config", "loc"]).join(older.withColumnRenamed("g", "older"), ["config", "loc"])
        counts = both.groupBy("config").agg(F.count(F.when(F.col("g") != F.col("old"), 1)).alias("moved"), F.count(F.when(F.col("g") != F.col("older"), 1)).alias("since"))
        moves = cut_lineage(counts)
        labels, older = after, labels
        if moves.where("moved > 0 AND since > 0").isEmpty():  # all at rest, or between two partitions for good
            break
    moves = moves.drop("since")
    cells = cut_lineage(keyed(panel, labels))
    models = cut_lineage(statespace.fit_on_sums(cells, statespace.start_values(cells), tol, em_steps, accelerate=True))
    ends = models.groupBy(F.split("model", "#")[0].alias("config")).agg(F.sum("loglik").alias("loglik"), F.bool_and("converged").alias("em_done"))
    sizes = labels.groupBy("config", "g").agg(F.count(F.lit(1)).alias("size")).groupBy("config").agg(F.count(F.lit(1)).cast("int").alias("k_eff"), F.min("size").alias("min_size"))
    nobs = panel.agg(F.count("z").cast("double").alias("nobs"))
    table = configs.join(ends, "config").join(sizes, "config").join(moves, "config").join(F.broadcast(nobs))
    table = table.select("config", "k", "phi", "k_eff", "min_size", "loglik", (F.col("k_eff") * N_PARAMETERS).cast("double").alias("df"), "nobs", ((F.col("k_eff") == F.col("k")) & (F.col("min_size") >= min_size)).alias("admissible"), "moved", (F.col("em_done") & (F.col("moved") == 0)).alias("converged"))
    return table, labels, models
