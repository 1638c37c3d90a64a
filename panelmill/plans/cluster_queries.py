"""Registered queries of clustered models: start partitions, sweeps, alternating fit, bootstrap, cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusterwise, inference, kmeans, partitions
from ..sources.store import cut_lineage
from . import more_queries
from . import panel_queries as base

K, PHI = 3, 0.05
FEATURES = ["level", "x_mean", "spread"]


def _features(panel):
    """Means of response and covariate and the spread of the response, by location."""
    return panel.groupBy("loc").agg(F.round(F.avg("z"), 6).alias("level"), F.round(F.avg("x"), 6).alias("x_mean"), F.round(F.stddev_samp("z"), 6).alias("spread"))


def graph_colours(spark, d):
    p = base.places(spark, d)
    return clusterwise.graph_colours(p, base.knn_graph(spark, d))


def coloured_sweep(spark, d):
    """One pass over the colours from the partition into nations, with the scores of the nations' models."""
    edges, colours = clusterwise.neighbours(base.places(spark, d), base.NEIGHBOURS)
    n = base._t(spark, d, "nation").select(F.col("n_name").alias("model"), F.col("n_nationkey").cast("int").alias("g"))
    scores = cut_lineage(more_queries._scores(spark, d).join(F.broadcast(n), "model").select(F.lit(1).cast("long").alias("config"), "loc", "g", "ll"))
    labels = base.places(spark, d).select(F.lit(1).cast("long").alias("config"), "loc", F.col("nation").cast("int").alias("g"))
    weights = clusterwise.penalty_weights(scores, edges, spark.createDataFrame([(1, 0.05)], "config long, phi double"))
    after, moves = clusterwise.coloured_sweep(labels, scores, edges, colours, weights, 2)
    return after.join(moves.select("loc", F.round("gain", 3).alias("gain")), "loc", "left").select("loc", "g", "gain")


def kmeans_assignment(spark, d):
    """The nearest of three centres of the standardised features: those of the smallest, middle and largest level."""
    f = _features(base.grid(spark, d))
    s = f.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.stddev_samp(c).alias(f"s_{c}") for c in FEATURES])
    points = cut_lineage(f.join(F.broadcast(s)).select("loc", "level", F.array(*[F.round((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), 4) for c in FEATURES]).alias("point")))
    q = points.agg(F.min(F.struct("level", "loc", "point")).alias("a"), F.max(F.struct("level", "loc", "point")).alias("b")).first()
    centres = [q["a"]["point"], [0.0] * len(FEATURES), q["b"]["point"]]
    return kmeans.assigned(points, centres)


def kmeans_start(spark, d):
    """The partition that the clustered fit starts from."""
    return kmeans.start_partition(_features(base.grid(spark, d)), FEATURES, K)


def _prepared(spark, d):
    panel = cut_lineage(base.grid(spark, d))
    places = cut_lineage(base.places(spark, d).select("loc", "x", "y").join(panel.select("loc").distinct(), "loc", "left_semi"))
    edges, colours = clusterwise.neighbours(places, base.NEIGHBOURS)
    start = cut_lineage(kmeans.start_partition(_features(panel), FEATURES, K))
    return panel, places, cut_lineage(clusterwise.series(panel)), edges, colours, start


def _fitted(spark, d):
    panel, places, rows, edges, colours, start = _prepared(spark, d)
    first = start.withColumn("config", F.lit(1).cast("long"))
    return panel, places, rows, edges, colours, start, clusterwise.alternating_fit(rows, edges, colours, [(1, K, PHI)], first)


def clustered_fit(spark, d):
    """Objective before and after the passes of every iteration of the clustered fit."""
    *_, (_, _, trace, reason) = _fitted(spark, d)
    return trace.select("iteration", "before", "swept", "objective", "moved", "swaps", "smallest", F.lit(reason[1]).alias("reason"))


def clustered_models(spark, d):
    """Size, parameters and log-likelihood of the fitted groups."""
    *_, (labels, models, _, _) = _fitted(spark, d)
    sizes = labels.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    return models.join(sizes, "g").select("g", "size", *clusterwise.PARAMETERS, "loglik", "converged")


def spatial_agreement(spark, d):
    """Adjusted Rand index of the fitted partition against k-means of the places alone."""
    _, places, *_, (labels, _, _, _) = _fitted(spark, d)
    alone = kmeans.start_partition(places, ["x", "y"], K)
    return inference.adjusted_rand(labels.select("loc", F.col("g").alias("a")).join(alone.withColumnRenamed("g", "b"), "loc"))


def _bootstrap(spark, d):
    panel, _, _, edges, colours, start, (labels, models, _, _) = _fitted(spark, d)
    fitted = {r["g"]: {c: r[c] for c in clusterwise.PARAMETERS} for r in models.where("loglik IS NOT NULL").collect()}  # one row for each group
    own = labels.select("loc", "g")
    rows = cut_lineage(clusterwise.series(panel, own))
    return models, clusterwise.bootstrap(rows, edges, colours, fitted, own, start, K, PHI, base.DRAWS, most=5)


def clustered_bootstrap(spark, d):
    """Summary of the draws of every group's parameters, refitted with their labels and aligned, five iterations at most as
    each draw has its best visited partition; draws that failed are
    counted in ``failed``."""
    models, (draws, _, info) = _bootstrap(spark, d)
    stack = ", ".join(f"'{c}', {c}" for c in clusterwise.PARAMETERS if c != "c0")
    long = lambda df, *keys: df.select(*keys, F.expr(f"stack({len(clusterwise.PARAMETERS) - 1}, {stack}) AS (parameter, value)"))
    est = long(models, "g").withColumnRenamed("value", "est")
    failed = info.agg(F.count(F.when(~F.col("ok"), 1)).alias("failed"))
    return inference.draw_summary(long(draws, "b", "g").join(est, ["g", "parameter"])).crossJoin(F.broadcast(failed))


def clustered_cross_validation(spark, d):
    """Errors of the clustered fit by scheme and fold; a fold whose fit failed is a row without errors."""
    _, places, rows, edges, colours, start = _prepared(spark, d)
    return clusterwise.cross_validated(rows, places, edges, colours, start, K, PHI, base.FOLDS, most=10)


QUERIES = {
    f.__name__: f
    for f in (
        graph_colours, coloured_sweep, kmeans_assignment, kmeans_start, clustered_fit, clustered_models, spatial_agreement, clustered_bootstrap, clustered_cross_validation,
    )
}
