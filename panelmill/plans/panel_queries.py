"""Registered queries of the panel operators on the driver's tables.

The panel is supplier x month of lineitem: z the mean price in thousands, x the mean
discount.  Places are the first two components of the embedding with the supplier's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inference, panel, partitions, spatial, statespace
from ..sources import store
from . import regimes, spatial_models

FOLDS, NEIGHBOURS = 5, 4
#: EM stops at this change of the log-likelihood; the bound on steps and the draws are the reference's defaults.
EM_TOL, EM_MOST, DRAWS = 1e-3, 500, 100


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _mean_of_cents(column: str, unit: int):
    """Mean from a sum of whole hundredths, which does not depend on the order of rows."""
    return F.sum(F.round(F.col(column) * 100).cast("long")).cast("double") / F.count(column) / (100.0 * unit)


def observed(spark: SparkSession, d: str) -> DataFrame:
    """loc, t, z, x of the months in which a supplier sold."""
    m = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    cells = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("loc"), m.alias("m")).agg(_mean_of_cents("l_extendedprice", 1000).alias("z"), _mean_of_cents("l_discount", 1).alias("x"))
    first = cells.agg(F.min("m").alias("m0"))
    return cells.join(F.broadcast(first)).select("loc", (F.col("m") - F.col("m0")).cast("int").alias("t"), "z", "x")


def grid(spark: SparkSession, d: str) -> DataFrame:
    return panel.dense(observed(spark, d)).withColumn("x", F.coalesce("x", F.lit(0.05)))


def places(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("loc"), F.round(F.col("embedding")[0].cast("double"), 6).alias("x"), F.round(F.col("embedding")[1].cast("double"), 6).alias("y"))
    return e.join(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("loc"), F.col("s_nationkey").alias("nation")), "loc")


def models(spark: SparkSession, d: str) -> DataFrame:
    """Fixed parameters for one model per nation."""
    n = _t(spark, d, "nation").select(F.col("n_name").alias("model"), F.col("n_nationkey").alias("k"))
    return n.select("model", F.lit(37.0).alias("b0"), F.lit(2.0).alias("b1"), (90.0 + F.col("k")).alias("v"), (0.5 + F.col("k") / 100).alias("g"), F.lit(3.0).alias("w"), F.lit(0.0).alias("m0"), F.lit(1.0).alias("c0"))


def model_panel(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("loc"), F.col("n_name").alias("model"))
    return grid(spark, d).join(s, "loc")


def panel_dense(spark, d):
    return grid(spark, d).select("loc", "t", "z", "x")


def panel_checks(spark, d):
    return panel.checks(grid(spark, d))


def panel_relative(spark, d):
    g = grid(spark, d)
    level = g.groupBy("t").agg(F.round(F.avg("z"), 6).alias("level"))
    return panel.relative(g, level, F.col("t") >= 12).select("loc", "t", F.round("rel", 5).alias("rel"))


def panel_lags(spark, d):
    return panel.lags(grid(spark, d), "z", 4).select("loc", "t", *[f"z_lag{k}" for k in range(1, 5)])


def panel_pulses(spark, d):
    days = _t(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    first = days.agg(F.min("day").alias("d0"))
    times = days.join(F.broadcast(first)).select(F.datediff("day", "d0").alias("t"), "day")
    events = spark.createDataFrame([("a", "2024-01-05"), ("b", "2024-01-12"), ("c", "2024-01-30"), ("d", "2025-01-01")], "event string, day string").withColumn("day", F.to_date("day"))
    return panel.pulses(times, events)


def panel_observed_index(spark, d):
    return panel.observed_index(grid(spark, d))


def panel_covariate_means(spark, d):
    return grid(spark, d).groupBy("loc").agg(F.round(F.avg("x"), 6).alias("x_mean"), F.count("z").alias("seen"))


def places_apart(spark, d):
    p = places(spark, d).select("loc", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))
    return panel.apart(p).select("loc", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def knn_graph(spark, d):
    return spatial.neighbour_graph(places(spark, d), NEIGHBOURS)


def knn_distances(spark, d):
    p = places(spark, d)
    return spatial.nearest(p, p, NEIGHBOURS).select("i", "j", F.round("h", 6).alias("h"), "rank")


def potts_pairs(spark, d):
    p = places(spark, d)
    return spatial.agreeing_pairs(spatial.neighbour_graph(p, NEIGHBOURS), p.select("loc", (F.col("nation") % 5).alias("g")))


def nearest_of_nation(spark, d):
    """The nearest supplier of the same nation with a positive balance."""
    p = places(spark, d).join(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("loc"), "s_acctbal"), "loc")
    return spatial.nearest_of_group(p, p.where("s_acctbal > 0"), "nation")


def decay_limits(spark, d):
    p = places(spark, d)
    r = spatial.decay_limits(spatial.nearest(p, p, NEIGHBOURS))
    return r.select(F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


def distance_bins(spark, d):
    p = places(spark, d)
    h = spatial.nearest(p, p, NEIGHBOURS).withColumn("bin", inference.bins(F.round(F.col("h"), 6), [0, 0.05, 0.1, 0.2, 0.5, 1, 10]))
    return h.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def partitions_ari(spark, d):
    c = _t(spark, d, "customer")
    return inference.adjusted_rand(c.select(F.col("c_mktsegment").alias("a"), (F.col("c_nationkey") % 5).alias("b"))).select(F.round("ari", 8).alias("ari"))


def contingency(spark, d):
    return _t(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def _grid_table(spark, d):
    """Criteria of (k, phi) from orders: a table with the columns of a grid of fits."""
    o = _t(spark, d, "orders").select((F.col("o_orderkey") % 5 + 1).cast("int").alias("k"), (F.col("o_custkey") % 7).alias("p"), "o_totalprice")
    g = o.groupBy("k", "p").agg(F.round(-F.avg("o_totalprice") / 100, 2).alias("loglik"), F.count(F.lit(1)).alias("n"))
    return g.select("k", (F.col("p") * 0.025).alias("phi"), "loglik", (F.col("k") * 6.0).alias("df"), F.lit(5000.0).alias("nobs"), (F.col("n") % 9 != 0).alias("admissible"))


def information_criteria(spark, d):
    r = inference.criteria(_grid_table(spark, d))
    return r.select("k", F.round("phi", 4).alias("phi"), *[F.round(c, 4).alias(c) for c in ("aic", "bic", "kic", "hq", "aicc")])


def model_selection(spark, d):
    return inference.select_model(inference.criteria(_grid_table(spark, d)), 0.02, 0.2).select("k", F.round("phi", 4).alias("phi"), F.round("bic", 4).alias("bic"))


def _draws(spark, d):
    li = _t(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("b"), (F.col("l_suppkey") % 4).alias("g")).agg(F.round(F.avg("l_discount"), 6).alias("disc"), F.round(F.avg("l_quantity"), 6).alias("quant"))
    return li.select("b", "g", F.expr("stack(2, 'disc', disc, 'quant', quant) AS (parameter, value)")).withColumn("est", F.when(F.col("parameter") == "disc", 0.05).otherwise(25.0))


def draw_summary(spark, d):
    r = inference.draw_summary(_draws(spark, d))
    return r.select("g", "parameter", "n_draws", *[F.round(c, 6).alias(c) for c in ("mean", "se", "bias", "q_lo", "q_hi", "basic_lo", "basic_hi")])


def group_differences(spark, d):
    r = inference.group_differences(_draws(spark, d))
    return r.select("parameter", "g", "h", F.round("diff", 6).alias("diff"), F.round("p", 6).alias("p"), "n")


def co_clustering(spark, d):
    e = _t(spark, d, "events").groupBy((F.col("event_id") % 10).alias("b"), F.col("user_id").alias("loc")).agg((F.count(F.lit(1)) % 3).alias("g"))
    ids = e.select(F.col("loc").alias("i")).distinct()
    edges = ids.withColumn("j", F.explode(F.array(F.col("i") + 1, F.col("i") + 2)))
    return inference.together(e, edges).select("i", "j", F.round("share", 6).alias("share"))


def vote_mode(spark, d):
    return inference.vote(_t(spark, d, "lineitem").select("l_suppkey", "l_linenumber"), "l_suppkey", "l_linenumber")


def fold_errors(spark, d):
    g = grid(spark, d)
    folds = inference.blocked_folds(g, FOLDS)
    fit = folds.join(g.groupBy("t").agg(F.round(F.avg("z"), 6).alias("fit")), "t")
    r = inference.fold_errors(fit, ["time_fold", "loc_fold"])
    return r.select("time_fold", "loc_fold", "n", F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), "place")


def departures(spark, d):
    """Per location: mean, slope, lag-1 correlation and log variance of what the state leaves; locations
    with fewer than 5 cells, or 3 pairs of steps for the correlation, get the median of the others."""
    p, w = model_panel(spark, d), panel.W.Window.partitionBy("loc").orderBy("t")
    s = statespace.smoothed(statespace.filtered(statespace.step_sums(p, models(spark, d))))
    y = p.join(s.select("model", "t", "m"), ["model", "t"]).select("loc", "t", "x", (F.col("z") - F.col("m")).alias("y"))
    enough = F.count("y") >= 5
    fit = y.groupBy("loc").agg(F.when(enough, F.regr_slope("y", "x")).alias("b"), F.when(enough, F.regr_intercept("y", "x")).alias("a"), F.when(enough, F.avg("y")).alias("level"))
    u = y.join(fit, "loc").withColumn("u", F.col("y") - F.col("a") - F.col("b") * F.col("x")).withColumn("u1", F.lag("u").over(w))
    pairs = F.count(F.when(F.col("u").isNotNull() & F.col("u1").isNotNull(), 1)) >= 3
    f = store.cut_lineage(u.groupBy("loc").agg(F.first("level").alias("level"), F.first("b").alias("slope"), F.when(pairs, F.corr("u", "u1")).alias("ar1"), F.log(F.greatest(F.var_samp("u"), F.lit(2.2e-16))).alias("logvar")))
    names = ("level", "slope", "ar1", "logvar")
    fill = f.agg(*[F.median(c).alias(f"m_{c}") for c in names])
    return f.join(F.broadcast(fill)).select("loc", *[F.round(F.coalesce(c, f"m_{c}"), 4).alias(c) for c in names])


def residual_diagnostics(spark, d):
    """Per location: Ljung-Box statistic of four lags, lag-1 autocorrelation, kurtosis of z."""
    g = grid(spark, d).where("z IS NOT NULL")
    w = panel.W.Window.partitionBy("loc")
    c = g.withColumn("r", F.col("z") - F.avg("z").over(w))
    c = panel.lags(c.select("loc", "t", "r"), "r", 4)
    s = c.groupBy("loc").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r") * F.col("r")).alias("c0"), F.avg(F.pow("r", F.lit(4.0))).alias("m4"), *[F.sum(F.col("r") * F.col(f"r_lag{k}")).alias(f"c{k}") for k in range(1, 5)])
    q = F.col("n") * (F.col("n") + 2) * sum((F.pow(F.col(f"c{k}") / F.col("c0"), F.lit(2.0)) / (F.col("n") - k) for k in range(1, 5)), F.lit(0.0))
    return s.select("loc", F.round(q, 4).alias("q4"), F.round(F.col("c1") / F.col("c0"), 5).alias("acf1"), F.round(F.col("m4") / F.pow(F.col("c0") / F.col("n"), F.lit(2.0)), 4).alias("kurtosis"))


def start_values(spark, d):
    r = statespace.start_values(model_panel(spark, d))
    return r.select("model", *[F.round(c, 4).alias(c) for c in ("b0", "b1", "v", "w")])


def kalman_filter(spark, d):
    f = statespace.filtered(statespace.step_sums(model_panel(spark, d), models(spark, d)))
    return f.select("model", F.round("loglik", 3).alias("loglik"), F.explode("path").alias("p")).select("model", "loglik", "p.t", F.round("p.m", 5).alias("m"), F.round("p.c", 5).alias("c"))


def kalman_smoother(spark, d):
    s = statespace.smoothed(statespace.filtered(statespace.step_sums(model_panel(spark, d), models(spark, d))))
    return s.select("model", "t", F.round("m", 5).alias("m"), F.round("c", 5).alias("c"))


def completion(spark, d):
    p, m = model_panel(spark, d), models(spark, d)
    s = statespace.signal(p, m, statespace.smoothed(statespace.filtered(statespace.step_sums(p, m))))
    return s.select("model", "loc", "t", F.round("fit", 5).alias("fit"), F.coalesce("z", F.round("fit", 5)).alias("filled"))


def label_update(spark, d):
    """Simultaneous update: for each location the group with most agreeing neighbours, ties smaller."""
    p = places(spark, d)
    labels = p.select(F.col("loc").alias("j"), (F.col("nation") % 5).alias("g"))
    n = spatial.neighbour_graph(p, NEIGHBOURS).join(labels, "j").groupBy("i", "g").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("i").agg(F.max(F.struct("n", (-F.col("g")).alias("g"))).alias("m")).select(F.col("i").alias("loc"), (-F.col("m.g")).alias("g"), F.col("m.n").alias("agreeing"))


def wide_pivot(spark, d):
    return _t(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1))).na.fill(0)


def totals(spark, d):
    return _t(spark, d, "orders").rollup("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), "n", "total")


def resume_tasks(spark, d):
    tasks = _t(spark, d, "part").select(F.col("p_partkey").alias("k"))
    done = _t(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return store.unfinished(tasks, done, ["k"])


def monte_carlo(spark, d):
    v = _t(spark, d, "events").withColumn("value", F.when(F.col("value") < 1e308, F.col("value")))
    return v.groupBy("event_type").agg(F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_samp("value") / F.sqrt(F.count("value")), 6).alias("se"), F.count("value").alias("m"), F.round(F.expr("percentile(value, 0.5)"), 5).alias("median"))


def top_brand(spark, d):
    n = _t(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("p_type").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("p_brand").alias("brand"))).alias("b"), F.sum("n").alias("all")).select("p_type", F.col("b.brand").alias("brand"), F.round(-F.col("b.m") / F.col("all"), 6).alias("share"))


def complete_groups(spark, d):
    """Orders whose number of lines is the most frequent one (ties smaller) of their status."""
    n = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("lines"))
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus").join(n, "k")
    mode = inference.vote(o, "o_orderstatus", "lines").select("o_orderstatus", "lines")
    return o.join(F.broadcast(mode), ["o_orderstatus", "lines"], "left_semi").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def cost_projection(spark, d):
    """Mean value of measured cells, else the overall mean, times a number of runs."""
    e = _t(spark, d, "events")
    measured = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.avg("value").alias("cost"))
    overall = measured.agg(F.avg("cost").alias("overall"))
    return e.select("user_id").distinct().join(measured, "user_id", "left").join(F.broadcast(overall)).select("user_id", F.round(F.coalesce("cost", "overall") * 100, 3).alias("hours"))


def em_fit(spark, d):
    """EM of all nations' models to its tolerance, on sums by model and step."""
    p = model_panel(spark, d).select("model", "loc", "t", "z", "x")
    return statespace.fit_on_sums(p, statespace.start_values(p), EM_TOL, EM_MOST, accelerate=True)


def _nation_models(spark, d):
    """The whole panel, under a model for each nation."""
    return model_panel(spark, d).select("model", "loc", "t", "z", "x")


def _spatial_fits(spark, d):
    return spatial_models.fit_models(_nation_models(spark, d), places(spark, d), EM_TOL, EM_MOST)


def unseen_places(spark, d):
    """Places of the embedding without a supplier in the panel, with the covariate of an empty cell and the
    model of the nearest supplier."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("loc"), F.round(F.col("embedding")[0].cast("double"), 6).alias("x"), F.round(F.col("embedding")[1].cast("double"), 6).alias("y"), F.lit(0.05).alias("cov"))
    new = e.join(observed(spark, d).select("loc").distinct(), "loc", "left_anti")
    model = partitions.inherited(new, places(spark, d).select("loc", "x", "y", F.col("nation").alias("g"))).select("loc", "g")
    return new.join(model, "loc").join(F.broadcast(_t(spark, d, "nation").select(F.col("n_nationkey").alias("g"), F.col("n_name").alias("model"))), "g").drop("g")


def spatial_fit(spark, d):
    return _spatial_fits(spark, d)


def spatial_bootstrap(spark, d):
    return spatial_models.bootstrap(_nation_models(spark, d), places(spark, d), store.cut_lineage(_spatial_fits(spark, d)), DRAWS, tol=EM_TOL, most=EM_MOST)


def spatial_kriging(spark, d):
    return spatial_models.krige(_nation_models(spark, d), places(spark, d), store.cut_lineage(_spatial_fits(spark, d)), unseen_places(spark, d))


def spatial_completion(spark, d):
    return spatial_models.complete(_nation_models(spark, d), places(spark, d), _spatial_fits(spark, d))


def _regimes(spark, d):
    return regimes.fit_grid(grid(spark, d), places(spark, d).select("loc", "x", "y"), [1, 2, 3], [0.0, 0.05], tol=EM_TOL, em_steps=EM_MOST)[0]


def regime_grid(spark, d):
    return inference.criteria(_regimes(spark, d))


def regime_selection(spark, d):
    table = store.cut_lineage(_regimes(spark, d))
    chosen = inference.select_model(inference.criteria(table), 0.025, 0.2)
    return chosen.join(table.select("k", "phi", "moved", "converged"), ["k", "phi"])


def corrected_intervals(spark, d):
    return inference.corrected_intervals(_draws(spark, d))


def wald_tests(spark, d):
    w = _draws(spark, d)
    return inference.wald(w.groupBy("g", "parameter").agg(F.avg("value").alias("value")), w)


QUERIES = {
    f.__name__: f
    for f in (
        panel_dense, panel_checks, panel_relative, panel_lags, panel_pulses, panel_observed_index, panel_covariate_means, places_apart, knn_graph, knn_distances,
        potts_pairs, nearest_of_nation, decay_limits, distance_bins, partitions_ari, contingency, information_criteria, model_selection, draw_summary, group_differences,
        co_clustering, vote_mode, fold_errors, departures, residual_diagnostics, start_values, kalman_filter, kalman_smoother, completion, label_update,
        wide_pivot, totals, resume_tasks, monte_carlo, top_brand, complete_groups, cost_projection, em_fit, spatial_fit, spatial_bootstrap,
        spatial_kriging, spatial_completion, regime_grid, regime_selection, corrected_intervals, wald_tests,
    )
}
