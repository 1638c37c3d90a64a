"""Further registered queries: designs, tests, penalties, partitions, selection over replications."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators import design, inference, leastsquares, multistate, panel, partitions, penalised_fit, penalty, spatial, statespace
from ..operators.covariances import Correlation
from . import panel_queries as base
from . import spatial_models

LAGS = 4


def _two_covariates(spark, d):
    """Model panel with an intercept and two covariates: x and the step in years."""
    return base.model_panel(spark, d).select("model", "z", F.lit(1.0).alias("one"), "x", (F.col("t") / 12.0).alias("year"))


def _rounded(fits):
    b = [(F.round(F.col("beta")[i], 5) + 0.0).alias(c) for i, c in enumerate(("b0", "b1", "b2"))]
    return fits.select("model", *b, F.round("df", 5).alias("df"), F.round("lambda_ref", 5).alias("lambda_ref"))


def ridge_fit(spark, d):
    return _rounded(penalty.elastic_net(_two_covariates(spark, d), "model", "z", ["one", "x", "year"], 0.0, 0.3))


def elastic_net(spark, d):
    return _rounded(penalty.elastic_net(_two_covariates(spark, d), "model", "z", ["one", "x", "year"], 0.5, 0.3))


def soft_threshold(spark, d):
    li = base._t(spark, d, "lineitem").select("l_suppkey", penalty.soft(F.round(F.col("l_discount") * 100) - 5, F.lit(2.0)).alias("s"))
    return li.groupBy("l_suppkey").agg(F.sum("s").alias("shrunk"), F.count(F.when(F.col("s") == 0, 1)).alias("zeros"))


def em_iteration(spark, d):
    """One EM step of all nations' models from fixed parameters."""
    new, ll = statespace.em_step(base.model_panel(spark, d), base.models(spark, d))
    return new.join(ll, "model").select("model", *[F.round(c, 5).alias(c) for c in ("b0", "b1", "v", "g", "w", "m0")], F.round("loglik", 3).alias("loglik"))


def augmented_filter(spark, d):
    """The quadratic form of the observed likelihood of every nation's model in its coefficients and start."""
    a = statespace.augmented(base.model_panel(spark, d), base.models(spark, d))
    return a.select("model", *[F.round(c, 4).alias(c) for c in a.columns if c != "model"])


def _two_state_rows(spark, d):
    m = base.models(spark, d).withColumns({"g2": F.lit(0.9), "w2": F.lit(20.0)})
    return statespace.two_states(base.model_panel(spark, d), m)


def two_state_filter(spark, d):
    """Filtered level and coefficient of the discount for every nation."""
    f = _two_state_rows(spark, d)
    return f.select("model", F.round("loglik", 3).alias("loglik"), F.explode("path").alias("p")).select("model", "loglik", "p.t", *[F.round(f"p.{c}", 4).alias(c) for c in statespace.TWO])


def two_state_smoother(spark, d):
    """Level and coefficient of the discount for every nation, given all months."""
    return statespace.two_smoothed(_two_state_rows(spark, d)).select("model", "t", *[F.round(c, 4).alias(c) for c in statespace.TWO])


def _two_state_models(models):
    """models(model, b0, b1, v, g, w, m0, c0) with a second state, in arrays."""
    zero = F.lit(0.0)
    return models.select("model", F.array("b0", "b1").alias("beta"), "v", F.array("g", zero, zero, F.lit(0.9)).alias("g"), F.array("w", zero, zero, F.lit(20.0)).alias("w"), F.array("m0", zero).alias("m0"), F.array("c0", zero, zero, "c0").alias("c0"))


def _two_state_panel(spark, d):
    return base.model_panel(spark, d).select("model", "t", "z", "x", F.lit(1.0).alias("one"))


def two_state_em_step(spark, d):
    """One EM step of every nation's model of a level and a coefficient that change in time, from fixed parameters."""
    f = multistate.one_step(_two_state_panel(spark, d), "z", ["one", "x"], ["one", "x"], _two_state_models(base.models(spark, d)))
    flat = {"b0": F.col("beta")[0], "b1": F.col("beta")[1], "v": F.col("v"), "g1": F.col("g")[0], "g2": F.col("g")[3], "w1": F.col("w")[0], "w2": F.col("w")[3], "m1": F.col("m0")[0], "m2": F.col("m0")[1]}
    return f.select("model", F.round("loglik", 3).alias("loglik"), *[F.round(c, 4).alias(k) for k, c in flat.items()])


def two_state_fit(spark, d):
    """Every nation's model of two states, with free matrices, fitted to its tolerance."""
    p = base.model_panel(spark, d)
    start = _two_state_models(statespace.start_values(p))
    return multistate.fit(_two_state_panel(spark, d), "z", ["one", "x"], ["one", "x"], start, base.EM_TOL, base.EM_MOST, diagonal=False)


def parameter_checks(spark, d):
    """Which parameters of the nations' models, by the method of moments, no model can have: the variance of the state, as that
    of the months' means less their share of the cells' variance, comes out below 0 for some."""
    p = base.model_panel(spark, d).where("z IS NOT NULL")
    steps = p.groupBy("model", "t").agg(F.avg("z").alias("mean"), F.count("z").alias("n")).groupBy("model").agg(F.var_samp("mean").alias("between"), F.avg("n").alias("n"))
    m = p.groupBy("model").agg(F.avg("z").alias("b0"), F.var_samp("z").alias("v")).join(steps, "model")
    zero = F.lit(0.0)
    m = m.select("model", F.array("b0").alias("beta"), "v", F.array(F.lit(0.5)).alias("g"), F.array(F.round(F.col("between") - F.col("v") / F.col("n"), 6)).alias("w"), F.array(zero).alias("m0"), F.array(F.lit(1.0)).alias("c0"))
    return multistate.faults(m, 1, 1).select("model", F.array_join("faults", ",").alias("faults"))


#: A user's own correlation function; its derivative is taken by differences.
MATERN = Correlation(lambda h, theta: (1 + theta * h) * np.exp(-theta * h))


def user_correlation_fit(spark, d):
    """Every nation's model with spatially correlated errors under a user's correlation function."""
    return spatial_models.fit_models(base._nation_models(spark, d), base.places(spark, d), base.EM_TOL, base.EM_MOST, MATERN)


def conditional_fit(spark, d):
    """Fit of all nations' models by conditional steps on the observed likelihood."""
    p = base.model_panel(spark, d).select("model", "loc", "t", "z", "x")
    return statespace.fit_on_sums(p, statespace.start_values(p), base.EM_TOL, base.EM_MOST, accelerate=True, conditional=True)


#: Strengths and kinds of penalties that the fits below go through.
SETTINGS = [penalised_fit.Settings(alpha=a, lam=s, by=by) for a, s, by in ((0.0, 0.0, "common"), (0.0, 0.1, "common"), (0.0, 0.1, "size"), (0.5, 0.05, "common"), (1.0, 0.2, "common"), (1.0, 0.2, "size"))]


def penalised_step(spark, d):
    """One EM step of all nations' models from fixed parameters, without a penalty, with a ridge, and with one by size."""
    p = base.model_panel(spark, d).withColumn("one", F.lit(1.0))
    start = base.models(spark, d).withColumn("beta", F.array("b0", "b1"))
    f = penalised_fit.fit(p, "z", ["one", "x"], SETTINGS[:3], start, steps=1)
    return f.select("model", "setting", F.round("lam_used", 6).alias("lam_used"), "locations", "cells", F.round(F.col("beta")[0], 5).alias("b0"), F.round(F.col("beta")[1], 5).alias("b1"), *[F.round(c, 5).alias(c) for c in ("df", "v", "g", "w", "m0")], F.round("merit", 3).alias("merit"))


DESIGN = ["one", "x", "year"]


def _penalised(spark, d):
    p = base.model_panel(spark, d).withColumns({"one": F.lit(1.0), "year": F.col("t") / 12.0})
    return penalised_fit.fit(p, "z", DESIGN, SETTINGS)


def penalised_fits(spark, d):
    """EM of every nation's model under six penalties; fell counts steps that lowered the penalised likelihood."""
    return _penalised(spark, d).drop("t", "state")


def penalty_path(spark, d):
    """The six penalties over all models, and the one with the least BIC."""
    return penalised_fit.path(_penalised(spark, d))


def _cases(spark, d):
    p = base.places(spark, d)
    pairs = spatial.nearest(p, p, 1).select(F.col("i").alias("loc"), F.col("j").alias("other"))
    return design.case_frame(base.grid(spark, d), pairs, LAGS)


def case_frame(spark, d):
    return _cases(spark, d)


def lag_design(spark, d):
    return design.lag_design(_cases(spark, d), LAGS)


def _tests(spark, d):
    return leastsquares.block_tests(design.lag_design(_cases(spark, d), 1), "loc", "y", ["own_1", "nb_1"], {"nb": ["nb_1"]})


def station_tests(spark, d):
    return _tests(spark, d).select("loc", "block", "restrictions", "cells", "rank", F.round("f", 4).alias("f"), F.round("robust", 4).alias("robust"))


def causality_summary(spark, d):
    return design.mean_wald(_tests(spark, d)).select("block", "groups", "restrictions", F.round("z_f", 4).alias("z_f"), F.round("z_robust", 4).alias("z_robust"))


#: Hypotheses on four lags of the own and of the neighbour's series, and on the neighbour's later lags.
BLOCKS = {"own": [f"own_{k}" for k in range(1, LAGS + 1)], "nb": [f"nb_{k}" for k in range(1, LAGS + 1)], "nb_late": ["nb_3", "nb_4"], "both_late": ["own_3", "own_4", "nb_3", "nb_4"]}


def _lag_tests(spark, d):
    return leastsquares.block_tests(design.lag_design(_cases(spark, d), LAGS), "loc", "y", BLOCKS["own"] + BLOCKS["nb"], BLOCKS)


def lag_tests(spark, d):
    """F statistic of four blocks of lags for every location."""
    return _lag_tests(spark, d).select("loc", "block", "restrictions", "cells", "rank", F.round("f", 4).alias("f"))


def lag_causality(spark, d):
    """The mean statistic of each block over the locations."""
    return design.mean_wald(_lag_tests(spark, d)).select("block", "groups", "restrictions", F.round("z_f", 4).alias("z_f"))


def unit_root_tests(spark, d):
    """Augmented Dickey-Fuller test of every location's series."""
    return leastsquares.unit_root(base.grid(spark, d), "z").select("loc", "n", "lags", F.round("t", 4).alias("t"), "reject")


def stacked_tests(spark, d):
    """Joint tests of two blocks of coefficients by group, and of all groups at once, around the mean of the draws."""
    c = _coefficients(spark, d)
    est = c.groupBy("g", "parameter").agg(F.avg("value").alias("value"))
    asked = spark.createDataFrame([("nb", "nb_1"), ("nb", "nb_2"), ("own", "own_1"), ("own", "own_2"), ("all_four", "nb_1"), ("all_four", "nb_2"), ("all_four", "own_1"), ("all_four", "own_2")], "block string, parameter string")
    return leastsquares.stacked_wald(est, c, asked).select("block", "regime", "q", F.round(F.log("statistic"), 2).alias("log_statistic"), "used")


def partial_autocorrelations(spark, d):
    r = design.partial_autocorrelations(design.autocorrelations(base.grid(spark, d), "z", 3))
    return r.select("loc", "n", *[F.round(F.col("pacf")[i], 5).alias(f"p{i + 1}") for i in range(3)], F.col("order").alias("ar_order"))


def unchanged_share(spark, d):
    g = base.grid(spark, d).withColumn("z", F.round("z", 0))
    return design.unchanged_share(g, "z").select("loc", F.round("unchanged", 6).alias("unchanged"))


def _coefficients(spark, d):
    """Draws of four coefficients by group: means of discount and tax in buckets of orders."""
    li = base._t(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("b"), (F.col("l_suppkey") % 4).alias("g")).agg(*[F.round(F.avg(c), 6).alias(n) for c, n in (("l_discount", "nb_1"), ("l_tax", "nb_2"))], F.round(F.avg("l_quantity") / 100, 6).alias("own_1"), F.round(F.avg("l_linenumber") / 50, 6).alias("own_2"))
    return li.select("b", "g", F.expr("stack(4, 'nb_1', nb_1, 'nb_2', nb_2, 'own_1', own_1, 'own_2', own_2) AS (parameter, value)"))


def long_run_multipliers(spark, d):
    parts = spark.createDataFrame([("nb_1", "nb"), ("nb_2", "nb"), ("own_1", "own"), ("own_2", "own")], "parameter string, part string")
    r = design.long_run(_coefficients(spark, d), parts)
    return r.select("g", *[F.round(c, 6).alias(c) for c in ("lrm_lo", "lrm_up", "own")], "draws")


def named_parameters(spark, d):
    """Means of the draws by the covariate that a parameter's name stands for."""
    names = spark.createDataFrame([("nb_1", "neighbour, lag 1"), ("nb_2", "neighbour, lag 2"), ("own_1", "own, lag 1")], "parameter string, covariate string")
    c = _coefficients(spark, d).join(F.broadcast(names), "parameter", "left").withColumn("covariate", F.coalesce("covariate", "parameter"))
    return c.groupBy("g", "covariate").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


def stacked_cells(spark, d):
    """A matrix stacked by location, taken apart again."""
    g = base.grid(spark, d)
    n = g.agg(F.max("t") + 1).first()[0]
    low = g.agg(F.min("loc")).first()[0]
    rows = g.select(((F.col("loc") - low) * n + F.col("t")).alias("row"), "x")
    return design.unstacked(rows, n)


def kernel_columns(spark, d):
    """Correlation of neighbouring places, with nugget, and its derivatives by the logs of decay and nugget."""
    p = base.places(spark, d)
    theta, nugget = F.lit(2.0), F.lit(0.4)
    e = spatial.nearest(p, p, base.NEIGHBOURS).select("i", "j", "h").unionByName(p.select(F.col("loc").alias("i"), F.col("loc").alias("j"), F.lit(0.0).alias("h")))
    k = F.exp(-theta * F.col("h"))
    same = F.when(F.col("i") == F.col("j"), nugget).otherwise(0.0)
    first = -theta * F.col("h") * k
    cols = {"corr": k + same, "plain": F.when(F.col("i") == F.col("j"), 1 + nugget).otherwise(0.0), "d1": first, "d2": first * (1 - theta * F.col("h")), "db": same}
    return e.select("i", "j", *[(F.round(c, 6) + 0.0).alias(n) for n, c in cols.items()])


def _states(spark, d):
    return statespace.smoothed(statespace.filtered(statespace.step_sums(base.model_panel(spark, d), base.models(spark, d))))


def _scores(spark, d):
    return partitions.location_scores(base.grid(spark, d), base.models(spark, d), _states(spark, d))


def location_scores(spark, d):
    """Log-likelihood of every location under every nation's model, with its state."""
    return _scores(spark, d).select("loc", "model", F.round("ll", 3).alias("ll"))


def penalised_objective(spark, d):
    s = _scores(spark, d)
    p = base.places(spark, d)
    edges = spatial.neighbour_graph(p, base.NEIGHBOURS)
    n = base._t(spark, d, "nation").select(F.col("n_name").alias("model"), F.col("n_nationkey").alias("g"))
    scores = s.join(F.broadcast(n), "model").select("loc", "g", "ll")
    scale = partitions.penalty_scale(scores, edges)
    o = partitions.objective(scores, p.select("loc", F.col("nation").alias("g")), edges, 0.0)
    return o.join(scale).select(F.round(F.col("fit") + 0.05 * F.col("scale") * F.col("agreeing"), 2).alias("objective"), F.round("fit", 2).alias("fit"), "agreeing", F.round("scale", 3).alias("scale"))


def regime_completion(spark, d):
    """Fit and completion by regime; a regime without parameters gives no fit."""
    m = base.models(spark, d).where("b0 + v <> 131")
    p = base.model_panel(spark, d)
    s = p.join(F.broadcast(m.select("model", "b0", "b1")), "model", "left").join(_states(spark, d).select("model", "t", "m"), ["model", "t"], "left")
    fit = F.round(F.col("b0") + F.col("b1") * F.col("x") + F.col("m"), 5)
    return s.select("model", "loc", "t", fit.alias("fit"), F.coalesce("z", fit).alias("filled"))


def inherited_regimes(spark, d):
    """Suppliers with a negative balance take the nation of the nearest one without."""
    p = base.places(spark, d).join(base._t(spark, d, "supplier").select(F.col("s_suppkey").alias("loc"), "s_acctbal"), "loc")
    kept = p.where("s_acctbal >= 0").select("loc", "x", "y", F.col("nation").alias("g"))
    return partitions.inherited(p.where("s_acctbal < 0").select("loc", "x", "y"), kept)


def parameter_counts(spark, d):
    """Parameters by number of covariates, states and diagonal matrices, and degrees of freedom of grids."""
    o = base._t(spark, d, "orders").select((F.col("o_custkey") % 4 + 1).alias("ncov"), (F.col("o_orderkey") % 3 + 1).alias("p"), (F.col("o_orderstatus") == "F").alias("diag")).distinct()
    return o.select("ncov", "p", "diag", penalty.parameter_count(F.col("ncov"), F.col("p"), F.col("diag"), F.lit(True)).cast("double").alias("npar"))


def aligned_labels(spark, d):
    """Refit labels of suppliers in ten draws against their reference labels."""
    e = base._t(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 10).alias("b"), F.col("l_suppkey").alias("loc")).agg((F.count(F.lit(1)) % 3 + 1).cast("int").alias("g"))
    ref = base._t(spark, d, "supplier").select(F.col("s_suppkey").alias("loc"), (F.col("s_nationkey") % 3 + 1).cast("int").alias("h"))
    return partitions.aligned(ref, e, 3)


def _replications(spark, d):
    """A grid of (k, phi) for each replication: customers' orders by priority and size of price."""
    o = base._t(spark, d, "orders").select((F.col("o_custkey") % 300).alias("rep"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("k"), ((F.col("o_orderkey") / 4).cast("long") % 5 * 0.05).alias("phi"), "o_totalprice")
    g = o.groupBy("rep", "k", "phi").agg(F.round(-F.avg("o_totalprice") / 1000, 3).alias("loglik"), F.count(F.lit(1)).alias("n"))
    g = g.select("rep", "k", F.when(F.col("k") == 1, 0.0).otherwise(F.col("phi")).alias("phi"), "loglik", (F.col("k") * 6.0).alias("df"), F.lit(4000.0).alias("nobs"), F.lit(100.0).alias("d"), (F.col("n") % 7 != 0).alias("admissible"))
    one = W.Window.partitionBy("rep", "k", "phi").orderBy("loglik")
    return g.withColumn("r", F.row_number().over(one)).where("r = 1").drop("r")


def extended_criteria(spark, d):
    r = inference.all_criteria(_replications(spark, d))
    return r.select("rep", "k", F.round("phi", 4).alias("phi"), *[F.round(c, 4).alias(c) for c in inference.CRITERIA])


def selection_by_criteria(spark, d):
    """The two-step rule for every replication and each of seven criteria, in one plan."""
    r = inference.select_each(inference.all_criteria(_replications(spark, d)), ["rep"], 0.025, 0.2)
    return r.select("rep", "criterion", "k", F.round("phi", 4).alias("phi"))


def recovery_metrics(spark, d):
    """Rates of right, smaller and larger k by criterion against the true k of a replication."""
    s = inference.select_each(inference.all_criteria(_replications(spark, d)), ["rep"], 0.025, 0.2).withColumn("k_true", (F.col("rep") % 3 + 1).cast("int"))
    right = (F.col("k") == F.col("k_true")).cast("double")
    r = s.groupBy("criterion", "k_true").agg(F.count(F.lit(1)).alias("m"), F.avg(right).alias("k_ok"), (F.stddev_samp(right) / F.sqrt(F.count(F.lit(1)))).alias("k_ok_se"), F.avg((F.col("k") < F.col("k_true")).cast("double")).alias("k_under"), F.avg((F.col("k") > F.col("k_true")).cast("double")).alias("k_over"))
    return r.select("criterion", "k_true", "m", *[F.round(c, 6).alias(c) for c in ("k_ok", "k_ok_se", "k_under", "k_over")])


def design_cells(spark, d):
    """Cells of a factorial design: blocks put together, each cell once, those that can't be left out, with a key."""
    v = lambda name, kind, *x: spark.createDataFrame([(a,) for a in x], f"{name} {kind}")
    full = v("n", "int", 40, 100, 200).crossJoin(v("steps", "int", 60, 120)).crossJoin(v("omega", "double", 0.0, 0.7, 1.0)).withColumn("knn", F.lit(5))
    wide = v("n", "int", 40, 100, 400).withColumn("steps", F.lit(120)).withColumn("omega", F.lit(0.7)).crossJoin(v("knn", "int", 3, 5, 10))
    cells = full.unionByName(wide).dropDuplicates(["n", "steps", "omega", "knn"]).where("n * 0.2 >= 2 * knn")
    return cells.withColumn("cell", F.format_string("n%d_T%d_w%.2f_k%d", "n", "steps", "omega", "knn")).withColumn("seed", F.col("n") * 1000 + F.col("steps") * 10 + F.col("knn"))


def ordered_models(spark, d):
    """The ten smallest models, in the order of their region, with their place."""
    n = base._t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    r = spark.createDataFrame([(3, 1), (0, 2), (4, 3), (1, 4), (2, 5)], "n_regionkey int, place int")
    m = n.join(base._t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey").orderBy("n", "n_name").limit(10)
    return m.join(F.broadcast(r), "n_regionkey").select("n_name", "n", "place", F.row_number().over(W.Window.orderBy("place", "n", "n_name")).alias("nr"))


def cv_folds(spark, d):
    """Blanked and scored cells of each scheme's folds."""
    return inference.scheme_folds(base.grid(spark, d), base.FOLDS).groupBy("scheme", "fold").agg(F.sum(F.col("blank").cast("long")).alias("blank"), F.sum(F.col("score").cast("long")).alias("score"))


def cross_validation(spark, d):
    """Errors of the pooled model on the cells that each scheme's folds blank, all folds in the same jobs."""
    return inference.cross_validated(base.grid(spark, d), base.FOLDS, base.EM_TOL, base.EM_MOST)


def series(spark, d):
    """Two nations' series in the order of location and step, with running numbers."""
    p = base.model_panel(spark, d).where("model IN ('NATION_1', 'NATION_2')")
    return p.select("model", "loc", "t", "z", F.dense_rank().over(W.Window.partitionBy("model").orderBy("loc")).alias("nr"), F.row_number().over(W.Window.partitionBy("model", "loc").orderBy("t")).alias("row"))


QUERIES = {
    f.__name__: f
    for f in (
        ridge_fit, elastic_net, soft_threshold, em_iteration, augmented_filter, two_state_filter, two_state_smoother, two_state_em_step, two_state_fit, parameter_checks, user_correlation_fit, conditional_fit, penalised_step, penalised_fits, penalty_path, case_frame, lag_design, station_tests, causality_summary, lag_tests, lag_causality, unit_root_tests, stacked_tests, partial_autocorrelations, unchanged_share, long_run_multipliers,
        named_parameters, stacked_cells, kernel_columns, location_scores, penalised_objective, regime_completion, inherited_regimes, parameter_counts, aligned_labels, extended_criteria,
        selection_by_criteria, recovery_metrics, design_cells, ordered_models, cv_folds, cross_validation, series,
    )
}
