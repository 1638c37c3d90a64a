import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.functions import distributions
from panelmill.operators import inference, panel, spatial, statespace
from panelmill.plans import spatial_models
from panelmill.sources import store
from panelmill.streaming.forward_filter import filter_stream


def test_validation(spark):
    good = spark.createDataFrame([(1, 1, 1.0, 0.1), (1, 2, None, 0.2), (2, 1, 2.0, 0.3), (2, 2, 1.0, 0.4)], "loc long, t int, z double, x double")
    assert panel.validate(good, ["x"]) is good
    with pytest.raises(ValueError, match="never observed"):
        panel.validate(good.withColumn("z", F.when(F.col("loc") == 1, F.col("z") * None).otherwise(F.col("z"))), [])
    with pytest.raises(ValueError, match="entirely"):
        panel.validate(good.withColumn("z", F.lit(None).cast("double")), [])
    with pytest.raises(ValueError, match="covariates"):
        panel.validate(good.withColumn("x", F.lit(None).cast("double")), ["x"])
    with pytest.raises(TypeError):
        panel.validate(good.withColumn("x", F.lit("a")), ["x"])
    with pytest.raises(ValueError, match="repeated"):
        panel.validate(good.union(good), [])


def test_observed_index(spark):
    p = spark.createDataFrame([(l, t, v) for t, row in enumerate([(1.0, 2.0, 3.0), (1.0, None, 2.0), (None, None, None), (None, 4.0, 5.0)]) for l, v in enumerate(row)], "loc int, t int, z double")
    got = {r.t: (r.n_obs, r.pattern) for r in panel.observed_index(p).collect()}
    assert got[0] == (3, None) and got[2] == (0, "p") and got[1][0] == got[3][0] == 2 and got[1][1] != got[3][1]


def test_nearest_matches_all_pairs(spark):
    rng = np.random.default_rng(1)
    xy = np.vstack((rng.normal(size=(150, 2)), 50 + rng.normal(size=(5, 2)), np.zeros((3, 2))))
    places = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "loc int, x double, y double")
    h = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    want = {(i, j) for i in range(len(xy)) for j in sorted((j for j in range(len(xy)) if j != i), key=lambda j: (h[i, j], j))[:4]}
    assert {(r.i, r.j) for r in spatial.nearest(places, places, 4).collect()} == want
    edges = {(r.i, r.j) for r in spatial.neighbour_graph(places, 4).collect()}
    assert edges == want | {(j, i) for i, j in want}
    with pytest.raises(ValueError):
        spatial.neighbour_graph(places, 158)


@pytest.mark.parametrize(("a", "b", "want"), [((1, 1, 2, 2, 3, 3), (1, 1, 2, 2, 3, 3), 1.0), ((1, 1, 2, 2, 3, 3), (3, 3, 1, 1, 2, 2), 1.0), ((1,), (1,), None), ((1, 1, 1), (2, 2, 2), 1.0)])
def test_adjusted_rand(spark, a, b, want):
    assert inference.adjusted_rand(spark.createDataFrame(list(zip(a, b)), "a int, b int")).first().ari == want


def test_bins_are_right_closed(spark):
    got = spark.createDataFrame([(0.0,), (0.5,), (0.51,), (2.0,), (2.1,)], "x double").select(inference.bins(F.col("x"), [0, 0.5, 1, 2]).alias("b")).collect()
    assert [r.b for r in got] == [None, 1, 2, 3, None]


def test_distributions(spark):
    r = spark.createDataFrame([(1.959963984540054, 3.841458820694124, 1.0)], "z double, c double, k double").select(distributions.normal_cdf("z").alias("p"), distributions.normal_quantile(F.lit(0.975)).alias("q"), distributions.chi2_sf(F.col("c"), F.col("k")).alias("s")).first()
    assert math.isclose(r.p, 0.975, abs_tol=1e-12) and math.isclose(r.q, 1.959963984540054, abs_tol=1e-9) and math.isclose(r.s, 0.05, abs_tol=1e-9)


def test_geodesic(spark):
    # Flinders Peak to Buninyong, the usual example of the inverse problem: 54972.271 m
    row = spark.createDataFrame([(144.42486788888888, -37.95103341666667, 143.92649552777777, -37.65282113888889)], "a double, b double, c double, d double")
    r = row.select(distributions.geodesic_m(*map(F.col, "abcd")).alias("m"), distributions.haversine_m(*map(F.col, "abcd")).alias("h")).first()
    assert abs(r.m - 54972.271) < 0.3 and abs(r.h / r.m - 1) < 0.005


def dense_loglik(z, x, h, p):
    """Log density of all observed cells at once, from their full covariance."""
    n, d = z.shape
    var = np.zeros(n + 1)
    var[0] = p["c0"]
    for t in range(n):
        var[t + 1] = p["g"] ** 2 * var[t] + p["q"]
    state = np.array([[p["g"] ** abs(s - t) * var[min(s, t) + 1] for s in range(n)] for t in range(n)])
    full = np.kron(state, np.ones((d, d))) + np.kron(np.eye(n), spatial_models.covariance(h, p))
    mean = (p["b0"] + p["b1"] * x + np.array([p["g"] ** (t + 1) * p["m0"] for t in range(n)])[:, None]).ravel()
    seen = ~np.isnan(z.ravel())
    e, s = z.ravel()[seen] - mean[seen], full[np.ix_(seen, seen)]
    return -0.5 * (seen.sum() * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + e @ np.linalg.solve(s, e))


def simulated(seed=3, n=14, d=5):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(size=(d, 2))
    h = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    p = {"b0": 1.0, "b1": 0.5, "v": 0.2, "w": 0.3, "theta": 2.0, "g": 0.7, "q": 0.3, "m0": 0.2, "c0": 0.5}
    x, y = rng.normal(size=(n, d)), rng.normal()
    z = np.empty((n, d))
    for t in range(n):
        y = p["g"] * y + np.sqrt(p["q"]) * rng.normal()
        z[t] = p["b0"] + p["b1"] * x[t] + y + np.linalg.cholesky(spatial_models.covariance(h, p)) @ rng.normal(size=d)
    z[rng.uniform(size=z.shape) < 0.15] = np.nan
    z[4] = np.nan
    return z, x, h, xy, p


def test_filter_against_dense_density():
    z, x, h, _, p = simulated()
    got = spatial_models.smooth(z - p["b0"] - p["b1"] * x, spatial_models.covariance(h, p), p)["loglik"]
    assert math.isclose(got, dense_loglik(z, x, h, p), rel_tol=1e-9)


def test_em_never_lowers_the_likelihood():
    z, x, h, _, _ = simulated(n=30)
    p, last = spatial_models.start(z, x, h), -np.inf
    for _ in range(8):
        q, ll, _ = spatial_models.em(z, x, h, p, 0.0, 1)
        assert ll >= last - 1e-6
        p, last = q, ll


def as_frames(spark, z, x, xy, model="a"):
    cells = [(model, i, t, None if np.isnan(z[t, i]) else float(z[t, i]), float(x[t, i])) for t in range(len(z)) for i in range(z.shape[1])]
    return spark.createDataFrame(cells, "model string, loc long, t int, z double, x double"), spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "loc long, x double, y double")


def test_spatial_jobs(spark):
    z, x, h, xy, _ = simulated(n=30)
    cells, places = as_frames(spark, z, x, xy)
    both = cells.union(cells.withColumn("model", F.lit("b")))
    fits = store.cut_lineage(spatial_models.fit_models(both, places, 0.1, 10))
    assert {r.model for r in fits.collect()} == {"a", "b"} and len({round(r.loglik, 6) for r in fits.collect()}) == 1
    filled = spatial_models.complete(both, places, fits).toPandas()
    assert filled["filled"].notna().all() and len(filled) == 2 * z.size
    draws = spatial_models.bootstrap(cells, places, fits.where("model = 'a'"), 2, most=2)
    assert draws.count() == 2 and sorted(map(str, draws.collect())) == sorted(map(str, draws.repartition(3).collect()))
    at = spatial_models.krige(both, places, fits, places.where("loc = 0").withColumn("cov", F.lit(0.1)), 10).toPandas()
    assert len(at) == 2 and (at["se"] >= 0).all()


def test_fold_filter_and_em_against_numpy(spark):
    z, x, h, xy, p = simulated(n=20)
    p = {**p, "w": 0.0, "theta": 1.0}
    cells, _ = as_frames(spark, z, x, xy)
    models = spark.createDataFrame([("a", p["b0"], p["b1"], p["v"], p["g"], p["q"], p["m0"], p["c0"])], "model string, b0 double, b1 double, v double, g double, w double, m0 double, c0 double")
    want = spatial_models.smooth(z - p["b0"] - p["b1"] * x, p["v"] * np.eye(len(h)), p)
    f = statespace.filtered(statespace.step_sums(cells, models))
    s = {r.t: (r.m, r.c) for r in statespace.smoothed(f).collect()}
    assert math.isclose(f.first().loglik, want["loglik"], rel_tol=1e-9)
    assert np.allclose([s[t][0] for t in range(20)], want["m"][1:]) and np.allclose([s[t][1] for t in range(20)], want["c"][1:])
    new, _ = statespace.em_step(cells, models)
    r = new.first()
    m, c, lag = want["m"], want["c"], want["lag"]
    assert math.isclose(r.g, (m[1:] * m[:-1] + lag).sum() / (m[:-1] ** 2 + c[:-1]).sum(), rel_tol=1e-8)
    assert math.isclose(r.m0, m[0], rel_tol=1e-8)
    _, trace = statespace.fit(cells, models, tol=1e-6, most=4)
    ll = [t.loglik for t in trace.orderBy("step").collect()]
    assert all(b >= a - 1e-7 for a, b in zip(ll, ll[1:]))


def test_stream_filter(spark, tmp_path):
    z, x, h, xy, p = simulated(n=12)
    cells, _ = as_frames(spark, z, x, xy)
    models = spark.createDataFrame([("a", p["b0"], p["b1"], p["v"], p["g"], p["q"], p["m0"], p["c0"])], "model string, b0 double, b1 double, v double, g double, w double, m0 double, c0 double")
    sums = statespace.step_sums(cells, models).select("model", F.col("t").cast("long").alias("t"), "n", "s", "q")
    for k, (lo, hi) in enumerate(((0, 5), (5, 12))):
        sums.where(f"t >= {lo} AND t < {hi}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(sums.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = filter_stream(stream, {"a": {"g": p["g"], "w": p["q"], "v": p["v"], "m0": p["m0"], "c0": p["c0"]}}).writeStream.format("memory").queryName("forward").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.t: r for r in spark.sql("SELECT * FROM forward").collect()}
    want = statespace.filtered(statespace.step_sums(cells, models)).first()
    assert math.isclose(got[11].loglik, want.loglik, rel_tol=1e-9) and all(math.isclose(got[s.t].m, s.m, rel_tol=1e-9) for s in want.path)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("NA", 1, None), ("b", 2, 0.5)], "city string, n int, v double")
    store.write_csv(df, f"{tmp_path}/x", gzip=True)
    back = store.read_csv(spark, f"{tmp_path}/x", df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    (tmp_path / "bad.csv").write_text("city,n,v\na,1,0.5\nb,x,0.1\n")
    assert [r.city for r in store.read_csv(spark, f"{tmp_path}/bad.csv", df.schema, strict=False).collect()] == ["a"]
    made = []
    make = lambda: made.append(1) or df
    assert store.computed_once(spark, f"file://{tmp_path}/once", make).count() == 2 and store.computed_once(spark, f"file://{tmp_path}/once", make).count() == 2 and len(made) == 1
    assert store.unfinished(df, df.where("n = 1"), ["n"]).count() == 1
    assert store.union_all([df, df.select("city")]).where("n IS NULL").count() == 2
    assert store.rename_legacy(df, {"n": "m", "v": "city"}).columns == ["city", "m", "v"]


def test_events_frame(spark):
    times = spark.createDataFrame(pd.DataFrame({"t": range(4), "day": pd.date_range("2024-01-07", periods=4, freq="7D").date}))
    ev = spark.createDataFrame([("e", "2024-01-08")], "event string, day string").withColumn("day", F.to_date("day"))
    assert sorted((r.t, r.first, r.second) for r in panel.pulses(times, ev).collect()) == [(1, 1, 0), (2, 0, 1)]
