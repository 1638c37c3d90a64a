import numpy as np
from pyspark.sql import functions as F

from panelmill.operators import inference
from panelmill.plans import regimes


def test_grid_recovers_two_regimes(spark):
    rng = np.random.default_rng(8)
    cells, places = [], []
    for i in range(16):
        g = i % 2
        places.append((i, float(10 * g + rng.uniform()), float(rng.uniform())))
        for t in range(16):
            x = rng.normal()
            cells.append((i, t, None if rng.uniform() < 0.05 else float((2 - 5 * g) + (1 - 2 * g) * x + 0.2 * rng.normal()), float(x)))
    panel = spark.createDataFrame(cells, "loc long, t int, z double, x double")
    table, labels, models = regimes.fit_grid(panel, spark.createDataFrame(places, "loc long, x double, y double"), [1, 2], [0.05], neighbours=3, sweeps=2, em_steps=1)
    rows = {r.k: r for r in inference.criteria(table).collect()}
    assert set(rows) == {1, 2} and rows[2].admissible and rows[2].bic < rows[1].bic
    got = labels.where("config = '2|0.05'").select(F.col("g").alias("a"), (F.col("loc") % 2).alias("b"))
    assert inference.adjusted_rand(got).first().ari == 1.0
    assert inference.select_model(inference.criteria(table), 0.0, 1.0).first().k == 2


def test_intervals_and_wald(spark):
    rng = np.random.default_rng(1)
    rows = [(b, 1, p, float(m + rng.normal()), m) for b in range(200) for p, m in (("u", 10.0), ("v", 0.0))]
    draws = spark.createDataFrame(rows, "b long, g long, parameter string, value double, est double")
    got = {r.parameter: r for r in inference.corrected_intervals(draws).collect()}
    assert got["u"].bc_lo < 10 < got["u"].bc_hi and got["u"].p < 1e-6 and got["v"].p > 0.9
    w = inference.wald(draws.select("g", "parameter", F.col("est").alias("value")).distinct(), draws).first()
    assert w.q == 2 and w.statistic > 60 and w.p_chisq < 1e-9 and w.p_boot < 0.01
