"""Settings lead to the fit that they describe."""

import math

import pytest
from test_operators import as_frames, simulated

from panelmill.operators import penalised_fit, statespace
from panelmill.plans import fitting, spatial_models


@pytest.mark.parametrize("bad", [{"groups": 0}, {"phi": -1.0}, {"tol": 0.0}, {"groups": 2}, {"penalty": penalised_fit.Settings(lam=1.0)}, {"groups": 2, "spatial": False, "penalty": penalised_fit.Settings()}])
def test_settings_that_no_fit_has(bad):
    with pytest.raises(ValueError):
        fitting.Fit(**bad)


def test_pooled_fits(spark):
    cells, places = as_frames(spark, *[simulated(n=24)[i] for i in (0, 1, 3)])
    want = {
        "spatial": (fitting.Fit(), spatial_models.fit_models(cells, places, 1e-3, 500).first()),
        "sums": (fitting.Fit(spatial=False), statespace.fit_on_sums(cells, statespace.start_values(cells), accelerate=True).first()),
    }
    for settings, one in want.values():
        r = fitting.fit(cells, places, settings).first()
        assert math.isclose(r.loglik, one.loglik, rel_tol=1e-12) and all(math.isclose(v, one[c], rel_tol=1e-9) for c, v in r.estimates.items())
    free, held = (fitting.fit(cells, places, fitting.Fit(spatial=False, penalty=penalised_fit.Settings(lam=k))).first() for k in (0.0, 5.0))
    assert abs(held.estimates["b1"]) < abs(free.estimates["b1"]) and held.loglik < free.loglik


def test_groups(spark):
    z, x, _, xy, _ = simulated(n=16, d=12)
    z[:, :6] += 8
    r = fitting.fit(*as_frames(spark, z, x, xy), fitting.Fit(groups=2, spatial=False, neighbours=3, sweeps=2)).collect()
    assert {g.model for g in r} == {"1", "2"} and sorted(g.estimates["size"] for g in r) == [6, 6]
    assert abs(r[0].estimates["b0"] - r[1].estimates["b0"]) > 4
