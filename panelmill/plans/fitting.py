"""One way into every fit: settings say which model it is."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusterwise, kmeans, penalised_fit, statespace
from ..operators.covariances import EXPONENTIAL, Correlation
from ..sources.store import cut_lineage
from . import spatial_models


@dataclass(frozen=True)
class Fit:
    """``groups`` 1 fits every model of the panel as it is; more find that many groups of locations and a model for each.

    ``spatial``: errors of places correlate by ``correlation``; without it they are independent, and a model is fitted on
    sums of its cells by step.  ``penalty`` shrinks the coefficients of pooled models with independent errors.  ``phi`` is the
    weight of agreeing neighbours, ``neighbours`` their number, ``sweeps`` the most iterations over groups.  Settings that no fit has
    together are a ValueError."""

    groups: int = 1
    spatial: bool = True
    correlation: Correlation = field(default=EXPONENTIAL)
    penalty: penalised_fit.Settings | None = None
    phi: float = 0.05
    neighbours: int = 5
    sweeps: int = 50
    tol: float = 1e-3
    most: int = 500

    def __post_init__(self) -> None:
        if self.groups < 1 or self.neighbours < 1 or self.sweeps < 1 or self.most < 1:
            raise ValueError("groups, neighbours, sweeps and most are 1 or more")
        if not 0 <= self.phi < float("inf") or not self.tol > 0:
            raise ValueError("phi is a finite number, 0 or more, and tol above 0")
        if self.spatial and (self.groups > 1 or self.penalty is not None):
            raise ValueError("correlated errors go with pooled fits without a penalty: set spatial=False")
        if self.groups > 1 and self.penalty is not None:
            raise ValueError("a penalty goes with pooled fits")


def fit(panel: DataFrame, places: DataFrame, settings: Fit) -> DataFrame:
    """model, estimates map<name, value>, loglik, converged: panel(model, loc, t, z, x), places(loc, x, y).

    With groups, the panel's models are set aside, and model is the number of the group.  ``converged`` is null where the fit does
    not tell.  Cells without z are gaps; models without cells have no row, but with a penalty a row of nulls."""
    if settings.groups > 1:
        return _grouped(panel, places, settings)
    if settings.penalty is not None:
        rows = penalised_fit.fit(panel.withColumn("one", F.lit(1.0)), "z", ["one", "x"], [settings.penalty])
        rows = rows.withColumns({"b0": F.col("beta")[0], "b1": F.col("beta")[1]})
        return _told(rows, ("b0", "b1", "v", "g", "w", "m0", "df"), F.col("converged"))
    if settings.spatial:
        rows = spatial_models.fit_models(panel, places, settings.tol, settings.most, settings.correlation)
        return _told(rows, ("b0", "b1", "v", "w", "theta", "g", "q", "m0"), F.lit(None).cast("boolean"))
    rows = statespace.fit_on_sums(panel, statespace.start_values(panel), settings.tol, settings.most, accelerate=True)
    return _told(rows, ("b0", "b1", "v", "g", "w", "m0"), F.col("converged"))


def _told(rows: DataFrame, names: tuple[str, ...], converged) -> DataFrame:
    pairs = [p for c in names for p in (F.lit(c), F.col(c).cast("double"))]
    return rows.select(F.col("model").cast("string").alias("model"), F.create_map(*pairs).alias("estimates"), "loglik", converged.alias("converged"))


def _grouped(panel: DataFrame, places: DataFrame, settings: Fit) -> DataFrame:
    cells = cut_lineage(panel.select("loc", "t", "z", "x"))
    kept = cut_lineage(places.select("loc", "x", "y").join(cells.select("loc").distinct(), "loc", "left_semi"))
    edges, colours = clusterwise.neighbours(kept, settings.neighbours)
    features = cells.groupBy("loc").agg(F.avg("z").alias("level"), F.avg("x").alias("x_mean"), F.stddev_samp("z").alias("spread"))
    start = cut_lineage(kmeans.start_partition(features, ["level", "x_mean", "spread"], settings.groups))
    rows = cut_lineage(clusterwise.series(cells))
    labels, models, _, _ = clusterwise.alternating_fit(rows, edges, colours, [(1, settings.groups, settings.phi)], start.withColumn("config", F.lit(1).cast("long")), most=settings.sweeps, tol=settings.tol, em_most=settings.most)
    sizes = labels.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    return _told(models.join(sizes, "g").withColumn("model", F.col("g")), ("size", "b0", "b1", "v", "ar", "w", "m0"), F.col("converged"))
