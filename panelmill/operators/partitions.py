"""Partitions of locations: alignment, scores, objective and passes that improve labels.

Passes move many locations in one job, but only such as no neighbour of which moves in the
same round, so each round adds up its gains and the objective never falls.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.store import cut_lineage
from . import spatial


def aligned(reference: DataFrame, refits: DataFrame, k: int) -> DataFrame:
    """b, g, h: for each draw the reference label h of each refit label g, by decreasing overlap;
    ties in the order of h, then g; labels without overlap take what is left in order.
    reference(loc, h), refits(b, loc, g); a task sees at most k * k counts of a draw."""
    counts = refits.join(reference, "loc").groupBy("b", "g", "h").agg(F.count(F.lit(1)).alias("n"))

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        to: dict[int, int] = {}
        for g, h in d.sort_values(["n", "h", "g"], ascending=[False, True, True])[["g", "h"]].itertuples(index=False):
            if g not in to and h not in to.values():
                to[int(g)] = int(h)
        rest = [h for h in range(1, k + 1) if h not in to.values()]
        to |= dict(zip([g for g in range(1, k + 1) if g not in to], rest))
        return pd.DataFrame({"b": key[0], "g": list(to), "h": list(to.values())})

    return counts.groupBy("b").applyInPandas(run, "b long, g int, h int")


def location_scores(panel: DataFrame, models: DataFrame, states: DataFrame) -> DataFrame:
    """loc, model, ll: log-likelihood of each location's observed cells under each model, with its state;
    -inf without observed cells or without a positive variance."""
    m = models.select("model", "b0", "b1", "v").join(states.select("model", "t", F.col("m").alias("state")), "model")
    e = F.col("z") - F.col("b0") - F.col("b1") * F.col("x") - F.col("state")
    ll = F.sum(F.when(F.col("z").isNotNull(), -0.5 * (F.log(2 * F.pi() * F.col("v")) + e * e / F.col("v"))))
    s = panel.join(m, "t").groupBy("loc", "model").agg(ll.alias("ll"))
    low = F.lit(float("-inf"))
    return s.select("loc", "model", F.when(F.col("ll").isNull() | F.isnan("ll"), low).otherwise(F.col("ll")).alias("ll"))


def penalty_scale(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """scale: the median over locations of the spread of their finite scores (of two at least) by the
    mean number of neighbours; 1 if that is no positive number."""
    finite = scores.where((F.col("ll") > float("-inf")) & (F.col("ll") < float("inf")))
    spread = finite.groupBy("loc").agg((F.max("ll") - F.min("ll")).alias("s"), F.count(F.lit(1)).alias("n")).where("n >= 2").agg(F.median("s").alias("s"))
    degree = edges.groupBy("i").agg(F.count(F.lit(1)).alias("n")).agg(F.greatest(F.avg("n"), F.lit(1.0)).alias("degree"))
    ratio = F.col("s") / F.col("degree")
    return spread.join(degree).select(F.when((ratio > 0) & (ratio < float("inf")), ratio).otherwise(1.0).alias("scale"))


def objective(scores: DataFrame, labels: DataFrame, edges: DataFrame, weight: float) -> DataFrame:
    """objective, fit, agreeing: the sum of the locations' scores under their labels plus weight times
    the agreeing neighbour pairs; labels(loc, g), scores(loc, g, ll)."""
    fit = labels.join(scores, ["loc", "g"]).agg(F.sum("ll").alias("fit"))
    return fit.join(spatial.agreeing_pairs(edges, labels)).select((F.col("fit") + weight * F.col("agreeing")).alias("objective"), "fit", "agreeing")


def repaired(labels: DataFrame, scores: DataFrame, k: int, least: int) -> DataFrame:
    """labels with at least ``least`` locations in each of the groups 1 .. k: while one is short, it takes
    the locations that lose least, from groups that can spare them."""
    if labels.count() < k * least:
        raise ValueError(f"{k} groups of {least} need more locations")
    labels = cut_lineage(labels)
    for short in range(1, k + 1):
        sizes = {r["g"]: r["count"] for r in labels.groupBy("g").count().collect()}  # a row for each group
        need = least - sizes.get(short, 0)
        if need <= 0:
            continue
        loss = labels.where(F.col("g") != short).join(scores, ["loc", "g"]).join(scores.where(F.col("g") == short).select("loc", F.col("ll").alias("to")), "loc")
        spare = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, max(0, n - least))])
        ranked = loss.withColumn("r", F.row_number().over(W.Window.partitionBy("g").orderBy(F.desc(F.col("to") - F.col("ll")), "loc"))).where(F.col("r") <= F.element_at(spare, F.col("g")))
        moved = ranked.orderBy(F.desc(F.col("to") - F.col("ll")), "loc").limit(need).select("loc", F.lit(short).alias("new"))
        labels = cut_lineage(labels.join(moved, "loc", "left").select("loc", F.coalesce("new", "g").alias("g")))
    return labels


def _values(scores: DataFrame, labels: DataFrame, edges: DataFrame, weight: float) -> DataFrame:
    """loc, g, value: a location's score in each group plus weight times its neighbours there."""
    agree = edges.join(labels.withColumnRenamed("loc", "j"), "j").groupBy(F.col("i").alias("loc"), "g").agg(F.count(F.lit(1)).alias("n"))
    return scores.join(agree, ["loc", "g"], "left").select("loc", "g", (F.col("ll") + weight * F.coalesce("n", F.lit(0))).alias("value"))


def sweep(labels: DataFrame, scores: DataFrame, edges: DataFrame, weight: float, least: int = 1, rounds: int = 50) -> tuple[DataFrame, int]:
    """(labels, moves): each location goes to its best group, ties to the smaller, until none gains.

    Of the locations that gain, those move that gain most among their neighbours, and from a
    group only as many as it has beyond ``least``.  The objective never falls."""
    labels, moves = cut_lineage(labels), 0
    for _ in range(rounds):
        value = _values(scores, labels, edges, weight)
        own = labels.join(value, ["loc", "g"]).select("loc", F.col("g").alias("old"), F.col("value").alias("now"))
        best = value.groupBy("loc").agg(F.max(F.struct("value", (-F.col("g")).alias("g"))).alias("b"))
        want = own.join(best, "loc").select("loc", "old", (-F.col("b.g")).alias("new"), (F.col("b.value") - F.col("now")).alias("gain")).where("gain > 1e-9 AND new <> old")
        rank = F.struct("gain", (-F.col("loc")).alias("o"))
        near = edges.join(want.select(F.col("loc").alias("j"), rank.alias("theirs")), "j").groupBy(F.col("i").alias("loc")).agg(F.max("theirs").alias("theirs"))
        free = want.join(near, "loc", "left").where(F.col("theirs").isNull() | (rank > F.col("theirs")))
        sizes = labels.groupBy(F.col("g").alias("old")).agg(F.count(F.lit(1)).alias("size"))
        nth = F.row_number().over(W.Window.partitionBy("old").orderBy(F.desc("gain"), "loc"))
        go = cut_lineage(free.withColumn("nth", nth).join(sizes, "old").where(F.col("nth") <= F.col("size") - least).select("loc", "new"))
        n = go.count()
        if not n:
            break
        moves += n
        labels = cut_lineage(labels.join(go, "loc", "left").select("loc", F.coalesce("new", "g").alias("g")))
    return labels, moves


def swaps(labels: DataFrame, scores: DataFrame, edges: DataFrame, weight: float, tol: float = 1e-8, rounds: int = 20) -> tuple[DataFrame, int]:
    """(labels, swaps): pairs of locations that exchange their groups while that raises the objective, so
    sizes stay.  The best swap is made in each round.  In each pair of groups the members that gain most by
    moving meet; neighbours that swap lose what they counted on each other.  As a location has at most
    ``most`` neighbours, its best partner is among the first ``most`` + 1 of the other group."""
    labels, done = cut_lineage(labels), 0
    most = edges.groupBy("i").count().agg(F.max("count")).first()[0] or 0
    for _ in range(rounds):
        value = cut_lineage(_values(scores, labels, edges, weight))
        own = labels.join(value, ["loc", "g"]).select("loc", F.col("g").alias("a"), F.col("value").alias("now"))
        gain = own.join(value.select("loc", F.col("g").alias("b"), "value"), "loc").where("a <> b").select("loc", "a", "b", (F.col("value") - F.col("now")).alias("gain"))
        top = gain.withColumn("r", F.row_number().over(W.Window.partitionBy("a", "b").orderBy(F.desc("gain"), "loc"))).where(F.col("r") <= most + 1)
        one = top.where("a < b").select(F.col("loc").alias("i"), "a", "b", F.col("gain").alias("gi"))
        two = top.where("a > b").select(F.col("loc").alias("j"), F.col("b").alias("a"), F.col("a").alias("b"), F.col("gain").alias("gj"))
        pairs = one.join(two, ["a", "b"]).join(edges.select("i", "j", F.lit(2.0 * weight).alias("lost")), ["i", "j"], "left")
        pairs = pairs.select("a", "b", "i", "j", (F.col("gi") + F.col("gj") - F.coalesce("lost", F.lit(0.0))).alias("up")).where(F.col("up") > tol)
        best = pairs.groupBy().agg(F.max(F.struct("up", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"), "a", "b")).alias("x")).where("x IS NOT NULL")
        go = cut_lineage(best.select(F.explode(F.array(F.struct((-F.col("x.i")).alias("loc"), F.col("x.b").alias("new")), F.struct((-F.col("x.j")).alias("loc"), F.col("x.a").alias("new")))).alias("m")).select("m.loc", "m.new"))
        if go.isEmpty():
            break
        done += 1
        labels = cut_lineage(labels.join(go, "loc", "left").select("loc", F.coalesce("new", "g").alias("g")))
    return labels, done


def inherited(new: DataFrame, kept: DataFrame) -> DataFrame:
    """loc, g of each new place: the label of the nearest kept place; ties to the smaller location."""
    near = spatial.nearest(new, kept, 1)
    return near.join(kept.select(F.col("loc").alias("j"), "g"), "j").select(F.col("i").alias("loc"), F.col("j").alias("nearest"), "g")
