"""Places: neighbours, nearest members of groups, neighbourhood counts.

Distances between all places are never formed.  Places are dealt into square cells, and a
search takes the cells around a place; those whose answer may lie outside search again
with cells of twice the width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.store import cut_lineage


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def _cells(width: float) -> tuple[Column, Column]:
    return F.floor(F.col("x") / width).alias("cx"), F.floor(F.col("y") / width).alias("cy")


def near(left: DataFrame, right: DataFrame, width: float, reach: int = 1) -> DataFrame:
    """Pairs (i, j, h) of left and right places whose cells are at most ``reach`` apart."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])
    mine = left.select(F.col("loc").alias("i"), "x", "y", *_cells(width)).withColumn("s", F.explode(steps))
    mine = mine.select("i", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy"))
    theirs = right.select(F.col("loc").alias("j"), *[c for c in right.columns if c not in ("loc", "x", "y")], F.col("x").alias("x2"), F.col("y").alias("y2"), *_cells(width))
    return mine.join(theirs, ["cx", "cy"]).withColumn("h", euclidean(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).drop("cx", "cy", "x1", "y1", "x2", "y2")


def nearest(left: DataFrame, right: DataFrame, k: int, width: float | None = None) -> DataFrame:
    """i, j, h, rank: the k nearest right places of every left place, itself left out; ties to smaller j."""
    left, right = left.select("loc", "x", "y"), right.select("loc", "x", "y")
    box = right.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    n = box[4]
    if not n:
        return near(left, right, 1.0).select("i", "j", "h", F.lit(1).alias("rank")).limit(0)
    span = max(box[1] - box[0], box[3] - box[2]) or 1.0
    width = width or span * max(1e-6, (k / n) ** 0.5)
    out, todo = None, left
    while True:
        order = W.Window.partitionBy("i").orderBy("h", "j")
        got = cut_lineage(near(todo, right, width).where("i != j").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        # within one cell around a place, everything up to ``width`` has been seen
        sure = got.groupBy("i").agg(F.count(F.lit(1)).alias("m"), F.max("h").alias("far")).where((F.col("m") == k) & (F.col("far") <= width))
        if width > span:
            done = got
        else:
            done = got.join(sure.select("i"), "i", "left_semi")
        out = done if out is None else out.unionByName(done)
        if width > span:
            return out.select("i", "j", "h", "rank")
        todo = cut_lineage(todo.join(sure.select(F.col("i").alias("loc")), "loc", "left_anti"))
        if todo.isEmpty():
            return out.select("i", "j", "h", "rank")
        width *= 4


def neighbour_graph(places: DataFrame, k: int) -> DataFrame:
    """i, j in both directions: j among the k nearest of i, or i among those of j."""
    d = places.count()
    if not 1 <= k < d:
        raise ValueError(f"k must be from 1 to {d - 1}")
    e = nearest(places, places, k).select("i", "j")
    return e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def agreeing_pairs(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs, agreeing: neighbouring pairs, and those in one group; labels(loc, g)."""
    a, b = labels.select(F.col("loc").alias("i"), F.col("g").alias("gi")), labels.select(F.col("loc").alias("j"), F.col("g").alias("gj"))
    e = edges.where("i < j").join(a, "i").join(b, "j")
    return e.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum((F.col("gi") == F.col("gj")).cast("long")), F.lit(0)).alias("agreeing"))


def nearest_of_group(places: DataFrame, group: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """loc, nearest, dist: of each place the nearest member of its own key's group; places whose
    key has no group are dropped.  The join is by key, so only one key's places meet."""
    g = group.select(key, F.col("loc").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = places.join(g, key).where("loc != j").withColumn("h", euclidean(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")))
    best = pairs.groupBy("loc").agg(F.min(F.struct("h", "j")).alias("b"))
    return best.select("loc", F.col("b.j").alias("nearest"), F.round("b.h", digits).alias("dist"))


def nearest_allowed(left: DataFrame, right: DataFrame, key: str, digits: int = 3, width: float | None = None) -> DataFrame:
    """key, loc, nearest, dist: of each left place the nearest right one with its key and another ``tag``; ties to the smaller.

    left and right(key, loc, x, y, tag): a null tag differs from every other, a place is not its own nearest, and a row
    without key or place, or without any allowed partner, has no row.  Only cells of one key meet, and a place whose
    nearest may lie outside searches again with wider cells, so that groups are never paired whole."""
    cols = [key, "loc", "x", "y", "tag"]
    todo, right = left.select(*cols).dropna(subset=cols[:4]).distinct(), right.select(*cols).dropna(subset=cols[:4]).distinct()
    box = right.unionByName(todo).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    n = right.count()
    span = 1.0 if box[0] is None else max(box[1] - box[0], box[3] - box[2]) or 1.0
    width, out = width or span * max(1e-6, (1 / max(n, 1)) ** 0.5), None
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    while True:
        mine = todo.select(key, F.col("loc").alias("i"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("tag").alias("mine"), *_cells(width), F.explode(steps).alias("s"))
        mine = mine.withColumns({"cx": F.col("cx") + F.col("s.a"), "cy": F.col("cy") + F.col("s.b")})
        theirs = right.select(key, F.col("loc").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), "tag", *_cells(width))
        allowed = (F.col("i") != F.col("j")) & F.coalesce(F.col("mine") != F.col("tag"), F.lit(True))
        met = mine.join(theirs, [key, "cx", "cy"]).where(allowed)
        got = cut_lineage(met.groupBy(key, "i").agg(F.min(F.struct(euclidean(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("h"), "j")).alias("b")).select(key, "i", "b.h", "b.j"))
        done = got if width > span else got.where(F.col("h") <= width)
        out = done if out is None else out.unionByName(done)
        if width <= span:
            todo = cut_lineage(todo.join(done.select(key, F.col("i").alias("loc")), [key, "loc"], "left_anti"))
        if width > span or todo.isEmpty():
            return out.select(key, F.col("i").alias("loc"), F.col("j").alias("nearest"), F.round("h", digits).alias("dist"))
        width *= 4


def decay_limits(pairs: DataFrame) -> DataFrame:
    """Log limits of the decay of exp(-theta h): from the largest and the smallest positive distance."""
    h = pairs.where("h > 0").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    return h.select(F.coalesce(F.log(-F.log(F.lit(0.95)) / F.col("hi")), F.lit(float("-inf"))).alias("lower"), F.coalesce(F.log(-F.log(F.lit(0.05)) / F.col("lo")), F.lit(float("inf"))).alias("upper"))
