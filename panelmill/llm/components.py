"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_files, materialize


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root): root is the smallest node reachable from node.

    Links stay a distributed table; every round is two aggregations whose groups hold
    counts and smallest neighbours only, so a node with many links is pre-aggregated.
    Nodes without links are absent.
    """
    n = 2 * links.count()  # no later table has more rows
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:  # the number of rounds grows with the logarithm of the links
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        star = materialize(few_files(large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))), n), "star")
        near = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(near, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(few_files(small.unionByName(near.select("u", F.col("m").alias("v"))).distinct(), n), "links")
        # done when every node has one parent and no parent has a parent
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if nodes.where("up > 1 OR up = 1 AND down = 1").isEmpty():
            roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return materialize(few_files(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), n), "labels")
