"""Global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.store import cut_lineage

#: monotonically_increasing_id has the place within a partition in so many lower bits.
LOW = 33


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """rows with a number from 0 in the given order: rows are dealt by ranges and sorted within
    partitions; only the counts of the partitions meet in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = cut_lineage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftrightunsigned("_id", LOW)).withColumn("_place", F.col("_id").bitwiseAND((1 << LOW) - 1))
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_part", F.coalesce(F.sum("_n").over(W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before", "_id")
