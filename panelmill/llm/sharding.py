"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets its global number in the order of doc_id (ties by size, text checksum,
then any order; rows that tie there are equal).  A Feistel network over a rectangle a x b
with a * b >= N, the one with the least excess that is about square, permutes 0 .. a*b - 1; a
number outside 0 .. N - 1 is permuted again until it lies inside (cycle walking), which gives a
permutation of 0 .. N - 1.  A walk passes each outside number once at most, so the excess, a few
numbers, bounds its steps.  ``seed`` chooses the permutation.  A row with image y goes to shard y mod shards, slot
y div shards: shard counts differ by one at most, and both are computable from the row
number alone.

Only DataFrame functions are used.  Null texts have no bytes; a null doc_id sorts first;
an empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialize, partitions_of, text_or_empty

#: Rounds: multiplier, addend and second addend of the round function.
ROUNDS = (
    (1103515245, 12345, 374761393),
    (1664525, 1013904223, 668265263),
    (22695477, 1299709, 1274126177),
    (214013, 2531011, 1597334677),
    (1140671485, 12820163, 1442695041),
    (69069, 907133923, 1181783497),
)
PRIME = 2147483629


def rectangle(n: int) -> tuple[int, int]:
    """Sides of the rectangle with the least excess over n; ties to the squarest."""
    root = math.isqrt(max(n, 1))
    a = np.arange(max(1, root - root // 2), root + 1, dtype=np.int64)
    b = -(-max(n, 1) // a)
    k = np.lexsort((-a, a * b - n))[0]
    return int(a[k]), int(b[k])


def rounds(seed: int = 0) -> list[tuple[int, int, int]]:
    """Multiplier, addend and second addend of each round for a seed."""
    return [(m, (c + seed * 2654435761 * (i + 1)) % PRIME, (d + seed * 40503 * (i + 1)) % PRIME) for i, (m, c, d) in enumerate(ROUNDS)]


def permuted(number: Column, n: int, seed: int = 0) -> Column:
    """The image of a row number 0 .. n - 1 under the permutation of 0 .. n - 1."""
    a, b = rectangle(n)

    def once(v: Column) -> Column:
        state = F.struct((v % a).alias("l"), ((v - v % a) / a).cast("long").alias("r"))
        keys = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c"), F.lit(d).cast("long").alias("d"), F.lit(i % 2 == 0).alias("left")) for i, (m, c, d) in enumerate(rounds(seed))])

        def step(s: Column, k: Column) -> Column:
            x = F.when(k["left"], s["r"]).otherwise(s["l"])
            y = (x * k["m"] + k["c"]) % F.lit(PRIME)
            f = (y * y + k["d"]) % F.lit(PRIME)
            return F.struct(
                F.when(k["left"], (s["l"] + f) % a).otherwise(s["l"]).alias("l"),
                F.when(k["left"], s["r"]).otherwise((s["r"] + f) % b).alias("r"),
            )

        return F.aggregate(keys, state, step, lambda s: s["r"] * a + s["l"])

    if a * b == n:
        return once(number)
    return F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), once(number), lambda v, _: F.when(v < n, v).otherwise(once(v)))


def numbered(rows: DataFrame, order: list[str], n_parts: int) -> tuple[DataFrame, int]:
    """rows with a global number 0 .. N - 1 in the given order, and N.

    Rows are range-partitioned and sorted within partitions, and the number is the place
    in the partition plus the rows of the partitions before.  Only the counts of the
    partitions meet in one task.  The table is written once, so the numbers are fixed.
    """
    low = 33  # monotonically_increasing_id has the place in its lower 33 bits
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = tied.repartitionByRange(n_parts, *order, "_tie").sortWithinPartitions(*order, "_tie").withColumn("_id", F.monotonically_increasing_id()).drop("_tie")
    placed = materialize(placed, "placed").withColumn("_part", F.shiftrightunsigned("_id", low)).withColumn("_place", F.col("_id").bitwiseAND((1 << low) - 1))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    joined = placed.join(F.broadcast(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part")
    return joined.withColumn("row_number", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before", "_id"), total


def shard(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number."""
    body = text_or_empty().cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows, n = numbered(rows, ["doc_id", "size", "text_crc32"], partitions_of(docs.sparkSession))
    image = rows.withColumn("image", permuted(F.col("row_number"), n, seed))
    return image.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("image") % shards).cast("int").alias("shard"),
        F.floor(F.col("image") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
