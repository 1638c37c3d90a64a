"""Exact top-k inner products by columnar branch and bound.

Vectors become whole numbers, floor(scale * x).  Queries are taken in blocks of a fixed
number; each block is broadcast (its bytes are bounded by QUERY_BYTES) and meets every row
where it lies, so candidates are never shuffled or copied.  A task holds its candidates in
vertical layout, one row of a matrix for each dimension, dimensions with most mass first.
Inner products grow dimension block by dimension block; the norms of the dimensions still to
come bound what a candidate can gain or lose (Cauchy-Schwarz), candidates that can't reach a
query's floor are dropped, and the survivors' columns are compacted.  A query's floor is the
score of the k-th best row so far: at first among PROBES rows with large norms, then among
all rows that the task has seen.  Only rows that reach the floor leave a task, k for each
query at most, and meet per query.

Bounds are floating point with their rounding error added, so they only ever keep a row too
many; the scores of the survivors are exact whole numbers, clamped to 64 bits.

Every row is a candidate and keeps a number of its own, so rows that repeat a vec_id all
count, and a query is not matched with its own row alone; rows that repeat a query's vec_id
are queries too and repeat its result.  Vectors that are null, or hold null or non-finite
components, and rows with a null vec_id take no part; vectors are padded with zeros to the
longest.  Ties go to the smaller vec_id; a query with fewer than k candidates gets all.  An
empty table gives an empty result; columns besides vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import give_back, materialize

#: Bytes of a broadcast block of queries, rows that give the first floors, and rows, queries and
#: dimensions that a task takes at a time.
QUERY_BYTES, PROBES = 16 << 20, 2048
ROWS, TILE, STEP = 4096, 256, 16
EPS = 2.0**-52
LIMIT = 2**63 - 1


def usable(vectors: DataFrame) -> DataFrame:
    """row, vec_id, embedding of the rows that take part; row is written, so it stays the same."""
    if "decimal" in vectors.schema["embedding"].dataType.simpleString():
        raise TypeError("embedding holds decimals")
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return materialize(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(vectors: pa.Array, width: int, scale: int, order: np.ndarray | None = None) -> np.ndarray:
    """Whole numbers in vertical layout: width x rows, in the order of dimensions given."""
    sizes = np.asarray(vectors.value_lengths(), dtype=np.int64)
    out = np.zeros((len(sizes), width))
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        out[np.repeat(np.arange(len(sizes)), sizes), at] = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(float))
    return np.ascontiguousarray(out.T if order is None else out.T[order])


def tails(m: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norms of the dimensions from each cut on: (cuts, rows)."""
    with np.errstate(over="ignore"):
        return np.array([np.sqrt((m[d:] ** 2).sum(axis=0)) for d in cuts])


def exact(q: np.ndarray, c: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Whole inner products of paired columns, clamped to 64 bits; ``near`` are floating ones."""
    with np.errstate(over="ignore", invalid="ignore"):
        sure = np.abs(q * c).sum(axis=0) < 2**53
    out = np.zeros(len(near), dtype=np.int64)
    out[sure] = near[sure].astype(np.int64)
    for i in np.flatnonzero(~sure).tolist():
        out[i] = max(-LIMIT - 1, min(LIMIT, sum(int(a) * int(b) for a, b in zip(q[:, i], c[:, i]))))
    return out


class Best:
    """The best k rows of each query so far: scores, vec_ids and rows, best first."""

    def __init__(self, queries: int, k: int, floors: np.ndarray | None = None):
        self.k = k
        self.score = np.full((queries, k), -LIMIT - 1, dtype=np.int64)
        self.ids = np.full((queries, k), LIMIT, dtype=np.int64)
        self.rows = np.full((queries, k), -1, dtype=np.int64)
        self.given = np.full(queries, -np.inf) if floors is None else floors

    def floors(self) -> np.ndarray:
        """What a row must reach: at most the score of the k-th best row."""
        full = self.rows[:, -1] >= 0
        return np.maximum(self.given, np.where(full, np.nextafter(self.score[:, -1].astype(float), -np.inf), -np.inf))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        touched = np.unique(query)
        old = np.repeat(touched, self.k)
        q = np.concatenate((old, query))
        s, i, r = (np.concatenate((own[touched].ravel(), new)) for own, new in ((self.score, score), (self.ids, ids), (self.rows, rows)))
        by = np.lexsort((r, i, -np.maximum(s, -LIMIT), r < 0, q))  # places without a row last
        q, s, i, r = q[by], s[by], i[by], r[by]
        first = np.searchsorted(q, touched)
        take = first[:, None] + np.arange(self.k)
        self.score[touched], self.ids[touched], self.rows[touched] = s[take], i[take], r[take]


class Queries:
    """A block of queries, ready for search."""

    def __init__(self, m: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.m, self.ids, self.rows = m, ids, rows
        self.cuts = [*range(0, len(m), STEP), len(m)] if len(m) else [0]
        self.tail = tails(m, self.cuts)

    def search(self, c: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, best: Best) -> None:
        """Improve ``best`` by the candidates c (dimensions x rows)."""
        c_tail = tails(c, self.cuts)
        for lo in range(0, len(self.ids), TILE):
            hi = min(lo + TILE, len(self.ids))
            floor, live = best.floors()[lo:hi], np.arange(len(c_ids))
            score = np.zeros((hi - lo, len(live)))
            with np.errstate(over="ignore", invalid="ignore"):
                whole = (len(c) + 2) * EPS * self.tail[0, lo:hi, None]  # rounding error by unit of a candidate's norm
                for s, d in enumerate(self.cuts[:-1]):
                    score = score + self.m[d : self.cuts[s + 1], lo:hi].T @ c[d : self.cuts[s + 1]][:, live]
                    most = score + self.tail[s + 1, lo:hi, None] * c_tail[s + 1, live] + whole * c_tail[0, live]
                    able = ~(most < floor[:, None])
                    kept = np.flatnonzero(able.any(axis=0))
                    if len(kept) < len(live):
                        live, score, able = live[kept], score[:, kept], able[:, kept]
                if len(c) == 0:
                    able = np.ones_like(score, dtype=bool)
                q, j = np.nonzero(able)
                own = self.rows[lo + q] != c_rows[live[j]]
                q, j = q[own], j[own]
                # a whole score that ties with the k-th best only counts with a smaller vec_id
                whole_score = self.tail[0, lo + q] * c_tail[0, live[j]] < 2.0**52
                last = best.score[lo + q, -1].astype(float)
                tied = (best.rows[lo + q, -1] >= 0) & whole_score & ((score[q, j] < last) | ((score[q, j] == last) & (c_ids[live[j]] > best.ids[lo + q, -1])))
                q, j = q[~tied], j[~tied]
                if len(q):
                    order = np.lexsort((c_ids[live[j]], -score[q, j], q))
                    for a in range(0, len(order), 1 << 16):  # a bounded number of survivors at a time
                        p = order[a : a + (1 << 16)]
                        best.add(lo + q[p], exact(self.m[:, lo + q[p]], c[:, live[j[p]]], score[q[p], j[p]]), c_ids[live[j[p]]], c_rows[live[j[p]]])


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    shape = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    mass = {r["d"]: r["m"] for r in rows.select(F.posexplode("embedding").alias("d", "x")).groupBy("d").agg(F.sum(F.abs(F.col("x").cast("double"))).alias("m")).collect()}  # a row for each dimension
    order = np.argsort([-mass.get(d, 0.0) for d in range(shape)], kind="stable")
    probes = [r for r in rows.orderBy(F.desc(square), "row").limit(PROBES).toLocalIterator()]
    p_m = matrix(pa.array([r["embedding"] for r in probes], pa.list_(pa.float64())), shape, scale, order)
    p_ids, p_rows = (np.array([r[c] for r in probes], dtype=np.int64) for c in ("vec_id", "row"))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("nth", F.monotonically_increasing_id())
    block = max(1, QUERY_BYTES // max(8, 8 * shape))
    found = None
    for queries in _blocks(asked, block):
        q = Queries(matrix(pa.array([r["embedding"] for r in queries], pa.list_(pa.float64())), shape, scale, order), *(np.array([r[c] for r in queries], dtype=np.int64) for c in ("vec_id", "row")))
        first = Best(len(q.ids), k)
        q.search(p_m, p_ids, p_rows, first)
        shared = spark.sparkContext.broadcast((q, first.floors()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, floors = shared.value
            best = Best(len(q.ids), k, floors)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    q.search(matrix(part.column("embedding"), shape, scale, order), part.column("vec_id").to_numpy(), part.column("row").to_numpy(), best)
            i, j = np.nonzero(best.rows >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q.rows[i], q.ids[i], best.ids[i, j], best.score[i, j])], names=["asked", "query_id", "vec_id", "score"])
            give_back()

        part = rows.select("row", "vec_id", "embedding").mapInArrow(run, "asked long, query_id long, vec_id long, score long")
        part = materialize(part, "found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    nth = F.row_number().over(W.Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(asked: DataFrame, size: int) -> Iterator[list]:
    """The queries in blocks of a fixed number; the driver holds one block and one partition at a time."""
    block: list = []
    for r in asked.select("row", "vec_id", "embedding").toLocalIterator():
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block
