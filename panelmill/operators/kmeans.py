"""Start partitions of locations by k-means on principal components.

Features are standardised and turned into components that hold a share of their variance; both need
sums of cross products only.  Many restarts of Lloyd's iterations run in the same jobs: a task adds up, for every
restart and centre, the number, sum and squared distance of its points, so what leaves a task does not grow with
the locations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.store import cut_lineage
from . import partitions

#: Variance that the components hold, at least.
SHARE = 0.9


def components(features: DataFrame, columns: list[str], share: float = SHARE) -> DataFrame:
    """loc, point array: scores on the first principal components of the standardised columns; constant columns
    are left out.  Rows with a null feature are left out; without a column that varies, points are empty."""
    rows = features.dropna(subset=columns)
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]]).first()
    spread = {c: sums[f"c_{c}_{c}"] or 0.0 for c in columns}
    kept = [c for c in columns if spread[c] > 1e-20]
    if not kept:
        return rows.select("loc", F.array().cast("array<double>").alias("point"))
    corr = np.array([[sums[f"c_{a}_{b}" if columns.index(a) <= columns.index(b) else f"c_{b}_{a}"] / np.sqrt(spread[a] * spread[b]) for b in kept] for a in kept])
    value, vector = np.linalg.eigh(corr)
    value, vector = value[::-1], vector[:, ::-1]
    n = int(np.searchsorted(np.cumsum(value) / value.sum(), share - 1e-12)) + 1
    sign = np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(len(kept))])  # the largest entry is positive
    vector = vector * sign
    scaled = [(F.col(c) - sums[f"m_{c}"]) / float(np.sqrt(spread[c])) for c in kept]
    return rows.select("loc", F.array(*[sum((float(vector[i, k]) * x for i, x in enumerate(scaled)), F.lit(0.0)) for k in range(n)]).alias("point"))


def _points(batch: pa.RecordBatch, p: int) -> np.ndarray:
    return batch.column("point").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)


def first_centres(points: DataFrame, k: int, restarts: int, seed: int) -> np.ndarray:
    """restarts x k x p: for each restart, the k points with the smallest hash of (location, restart, seed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {r: [] for r in range(restarts)}
        for batch in batches:
            point, hashes = batch.column("point").to_pylist(), np.array(batch.column("hashes").to_pylist(), dtype=np.int64).reshape(batch.num_rows, restarts)
            for r in range(restarts):
                for i in np.argsort(hashes[:, r], kind="stable")[:k]:
                    best[r].append((int(hashes[i, r]), point[i]))
                best[r] = sorted(best[r])[:k]
        out = [(r, h, x) for r, have in best.items() for h, x in have]
        if out:
            r, h, x = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(h, pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["restart", "hash", "point"])

    hashed = points.select("loc", "point", F.array(*[F.xxhash64("loc", F.lit(r), F.lit(seed)) for r in range(restarts)]).alias("hashes"))
    some = hashed.mapInArrow(run, "restart long, hash long, point array<double>")
    nth = F.row_number().over(W.Window.partitionBy("restart").orderBy("hash"))
    rows = some.withColumn("nth", nth).where(F.col("nth") <= k).orderBy("restart", "nth").collect()  # k for each restart
    return np.array([r["point"] for r in rows], dtype=float).reshape(restarts, k, -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centre of each point for each restart, ties to the first, and its squared distance."""
    far = ((x[None, :, None, :] - centres[:, None]) ** 2).sum(axis=3)
    to = far.argmin(axis=2)
    return to, np.take_along_axis(far, to[:, :, None], axis=2)[:, :, 0]


def lloyd_sums(points: DataFrame, centres: np.ndarray) -> np.ndarray:
    """restarts x k x (2 + p): number, squared distance and sum of the points nearest to each centre."""
    restarts, k, p = centres.shape
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((restarts, k, 2 + p))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                x = _points(batch.slice(at, 1024), p)
                to, far = _nearest(x, shared.value)
                for r in range(restarts):
                    np.add.at(total[r], to[r], np.column_stack((np.ones(len(x)), far[r], x)))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], names=["total"])

    rows = points.select("point").mapInArrow(run, "total array<double>").collect()  # numbers of centres, a row for each task
    return np.sum([np.array(r["total"]) for r in rows], axis=0).reshape(restarts, k, 2 + p)


def assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """loc, g: the number from 1 of the nearest of the k x p centres, ties to the first."""
    far = [F.aggregate(F.zip_with("point", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centres]
    return points.select("loc", F.array_position(F.array(*far), F.least(*far) if len(far) > 1 else far[0]).cast("int").alias("g"))


def start_partition(features: DataFrame, columns: list[str], k: int, least: int = 2, restarts: int = 50, seed: int = 1, most: int = 100) -> DataFrame:
    """loc, g: the best of many k-means partitions whose groups all have ``least`` locations.

    If no restart has such groups, the best is repaired by moving the locations that lose least."""
    points = cut_lineage(components(features, columns))
    if k == 1:
        return points.select("loc", F.lit(1).alias("g"))
    centres = first_centres(points, k, restarts, seed)
    before = np.full(restarts, np.inf)
    for _ in range(most):
        sums = lloyd_sums(points, centres)
        within = sums[:, :, 1].sum(axis=1)
        if not (within < before * (1 - 1e-12)).any():
            break
        before = np.minimum(before, within)
        filled = sums[:, :, 0] > 0  # an empty centre stays where it is
        centres = np.where(filled[:, :, None], sums[:, :, 2:] / np.maximum(sums[:, :, :1], 1), centres)
    sums = lloyd_sums(points, centres)
    within, able = sums[:, :, 1].sum(axis=1), (sums[:, :, 0] >= least).all(axis=1)
    best = int(np.where(able, within, np.inf).argmin()) if able.any() else int(within.argmin())
    labels = cut_lineage(assigned(points, centres[best]))
    if able.any():
        return labels
    near = [F.struct(F.lit(g + 1).alias("g"), (-F.aggregate(F.zip_with("point", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)).alias("ll")) for g, c in enumerate(centres[best])]
    scores = points.select("loc", F.explode(F.array(*near)).alias("s")).select("loc", "s.g", "s.ll")
    return partitions.repaired(labels, scores, k, least)
