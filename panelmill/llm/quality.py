"""Document quality by a regularised quadratic discriminant.

Every whole text becomes a vector of transformed statistics (logs of counts, square roots
of shares).  For each class, the mean and a covariance shrunk towards the pooled one and
towards a diagonal are estimated from sums over all labelled training rows; a score is
the posterior of label 1 from the difference of the two Gaussian log-densities, whose
Mahalanobis terms use Cholesky factors computed once.

A null or empty text has the statistics of a text without characters and gets a score as
any other.  Labels count once per row of ``labels``; a null label counts for nothing; with
a class missing, every score is the share of label 1 (0.5 without labels).  Repeated rows
give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, held_out, materialize, slices
from .textblocks import flat_bytes, word_bounds, word_hashes

#: Shrinkage of a class covariance towards the pooled one, and of that towards its diagonal.
TO_POOLED, TO_DIAGONAL = 0.2, 0.05
FLOOR = 1e-4
#: Units added to the base of a share, so that a few words say little.
DAMPING = 12
THRESHOLD = 0.3
#: Bytes of text whose statistics a task takes at a time; its arrays take some twenty times as much.
PART_BYTES = 1 << 20

#: Classes of bytes: 0 other, then lower case, upper case, digit, blank, stop, mark, symbol, above ASCII.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[32, 9, 10, 11, 12, 13]] = 4
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 5
_KIND[ord("!")] = 6
_KIND[[ord(c) for c in "#$%&*|<>{}[]=+@^~_/\\`"]] = 7
_KIND[128:] = 8
FEATURES = 18


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root of a share, damped for short texts."""
    return np.sqrt(a / (b + DAMPING))


def statistics(col: pa.Array) -> np.ndarray:
    """One row of FEATURES statistics for each text."""
    raw, off = flat_bytes(col)
    n = len(off) - 1
    size = np.diff(off)
    has = np.flatnonzero(size)
    kinds = np.zeros((n, 9))
    what = _KIND[raw]
    for k in range(9):  # one byte for each byte of text at a time
        kinds[has, k] = np.add.reduceat(what == k, off[has], dtype=np.int64) if len(has) else 0
    lines = np.ones(n)
    lines[has] += np.add.reduceat(raw == 10, off[has], dtype=np.int64) if len(has) else 0
    starts, ends = word_bounds(raw, off)
    words, at = word_hashes(raw, off)
    n_words = np.diff(at)
    owner = np.repeat(np.arange(n), n_words)
    length = (ends - starts).astype(float)
    mean = np.bincount(owner, length, minlength=n) / np.maximum(n_words, 1)
    square = np.bincount(owner, length**2, minlength=n) / np.maximum(n_words, 1)
    by = np.lexsort((words, owner))
    w, o = words[by], owner[by]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (o[1:] != o[:-1]))) if len(w) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(w)))
    distinct = np.bincount(o[first], minlength=n) if len(w) else np.zeros(n)
    most = np.zeros(n)
    np.maximum.at(most, o[first], runs)
    same = np.bincount(owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])], minlength=n) if len(w) else np.zeros(n)
    odd_end = np.bincount(owner[(_KIND[raw[ends - 1]] >= 6) & (_KIND[raw[ends - 1]] <= 7)], minlength=n) if len(w) else np.zeros(n)
    capital = np.bincount(owner[_KIND[raw[starts]] == 2], minlength=n) if len(w) else np.zeros(n)
    single = np.bincount(owner[length == 1], minlength=n) if len(w) else np.zeros(n)
    chars = size.astype(float)
    return np.column_stack(
        [
            np.log1p(n_words), np.log1p(mean), np.log1p(np.sqrt(np.maximum(square - mean**2, 0))),
            _share(kinds[:, 2], kinds[:, 1] + kinds[:, 2]), _share(kinds[:, 3], chars), _share(kinds[:, 4], chars),
            _share(kinds[:, 5], n_words), _share(kinds[:, 6], n_words), _share(kinds[:, 7], n_words), _share(kinds[:, 8], chars), _share(kinds[:, 0], chars),
            np.log1p(distinct) / np.maximum(np.log1p(n_words), 1), _share(most, n_words), _share(same, n_words),
            _share(odd_end, n_words), _share(capital, n_words), _share(single, n_words), np.log1p(n_words / lines),
        ]
    )


def featured(docs: DataFrame, extract=statistics) -> DataFrame:
    """doc_id and x array<double>, the statistics of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=PART_BYTES):
                x = extract(part.column("text"))
                flat = pa.array(x.ravel())
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows], names=["doc_id", "x"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


@dataclass
class Discriminant:
    """Two Gaussians with cached Cholesky factors, and the log odds of their classes."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    log_odds: float

    @staticmethod
    def fit(moments: list[tuple[float, np.ndarray, np.ndarray]]) -> Discriminant | float:
        """From (rows, sum, sum of outer products) of class 0 and 1; a constant if one is missing."""
        rows = [m[0] for m in moments]
        if min(rows) < 2:
            return rows[1] / sum(rows) if sum(rows) else 0.5
        means = [s / n for n, s, _ in moments]
        covs = [o / n - np.outer(m, m) for (n, _, o), m in zip(moments, means)]
        pooled = sum(n * c for n, c in zip(rows, covs)) / sum(rows)
        factors, dets = [], []
        for c in covs:
            c = (1 - TO_POOLED) * c + TO_POOLED * pooled
            c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + FLOOR * np.eye(len(c))
            factor = np.linalg.cholesky(c)
            factors.append(np.linalg.inv(factor))
            dets.append(2 * float(np.log(np.diag(factor)).sum()))
        return Discriminant(means, factors, dets, float(np.log(rows[1] / rows[0])))

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = [-0.5 * ((((x - m) @ f.T) ** 2).sum(axis=1) + d) for m, f, d in zip(self.means, self.factors, self.log_dets)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.log_odds, -500, 500)))


def class_moments(rows: DataFrame) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Sums over rows(x, label): added up in each task, then by (label, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + FEATURES + FEATURES**2))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, FEATURES)
            y = batch.column("label").to_numpy()
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        at = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel())], names=["at", "value"])

    total = np.zeros(2 * (1 + FEATURES + FEATURES**2))
    for r in rows.select("x", "label").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():  # a fixed number of rows
        total[r["at"]] = r["value"]
    return [(p[0], p[1 : 1 + FEATURES], p[1 + FEATURES :].reshape(FEATURES, FEATURES)) for p in np.split(total, 2)]


def training_rows(rows: DataFrame, labels: DataFrame, label: str, fold: int = 0) -> DataFrame:
    """rows joined with the labels 0 and 1 of the training fold."""
    known = labels.select("doc_id", F.col(label).cast("long").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", fold))
    return rows.join(known, "doc_id")


def scored(rows: DataFrame, model, threshold: float, fold: int) -> DataFrame:
    """doc_id, held_out, score, predicted from rows(doc_id, x) and a model of x."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            if isinstance(m, float):
                s = np.full(n, m)
            else:
                s = m.scores(batch.column("x").flatten().to_numpy().reshape(n, -1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out("doc_id", fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fitted(rows: DataFrame, labels: DataFrame, fold: int = 0) -> Discriminant | float:
    """The discriminant of rows(doc_id, x) and labels(doc_id, quality)."""
    return Discriminant.fit(class_moments(training_rows(rows, labels, "quality", fold)))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fold: int = 0) -> DataFrame:
    """The rows of docs with a score of at least threshold, with all their columns.

    Texts pass through the scoring tasks, so rows are filtered where they are read."""
    model = fitted(materialize(featured(docs), "statistics"), labels, fold)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, limit=PART_BYTES):
                s = np.full(part.num_rows, m) if isinstance(m, float) else m.scores(statistics(part.column("text")))
                yield part.filter(pa.array(s >= threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fold: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = materialize(featured(docs), "statistics")
    return scored(rows, fitted(rows, labels, fold), threshold, fold)
