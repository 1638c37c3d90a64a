"""Best-fit packing of token sequences with exact-complement hashing.

Documents become token ids plus an end id; only those longer than a sequence are cut.
The plan is made on the counts of piece lengths, which are at most ``capacity`` numbers
whatever the input.  From the longest length down, the gap that a piece leaves is looked
up among the single, pair and triple length sums that are available; combinations that
fill the gap exactly are consumed as often as the counts allow, and what is left is
filled best-fit, with a new exact look-up after each piece.  A run of the plan stands for
any number of equal sequences, so the plan's size follows the lengths, not the rows.
Pieces are then numbered in order of length as a distributed table and find their
sequence and offset in the plan by binary search.

A null text counts as empty and is a document of the end id alone.  Repeated rows are
packed each; an empty table gives an empty result; columns besides doc_id and text are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoded_ids, forget
from .common import give_back, materialize, partitions_of
from .sharding import numbered

CAPACITY = 2048


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, keep_words: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document.

    A worker keeps its vocabulary and words for its next task, or frees them if it may not."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids in encoded_ids(batch, path):
                ids = [x + tail for x in ids]
                n = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
                k = -(-n // capacity)
                row = np.repeat(np.arange(len(ids)), k)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                start = nth * capacity
                length = np.minimum(capacity, n[row] - start)
                crc = [zlib.crc32(memoryview(ids[r])[4 * s : 4 * (s + m)]) for r, s, m in zip(row.tolist(), start.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(nth.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        if not keep_words:
            forget(path)
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class LengthIndex:
    """Available counts of lengths, with their single, pair and triple sums."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self._pairs: np.ndarray | None = None

    def take(self, lengths: list[int], times: int) -> None:
        for n in lengths:
            self.left[n] -= times
            if self.left[n] <= 1:
                self._pairs = None

    def _pair_sums(self) -> np.ndarray:
        """Whether two available pieces have this sum."""
        if self._pairs is None:
            has = np.flatnonzero(self.left)
            sums = np.zeros(2 * len(self.left), dtype=bool)
            bits = self.left > 0
            for a in has.tolist():
                if self.left[a] > 1:
                    sums[2 * a] = True
                sums[a + a + 1 : a + len(bits)] |= bits[a + 1 :]
            self._pairs = sums
        return self._pairs

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.left[gap] > 0 else None

    def pair(self, gap: int) -> list[int] | None:
        """The pair with the longest piece."""
        if not self._pair_sums()[gap]:
            return None
        b = np.arange(1, gap // 2 + 1)
        ok = (self.left[b] > 0) & (self.left[gap - b] > 0) & ((gap - b != b) | (self.left[b] > 1))
        at = np.flatnonzero(ok)
        return [int(gap - b[at[0]]), int(b[at[0]])] if len(at) else None

    def triple(self, gap: int) -> list[int] | None:
        """The triple with the longest piece."""
        a = np.arange(gap - 2, 0, -1)
        for n in a[(self.left[a] > 0) & self._pair_sums()[gap - a]].tolist():
            self.left[n] -= 1
            found = self.pair_now(gap - n)
            self.left[n] += 1
            if found:
                return [n, *found]
        return None

    def pair_now(self, gap: int) -> list[int] | None:
        b = np.arange(1, gap // 2 + 1)
        at = np.flatnonzero((self.left[b] > 0) & (self.left[gap - b] > 0) & ((gap - b != b) | (self.left[b] > 1)))
        return [int(gap - b[at[0]]), int(b[at[0]])] if len(at) else None

    def exact(self, gap: int) -> list[int] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)

    def best(self, gap: int) -> int | None:
        """The longest available piece that fits."""
        at = np.flatnonzero(self.left[1 : gap + 1])
        return int(at[-1]) + 1 if len(at) else None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Runs (lengths of a sequence's pieces, how many such sequences) that use up the counts."""
    index, runs = LengthIndex(counts), []
    for longest in range(capacity, 0, -1):
        while index.left[longest] > 0:
            chosen, gap = [longest], capacity - longest
            index.take([longest], 1)
            while gap > 0:
                filled = index.exact(gap)
                if filled:
                    index.take(filled, 1)
                    chosen += filled
                    break
                n = index.best(gap)
                if n is None:
                    break
                index.take([n], 1)
                chosen.append(n)
                gap -= n
            used, copies = np.unique(chosen, return_counts=True)
            more = int((index.left[used] // copies).min())
            for n, c in zip(used.tolist(), copies.tolist()):
                index.take([n], more * c)
            runs.append((chosen, 1 + more))
    return runs


def places(runs: list[tuple[list[int], int]], counts: np.ndarray) -> dict[str, np.ndarray]:
    """The plan by row number of pieces in order of length: from which number on, how
    many copies a sequence takes, the first sequence, and the offset of the first copy."""
    first = np.cumsum(counts) - counts
    cursor = first.astype(np.int64).copy()
    out, base = [], 0
    for chosen, times in runs:
        offset, i = 0, 0
        ordered = sorted(chosen, reverse=True)
        while i < len(ordered):
            n = ordered[i]
            k = ordered.count(n)
            out.append((cursor[n], k, base, offset, n))
            cursor[n] += k * times
            offset += n * k
            i += k
        base += times
    table = np.array(sorted(out), dtype=np.int64).reshape(-1, 5)
    return {c: table[:, i] for i, c in enumerate(("from", "copies", "base", "offset", "length"))}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, keep_words: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    table = materialize(pieces(docs, path, capacity, end_id, keep_words), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in table.groupBy("length").count().collect():  # at most capacity rows
        counts[r["length"]] = r["count"]
    where = spark.sparkContext.broadcast(places(plan(counts, capacity), counts))
    rows, _ = numbered(table, ["length", "doc_id", "piece"], partitions_of(spark))

    def place(number: pd.Series) -> pd.DataFrame:
        p = where.value
        at = np.searchsorted(p["from"], number.to_numpy(), side="right") - 1
        nth = number.to_numpy() - p["from"][at]
        return pd.DataFrame({"sequence_id": p["base"][at] + nth // p["copies"][at], "offset": p["offset"][at] + nth % p["copies"][at] * p["length"][at]})

    placed = rows.withColumn("p", F.pandas_udf(place, "sequence_id long, offset long")("row_number"))
    return placed.select(*table.columns, "p.sequence_id", "p.offset")
