"""Ranked lexical search by Fagin's threshold algorithm.

Documents are cut into chunks of at most CHUNK_BYTES of text (one document at least).  A chunk of the index holds its
documents' lengths and its postings of terms that an item has, as packed arrays: a forward index by document.
Where items are searched, a chunk's postings are sorted by term and falling impact.  For each item, the lists
of its terms are read in turn, DEPTH rows of each at a time; a document met for the first time gets its whole score by looking
up every term in the forward index.  The threshold is the sum of the impacts at the lists' present places: no document
not met yet can score more.  Reading stops when it is strictly below the k-th best score, so ties are all met.  A
task carries the k best of each item from chunk to chunk, so later chunks mostly stop before their first row; then the
k best of all tasks are merged.

Items are dealt into blocks whose terms take about BLOCK_BYTES, usually one; a block's vocabulary and items are broadcast, and
each block is one pass over the texts.  Counts that weights need are summed over the whole index.  A first search of
PROBES chunks gives every item a score that its k-th best has at least; it spares work and rows, and drops nothing.

A null or empty text has no terms; a document without terms is never found and an item without terms finds nothing.
Each row of ``items`` is an item of its own, also with a repeated or null item_id; repeated rows of documents are
found each, with one score.  A null doc_id comes last among equal scores.  With no documents the result is empty.  Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, partitions_of, slices
from .textblocks import flat_bytes

#: Text of one chunk of the index, and bytes of the terms of one block of items.
CHUNK_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
#: Chunks that are searched first for lower bounds.
PROBES = 8
#: Text that is taken apart at a time.
PART_BYTES = 1 << 20
#: Rows read from each list before the threshold is looked at again, at first; doubled each time.
DEPTH = 8
_TERM = np.ones(256, dtype=bool)
_TERM[:128] = False
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def terms_of(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms in text order as a binary array, and the offsets of each text's terms."""
    raw, off = flat_bytes(col)
    inside = _TERM[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    border = off[1:-1]
    border = border[border < len(raw)]
    begin[border] = inside[border]
    starts = np.flatnonzero(begin)
    kept = np.ascontiguousarray(_LOW[raw[inside]])
    at = np.append(np.cumsum(inside)[starts] - 1, len(kept)).astype(np.int64) if len(starts) else np.zeros(1, np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(kept)])
    return words, np.searchsorted(starts, off)


def vocabulary_of(items: DataFrame) -> DataFrame:
    """item, term: the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=PART_BYTES):
                words, at = terms_of(part.column("text"))
                owner = pa.array(np.repeat(np.arange(part.num_rows), np.diff(at)))
                yield pa.RecordBatch.from_arrays([part.column("item").take(owner), words.cast(pa.binary())], names=["item", "term"])

    return items.select("item", "text").mapInArrow(run, "item long, term binary").distinct()


class Index:
    """One chunk: n terms of each document, and its postings (document, term, tf) sorted by document and term."""

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray):
        self.n, self.doc, self.term, self.tf = n, doc, term, tf


def index(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """One row for each chunk of documents: ids, and n, doc, term and tf as packed arrays.

    Terms are numbers of places in ``vocabulary`` and are matched whole; documents without terms are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        size = max(len(terms), 1)
        for batch in batches:
            for chunk in slices(batch, limit=CHUNK_BYTES):
                ids, parts, base = [], [], 0
                for part in slices(chunk, limit=PART_BYTES):
                    words, at = terms_of(part.column("text"))
                    n = np.diff(at)
                    found = np.asarray(pc.fill_null(pc.index_in(words, value_set=terms), -1)).astype(np.int64) if len(words) else np.zeros(0, np.int64)
                    owner = np.repeat(np.cumsum(n > 0) - 1, n)
                    key, tf = np.unique(owner[found >= 0] * size + found[found >= 0], return_counts=True)
                    has = np.flatnonzero(n)
                    ids.append(part.column("doc_id").take(pa.array(has)))
                    parts.append((n[has], base + key // size, key % size, tf))
                    base += len(has)
                n, doc, term, tf = (np.concatenate(x) for x in zip(*parts))
                names = pa.concat_arrays(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                        *(pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((n, np.int64), (doc, np.int32), (term, np.int32), (tf, np.int32))),
                    ],
                    names=["doc_ids", "n", "doc", "term", "tf"],
                )
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_ids array<{kind}>, n binary, doc binary, term binary, tf binary")


def unpacked(row: dict) -> Index:
    return Index(np.frombuffer(row["n"], np.int64), *(np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("doc", "term", "tf")))


def corpus_counts(chunks: DataFrame) -> tuple[int, int]:
    """(documents with a term, all their terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = 0
        for batch in batches:
            for x in batch.column("n").to_pylist():
                n = np.frombuffer(x, np.int64)
                docs, total = docs + len(n), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total])], names=["docs", "total"])

    r = chunks.select("n").mapInArrow(run, "docs long, total long").agg(F.sum("docs"), F.sum("total")).first()
    return r[0] or 0, r[1] or 0


def document_counts(chunks: DataFrame) -> DataFrame:
    """term, df: documents that hold each term of the vocabulary, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column("term").to_pylist():
                own = np.bincount(np.frombuffer(x, np.int32))
                if len(own) > len(df):
                    df = np.concatenate((df, np.zeros(len(own) - len(df), np.int64)))
                df[: len(own)] += own
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    return chunks.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Best:
    """The k best (score, document) of each item so far; scores fall, equal scores have rising doc_id."""

    def __init__(self, k: int, floors: np.ndarray):
        self.k, self.floors, self.found = k, floors.copy(), {}

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        both = [*self.found.get(item, ()), *zip(scores.tolist(), ids)]
        both.sort(key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))
        self.found[item] = both = both[: self.k]
        if len(both) == self.k:
            self.floors[item] = max(self.floors[item], both[-1][0])


class Lists:
    """The postings of a chunk by term and falling impact, and by document for look-ups."""

    def __init__(self, chunk: Index, weight: np.ndarray, docs: int, total: int):
        size = len(weight)
        m = 10 + (90 * chunk.n * docs) // max(total, 1)
        impact = weight[chunk.term] * ((1_000_000_000 * chunk.tf) // (1000 * chunk.tf + 8 * m[chunk.doc]))
        self.key, self.impact, self.size = chunk.doc * size + chunk.term, impact, size  # sorted by key
        order = np.lexsort((-impact, chunk.term))
        self.doc, self.by = chunk.doc[order], impact[order]
        self.at = np.searchsorted(chunk.term[order], np.arange(size + 1))
        self.top = np.zeros(size, np.int64)
        has = np.flatnonzero(np.diff(self.at))
        self.top[has] = self.by[self.at[has]]

    def scores(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Whole scores by look-ups in the forward index."""
        if not len(self.key):
            return np.zeros(len(docs), np.int64)
        wanted = (docs[:, None] * self.size + terms[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.impact[at], 0).reshape(len(docs), len(terms)).sum(axis=1)

    def search(self, item: int, terms: np.ndarray, best: Best, ids: pa.Array) -> int:
        """Read the item's lists in turn until the threshold is below the k-th score; rows read."""
        place, end = self.at[terms].copy(), self.at[terms + 1]
        met = np.zeros(0, np.int64)
        depth, read = DEPTH, 0
        while True:
            open_ = place < end
            threshold = int(self.by[place[open_]].sum())
            if threshold <= 0 or threshold < best.floors[item]:
                return read
            upto = np.minimum(place + depth, end)
            rows = np.concatenate([self.doc[a:b] for a, b in zip(place[open_].tolist(), upto[open_].tolist())])
            read += len(rows)
            new = np.setdiff1d(rows, met)
            if len(new):
                met = np.union1d(met, new)
                scores = self.scores(new, terms)
                good = scores >= max(best.floors[item], 1)
                if good.any():
                    best.add(item, scores[good], ids.take(pa.array(new[good])).to_pylist())
            place, depth = upto, 2 * depth


def searched(chunks: DataFrame, terms: list[np.ndarray], weight: np.ndarray, docs: int, total: int, k: int, floors: np.ndarray) -> DataFrame:
    """nth, score, doc_id: each task's k best of each list of terms, without those that score below its floor."""
    starts = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
    shared = chunks.sparkSession.sparkContext.broadcast((np.concatenate(terms), starts, weight, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, starts, weight, floors = shared.value
        best, kind = Best(k, floors), None
        for batch in batches:
            kind = batch.schema.field("doc_ids").type.value_type
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                lists = Lists(unpacked({c: row.column(c)[0].as_py() for c in ("n", "doc", "term", "tf")}), weight, docs, total)
                ids = row.column("doc_ids").flatten()
                threshold = np.add.reduceat(lists.top[terms], starts[:-1])  # before the first row of any list
                for i in np.flatnonzero((threshold > 0) & (threshold >= best.floors)).tolist():
                    lists.search(i, terms[starts[i] : starts[i + 1]], best, ids)
        if best.found:
            nth, score, doc = zip(*((i, s, d) for i, have in best.found.items() for s, d in have))
            yield pa.RecordBatch.from_arrays([pa.array(nth, pa.int64()), pa.array(score, pa.int64()), pa.array(doc, kind)], names=["nth", "score", "doc_id"])
        give_back()

    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    return chunks.mapInArrow(run, f"nth long, score long, doc_id {kind}")


def best_of(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k best rows(key, score, doc_id) of each key, with rank; in two steps, so that no key has the rows of
    all tasks in one place."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = max(1, int(partitions_of(rows.sparkSession) ** 0.5))
    some = rows.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(parts)))
    some = some.withColumn("_nth", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))).where(F.col("_nth") <= k).drop("_part", "_nth")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("int")).where(F.col("rank") <= k)


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of items(item_id, text)."""
    spark = docs.sparkSession
    rows = materialize(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    words = materialize(vocabulary_of(rows), "item-terms")
    n_blocks = max(1, -(-(words.agg(F.sum(F.length("term") + 16)).first()[0] or 0) // BLOCK_BYTES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item long, score long, doc_id {kind}")
    for b in range(n_blocks):
        mine = words.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b)
        vocabulary = pa.array(sorted(bytes(r["term"]) for r in mine.select("term").distinct().toLocalIterator()), pa.large_binary())
        if not len(vocabulary):
            continue
        chunks = materialize(index(docs, vocabulary), "index")
        n_docs, total = corpus_counts(chunks)
        df = np.zeros(len(vocabulary), np.int64)
        for r in document_counts(chunks).collect():  # a row for each term of the vocabulary
            df[r["term"]] = r["df"]
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        places = {t: i for i, t in enumerate(vocabulary.to_pylist())}
        numbers: dict[int, list[int]] = {}
        for r in mine.toLocalIterator():
            numbers.setdefault(r["item"], []).append(places[bytes(r["term"])])
        names, terms = sorted(numbers), [np.array(sorted(numbers[i]), np.int64) for i in sorted(numbers)]
        floors = np.zeros(len(names), np.int64)
        for r in best_of(searched(chunks.limit(PROBES), terms, weight, n_docs, total, k, floors), "nth", k).where(F.col("rank") == k).collect():  # a row for each item
            floors[r["nth"]] = r["score"]
        hits = searched(chunks, terms, weight, n_docs, total, k, floors)
        named = spark.createDataFrame([(n, i) for n, i in enumerate(names)], "nth long, item long")
        found = found.unionByName(materialize(hits, "found").join(F.broadcast(named), "nth").select("item", "score", "doc_id"))  # at most as many as the block has items
    return best_of(found, "item", k).join(rows.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
