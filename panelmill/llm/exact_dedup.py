"""Exact deduplication by composable polynomial fingerprints.

Each text's bytes are cut into chunks; a chunk's hash is a polynomial over its bytes
modulo a prime, and the hashes of a document's chunks are combined by length-shifted
arithmetic (``combine``), so chunks of a huge document can be hashed in any order and
in parallel; texts of more than SEGMENT bytes are dealt over tasks so.  Two primes and the byte length make the fingerprint.  Texts with equal
fingerprints are then compared chunk by chunk; where chunks differ, the texts
themselves become the key, so the groups are exact.

Nulls count as the empty text, and empty texts form one group.  Of rows with the same
largest doc_id and equal text one stays.  A null doc_id is smaller than any other.  An
empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, join_groups, materialize, slices, sorted_out, text_or_empty
from .textblocks import flat_bytes, mix

#: (prime, base) of each fingerprint.
MODULI = ((2147483647, 1103515245), (2147483629, 747796405))
CHUNK = 4096
#: Bytes of text that a task holds at a time, and those it hashes at a time.
PART_BYTES, PIECE = 2 << 20, 1 << 18
#: Texts of more bytes are hashed in segments of as many bytes, by any tasks.
SEGMENT = 4 << 20
#: Bytes of a chunk in the comparison.
COMPARE = 1 << 16
#: Bits of the filter of fingerprints that occur twice; fixed, so false positives only cost work.
FILTER_BITS = 1 << 23
KEYS = ["fp1", "fp2", "n_bytes"]


def _powers(prime: int, base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    for i in range(1, n):
        out[i] = int(out[i - 1]) * base % prime
    return out


def combine(left: int, left_len: int, right: int, modulus: tuple[int, int] = MODULI[0]) -> int:
    """Hash of a text from the hashes of its two parts: the right part is shifted by the left's length."""
    prime, base = modulus
    return (left + right * pow(base, left_len, prime)) % prime


def fingerprints(raw: np.ndarray, offsets: np.ndarray, modulus: tuple[int, int], tables: dict) -> np.ndarray:
    """Hash of every text in a flat batch: the hashes of its chunks, combined by their places.

    Chunks are hashed PIECE bytes at a time, so the arrays do not grow with the batch."""
    prime, base = modulus
    if modulus not in tables:
        tables[modulus] = (_powers(prime, base, CHUNK), [1])
    table, shifts = tables[modulus]
    n_chunks = -(-np.diff(offsets) // CHUNK)
    out = np.zeros(len(n_chunks), dtype=np.uint64)
    if not n_chunks.sum():
        return out
    while len(shifts) < n_chunks.max():
        shifts.append(shifts[-1] * pow(base, CHUNK, prime) % prime)
    has = np.flatnonzero(n_chunks)
    nth = np.arange(n_chunks.sum()) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    start = np.append(np.repeat(offsets[:-1], n_chunks) + nth * CHUNK, len(raw))
    chunk = np.zeros(len(nth), dtype=np.uint64)
    for at in range(0, len(nth), PIECE // CHUNK):
        own = start[at : at + PIECE // CHUNK + 1]
        place = np.arange(own[-1] - own[0]) - np.repeat(own[:-1] - own[0], np.diff(own))
        terms = (raw[own[0] : own[-1]].astype(np.uint64) + np.uint64(1)) * table[place]
        chunk[at : at + len(own) - 1] = np.add.reduceat(terms, own[:-1] - own[0]) % np.uint64(prime)
    shifted = chunk * np.array(shifts, dtype=np.uint64)[nth] % np.uint64(prime)
    out[has] = np.add.reduceat(shifted, (np.cumsum(n_chunks) - n_chunks)[has]) % np.uint64(prime)
    return out


def _with_keys(batch: pa.RecordBatch, moduli, tables: dict) -> tuple[list[pa.Array], np.ndarray]:
    raw, offsets = flat_bytes(batch.column("text"))
    fps = [fingerprints(raw, offsets, m, tables).astype(np.int64) for m in moduli]
    lens = np.diff(offsets)
    return [pa.array(fps[0]), pa.array(fps[1]), pa.array(lens)], _key_hash(*fps, lens)


def _key_hash(fp1: np.ndarray, fp2: np.ndarray, lens: np.ndarray) -> np.ndarray:
    a, b, c = (np.asarray(x, dtype=np.int64).astype(np.uint64) for x in (fp1, fp2, lens))
    return mix(mix(a + (b << np.uint64(32))) + c)


def fingerprinted(docs: DataFrame, moduli=MODULI, keep_text: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, [text_sha256 or text], fp1, fp2, n_bytes.

    Texts of more than SEGMENT bytes are dealt out as segments, and their hashes combined."""
    kept = [F.col("text")] if keep_text else []
    given = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_sha256", F.sha2("text", 256))
    long = F.octet_length("text") > SEGMENT
    schema = given.select("doc_id", "text_sha256", *kept).schema

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict = {}
        for batch in batches:
            for part in slices(batch, limit=PART_BYTES):
                cols, _ = _with_keys(part, moduli, tables)
                own = [part.column(f) for f in part.schema.names if f != "text" or keep_text]
                yield pa.RecordBatch.from_arrays([*own, *cols], names=[*(f for f in part.schema.names if f != "text" or keep_text), *KEYS])
        give_back()

    def run(rows: DataFrame) -> DataFrame:
        own = [f for f in rows.schema.fields if f.name != "text" or keep_text]
        return rows.mapInArrow(hashed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", fp1 long, fp2 long, n_bytes long")

    short = run(given.where(~long).select("doc_id", "text", "text_sha256")).select(*schema.names, *KEYS)
    huge = given.where(long).withColumn("_row", F.monotonically_increasing_id())
    return short.unionByName(combined(huge, moduli, schema.names))


def combined(huge: DataFrame, moduli, columns: list[str]) -> DataFrame:
    """columns and KEYS of huge(_row, text, ...): hashes of segments, shifted by what lies before, added up."""
    body = F.col("text").cast("binary")
    places = F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / SEGMENT).cast("int"))
    dealt = huge.withColumn("_nth", F.explode(places)).select("_row", "_nth", F.substring(body, F.col("_nth") * SEGMENT + 1, F.lit(SEGMENT)).alias("part"))
    tables: dict = {}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nth, part = batch.column("_nth")[i].as_py(), batch.column("part").slice(i, 1)
                raw, at = flat_bytes(part)
                fps = [int(fingerprints(raw, at, m, tables)[0]) * pow(m[1], nth * SEGMENT, m[0]) % m[0] for m in moduli]
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(i, 1), *(pa.array([f], pa.int64()) for f in fps), pa.array([len(raw)], pa.int64())], names=["_row", *KEYS])
        give_back()

    parts = dealt.repartition("_row", "_nth").mapInArrow(hashed, "_row long, fp1 long, fp2 long, n_bytes long")
    sums = parts.groupBy("_row").agg(*[(F.sum(k) % F.lit(m[0])).alias(k) for k, m in zip(KEYS, moduli)], F.sum("n_bytes").alias("n_bytes"))
    return huge.join(sums, "_row").select(*columns, *KEYS)


def differing(docs: DataFrame, repeated: DataFrame, moduli=MODULI) -> DataFrame:
    """Fingerprints shared by different texts: chunk by chunk, the smallest and the largest
    chunk of all texts with one fingerprint are equal unless texts differ there."""
    spark = docs.sparkSession
    where = F.shiftrightunsigned(F.xxhash64(*KEYS), 64 - FILTER_BITS.bit_length() + 1)
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in repeated.select(F.floor(where / 8).alias("byte"), F.pow(F.lit(2), where % 8).cast("int").alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        bits[r["byte"]] = r["bit"]  # at most FILTER_BITS / 8 rows
    shared = spark.sparkContext.broadcast(bits)
    rows = fingerprinted(docs, moduli, keep_text=True).drop("doc_id", "text_sha256").withColumn("at", where)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array((flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for part in slices(batch, limit=PART_BYTES):
                keys = list(zip(*(part.column(k).to_pylist() for k in KEYS)))
                seen: set = set()
                out: list[tuple] = []
                for key, text in zip(keys, part.column("text")):
                    body = text.as_buffer().to_pybytes()
                    if (key, body) in seen:
                        continue
                    seen.add((key, body))
                    out += [(*key, i // COMPARE, body[i : i + COMPARE]) for i in range(0, len(body), COMPARE)]
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=[*KEYS, "nth", "chunk"])

    pieces = rows.mapInArrow(chunks, "fp1 long, fp2 long, n_bytes long, nth long, chunk binary")
    spread = pieces.groupBy(*KEYS, "nth").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return spread.where(F.col("low") != F.col("high")).select(*KEYS).distinct()


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with a number each, to be written: numbers given at reading depend on how files are split."""
    return rows.withColumn("row", F.monotonically_increasing_id())


def exact_dedup(docs: DataFrame, moduli=MODULI) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(_numbered(fingerprinted(docs, moduli)), "fingerprints")
    repeated = rows.groupBy(*KEYS).count().where("count > 1").select(*KEYS)
    clash = materialize(differing(docs, repeated, moduli), "clashes")
    keys = list(KEYS)
    if not clash.isEmpty():
        texts = fingerprinted(docs, moduli, keep_text=True)
        marked = texts.join(clash.withColumn("clash", F.lit(True)), KEYS, "left")
        rows = materialize(_numbered(marked.withColumn("exact", F.when(F.col("clash"), F.col("text"))).drop("text", "clash")), "exact")
        keys.append("exact")
    groups = rows.groupBy(*keys).agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups.where("group_size > 1"), "groups")
    joined = join_groups(rows, groups, keys, "group_size", rows.count())
    return joined.select(
        "doc_id",
        F.when(F.col("last").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("last.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns.

    Only rows whose key may be one of a row that goes are joined, so few texts are shuffled."""
    rows = exact_dedup(docs).groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    some = materialize(rows.agg(F.max("kept").alias("_stays"), F.min("kept").alias("_all")).where("NOT _all").drop("_all"), "gone")
    sha = F.sha2(text_or_empty(), 256)
    sure, maybe = sorted_out(docs, [F.col("doc_id"), sha], some.select("_id", "_sha"))
    maybe = maybe.withColumn("_sha256", sha)
    joined = maybe.join(some, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha256") == F.col("_sha")), "left")
    free = joined.where("_stays IS NULL").select(*docs.columns)
    one = joined.where("_stays").dropDuplicates(["doc_id", "_sha256"]).select(*docs.columns)
    return sure.unionByName(free).unionByName(one)
