"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a key may have before it counts as hot, at least.
HOT_ROWS = 10_000
#: A key is hot only with this share of all rows, so at most 1/share keys are hot.
HOT_SHARE = 0.002


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Where it is unset, one machine
    gets a folder of its own; a cluster gets an error, as its executors see no common folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and
    an executor's loss costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a narrow table that one task writes.
FILE_ROWS = 250_000


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """df of few numbers a row and at most about ``rows`` rows, with tasks and files in their proportion,
    however many partitions a shuffle has."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing will read again."""
    spark = table.sparkSession
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Hand memory that a task has freed back to the system; Python workers live on after it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Slots of the table of keys that may be meant: with one row each, its size is fixed.
SLOTS = 1 << 20


def sorted_out(rows: DataFrame, keys: list[Column], wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that have none of the wanted keys for sure, the others), with all columns of rows.

    A key falls on one of SLOTS values of its hash; the slots that wanted keys fall on are
    broadcast, so the texts of the first part need no shuffle.  ``wanted`` has the keys alone."""
    slot = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(SLOTS))
    slots = wanted.select(slot([F.col(c) for c in wanted.columns]).alias("_slot")).distinct().withColumn("_maybe", F.lit(True))
    marked = rows.withColumn("_slot", slot(keys)).join(F.broadcast(slots), "_slot", "left")
    return marked.where("_maybe IS NULL").select(*rows.columns), marked.where("_maybe").select(*rows.columns)


def partitions_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def held_out(doc_id: Column | str, remainder: int) -> Column:
    """crc32 of doc_id as text, mod 5; a null doc_id is no held-out row."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have at most ``limit`` bytes together
    (one row at least), so that memory does not grow with the batch."""
    col = batch.column(column)
    lens = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    at, total = 0, 0
    for i, n in enumerate(lens.tolist()):
        if i > at and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(lens):
        yield batch.slice(at)


def binary_rows(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def cut(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column with values[offsets[i]:offsets[i + 1]] as row i."""
    if not len(offsets) - 1:
        return pa.array([], pa.binary())
    data = np.ascontiguousarray(values)
    at = offsets.astype(np.int64) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of rows to groups (one row per key) by null-safe keys, safe for hot keys.

    Groups with at least ``hot_rows`` rows and HOT_SHARE of the rows are at most 1/HOT_SHARE in
    number, so they are broadcast; the rest have few rows per key and are shuffled.
    """
    least = max(hot_rows, int(total * HOT_SHARE))
    value = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size) >= least).select(*[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(c).alias(f"_h_{c}") for c in value])
    cold = groups.where(F.col(size) < least)
    on = [rows[k].eqNullSafe(F.col(f"_h_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    marked = rows.join(F.broadcast(hot), cond, "left")
    is_hot = F.col(f"_h_{size}").isNotNull()
    warm = marked.where(is_hot).select(*rows.columns, *[F.col(f"_h_{c}").alias(c) for c in value])
    rest = marked.where(~is_hot).select(*rows.columns)
    cold = cold.select(*[F.col(k).alias(f"_c_{k}") for k in keys], *value)
    cond = rest[keys[0]].eqNullSafe(F.col(f"_c_{keys[0]}"))
    for k in keys[1:]:
        cond = cond & rest[k].eqNullSafe(F.col(f"_c_{k}"))
    rest = rest.join(cold, cond, "left").select(*rows.columns, *value)
    return warm.unionByName(rest)
