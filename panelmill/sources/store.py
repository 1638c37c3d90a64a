"""Reading, writing and keeping tables."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """CSV or CSV.GZ files with a header and given types; an empty field is null and the text NA is
    a text.  With strict=False, lines that do not fit the schema are left out."""
    read = spark.read.schema(schema).option("header", True).option("nullValue", "").option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return read.csv(path)


def write_csv(df: DataFrame, path: str, gzip: bool = False, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; a column that one lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def rename_legacy(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Old column names become new ones where the new one is absent."""
    for old, new in names.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def computed_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if it was written whole, else make() written there with its minutes."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        began = time.time()
        make().write.mode("overwrite").parquet(path)
        spark.range(1).select(F.lit((time.time() - began) / 60).alias("minutes")).write.mode("overwrite").parquet(path + ".minutes")
    return spark.read.parquet(path)


def unfinished(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a finished row."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, one machine gets a folder of its own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written once to the folder that the cluster names and read back: it is computed once, and what
    comes later does not depend on what came before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
