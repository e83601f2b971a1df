"""Pieces that several training-data operators share.

Intermediate tables are Parquet below ``spark.checkpoint.dir``, the folder that driver and
executors share; nothing is kept only in executors, so a lost executor costs a re-run of its
tasks and no more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as the contracts name them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this application. Only a local master may run without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/gramlake/{spark.sparkContext.applicationId}"


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the table read from there (lineage is cut)."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let the driver notice finished plans, so that their shuffle files leave the disks."""
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for table in tables:
        drop_path(table.sparkSession, table._stash_path)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def text_or_empty(name: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(name: str = "text") -> list:
    """128 bits that name a text: XXH64 under two seeds. Stable between scans, unlike row numbers."""
    text = text_or_empty(name)
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second seed"), text).alias("h2")]


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs that kept (id, h1, h2) names; of repeated rows one stays.

    The join and the removal of repeats share one partitioning.
    """
    names = docs.columns
    keys = ["__id", "__h1", "__h2"]
    h1, h2 = text_key(text_col)
    left = docs.select("*", F.col(id_col).alias("__id"), h1.alias("__h1"), h2.alias("__h2"))
    right = kept.select(F.col(id_col).alias("__rid"), F.col("h1").alias("__r1"), F.col("h2").alias("__r2"))
    on = left["__id"].eqNullSafe(right["__rid"]) & (left["__h1"] == right["__r1"]) & (left["__h2"] == right["__r2"])
    return left.join(right, on, "left_semi").dropDuplicates(keys).select(*names)
