"""Feature tables: (probe, pool_id, split, row_id, label, features ARRAY<DOUBLE>) (SRC1-SRC11).

One ingest rule holds for all: cast to double, L2-normalise rows, then cap each pool at a number of
rows chosen by a hash of seed and row id, so that a re-run, another engine or a larger cluster
chooses the same rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramlake.functions import vectors as V

#: Words whose buckets a task remembers.
KNOWN_WORDS = 1 << 18
SCHEMA = T.StructType(
    [T.StructField("probe", T.StringType()), T.StructField("pool_id", T.StringType()), T.StructField("split", T.StringType()), T.StructField("row_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("features", T.ArrayType(T.DoubleType()))]
)


def normalise(df: DataFrame, floor: float = 1e-10) -> DataFrame:
    """Rows as doubles of length 1 (rows without any length stay as they are)."""
    return df.withColumn("features", V.unit(F.transform("features", lambda x: x.cast("double")), floor))


def order_hash(seed: int, row_id="row_id") -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))


def cap(df: DataFrame, most: int, seed: int = 42, by=("probe", "pool_id")) -> DataFrame:
    """SRC10: at most so many rows of each pool, in md5 order. Planned with a group limit before the shuffle."""
    w = Window.partitionBy(*by).orderBy(order_hash(seed), "row_id")
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= most).drop("__rn")


def load_features(spark: SparkSession, path: str, probe: str | None = None, pools: list[str] | None = None, split: str | None = None, most: int | None = 2000, seed: int = 42) -> DataFrame:
    """SRC1/SRC2: a feature table from Parquet; filters reach the scan, normalisation and cap follow."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if probe is not None:
        df = df.filter(F.col("probe") == probe)
    if pools is not None:
        df = df.filter(F.col("pool_id").isin(pools))
    if split is not None:
        df = df.filter(F.col("split") == split)
    df = normalise(df)
    return cap(df, most, seed) if most else df


def discover(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: (probe, pool_id, split) that exist. Of a hive-partitioned table only the file list is read."""
    return spark.read.schema(SCHEMA).parquet(path).select("probe", "pool_id", "split").distinct()


def parse_names(names: DataFrame, column: str = "name") -> DataFrame:
    """SRC3 for flat files named feat_<probe>_<pool>[_train|_test|_wl].npz: (probe, pool_id, split).

    Names that end in _wl are left out, those without a suffix are train; a pool's first pattern wins.
    """
    base = F.regexp_extract(F.col(column), r"feat_([^_]+)_(.+?)(_train|_test|_wl)?\.npz$", 0)
    part = lambda i: F.regexp_extract(F.col(column), r"feat_([^_]+)_(.+?)(_train|_test|_wl)?\.npz$", i)
    rows = names.filter(base != "").select(part(1).alias("probe"), part(2).alias("pool_id"), part(3).alias("suffix"), F.col(column).alias("name")).filter("suffix <> '_wl'")
    rows = rows.withColumn("split", F.when(F.col("suffix") == "_test", "test").otherwise("train"))
    first = Window.partitionBy("probe", "pool_id", "split").orderBy(F.col("suffix") == "", "name")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select("probe", "pool_id", "split", "name")


def catalog(features: DataFrame) -> DataFrame:
    """SRC4: the pools of each probe, sorted."""
    return features.select("probe", "pool_id").distinct().groupBy("probe").agg(F.sort_array(F.collect_list("pool_id")).alias("pools"))


def load_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """SRC5/SNK6: the table at path, computed and written first if it doesn't exist."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        compute().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    """SRC6: a result table from CSV with a header, by an explicit schema."""
    return spark.read.schema(schema).csv(path, header=True)


def remap_classes(df: DataFrame, group: str = "group", label: str = "class_id") -> DataFrame:
    """SRC9: class ids of each group as 0, 1, 2, ... in their order."""
    return df.withColumn("label", (F.dense_rank().over(Window.partitionBy(group).orderBy(label)) - 1).cast("int"))


def dimension_check(features: DataFrame) -> DataFrame:
    """Probes whose rows differ in length (there should be none)."""
    return features.groupBy("probe").agg(F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high")).filter("low <> high")


def text_features(docs: DataFrame, buckets: int = 32, id_col: str = "doc_id", text_col: str = "text", pool_col: str = "source") -> DataFrame:
    """SRC11's stand-in for an encoder: counts of words by md5 bucket, one row for each document with words.

    A row holds all that its counts need, so they are made where it lies. buckets is at most 256.
    """
    kinds = dict(docs.dtypes)
    lowered = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("binary")
    table = docs.select(F.col(pool_col).alias("pool_id"), F.col(id_col).alias("row_id"), lowered.alias("b"))

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            out, keep = [], []
            for at, text in enumerate(batch.column("b")):
                counts = np.zeros(buckets)
                for w, n in Counter(text.as_py().split()).items():  # splits at \x20 and \x09-\x0D
                    b = known.get(w)
                    if b is None:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        b = known[w] = hashlib.md5(w).digest()[0] % buckets
                    counts[b] += n
                if counts.any():
                    out.append(counts)
                    keep.append(at)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("pool_id"), rows.column("row_id"), pa.array(out, pa.list_(pa.float64()))], names=["pool_id", "row_id", "features"])

    return table.mapInArrow(run, f"pool_id {kinds[pool_col]}, row_id {kinds[id_col]}, features array<double>")
