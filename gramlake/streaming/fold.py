"""Structured Streaming over pool summaries (an extension: the batch operators define the results).

Gram matrices add, so a stream of feature rows is folded into (pool, n, gram, colsum) state one
micro-batch at a time. Each batch writes its own deltas under its batch id, which makes a replayed
batch overwrite itself (exactly once); readers add deltas up. Compaction adds all deltas up to a
batch into one sum named after that batch; readers take the latest sum and the deltas after it, so
a compaction that breaks off changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.operators.gram import pool_grams, sum_grams

KEYS = ["probe", "pool_id"]


def start_fold(stream: DataFrame, target: str, checkpoint: str, trigger: dict | None = None):
    """Start folding a stream of feature rows into deltas below target; returns the query."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch that is replayed after a compaction is in the sum already
        if batch_id <= _last_sum(batch.sparkSession, target):
            return
        pool_grams(batch, KEYS).drop("d").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _last_sum(spark: SparkSession, target: str) -> int:
    """The last batch that a compaction has added up; -1 before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    exists = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return _parts(spark, target)[0] if exists else -1


def _parts(spark: SparkSession, target: str) -> tuple[int, list[str]]:
    """(last batch in the latest whole sum or -1, folders to read): that sum and the deltas after it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory() and fs.exists(done(f.getPath(), "_SUCCESS"))]
    last = max((int(n[4:]) for n in names if n.startswith("sum=")), default=-1)
    return last, [f"{target}/{n}" for n in names if n == f"sum={last}" or n.startswith("batch=") and int(n[6:]) > last]


def read_fold(spark: SparkSession, target: str) -> DataFrame:
    """The summaries of all rows folded so far."""
    parts = spark.read.parquet(*_parts(spark, target)[1])
    return sum_grams(parts, KEYS).withColumn("d", F.size("colsum"))


def compact_fold(spark: SparkSession, target: str) -> None:
    """Add the deltas so far into one sum and remove what it replaces. The sum is named after the last
    batch in it, and batches up to that one are not written again."""
    last, folders = _parts(spark, target)
    upto = max((int(f.rsplit("=", 1)[1]) for f in folders), default=-1)
    if upto <= last:
        return
    read_fold(spark, target).drop("d").write.mode("overwrite").parquet(f"{target}/sum={upto}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in folders:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)


def windowed_rates(stream: DataFrame, time_col: str, by: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means by tumbling window, closed by a watermark; works on batch frames too."""
    rows = stream.withWatermark(time_col, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(time_col, size).alias("w"), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), by, "n", "mean")
