"""Queries that run a stream to its end and read what it folded."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from gramlake.plans.fixtures import pools, sql_pools
from gramlake.plans.registry import query
from gramlake.plans.unary import R
from gramlake.streaming.fold import compact_fold, read_fold, start_fold, windowed_rates


def scratch(spark) -> str:
    """A folder that executors share; a local master may use its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or tempfile.gettempdir()}/gramlake-stream-{uuid.uuid4().hex}"


@query("stream_gram_d2", f"WITH {sql_pools()} SELECT pool AS pool_id, n, round(a, 6) AS g11, round(b, 6) AS g12, round(c, 6) AS g22 FROM g")
def stream_gram_d2(spark, sf):
    root = scratch(spark)
    rows = pools(spark, sf, dims=2)
    rows.repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    start_fold(stream, f"{root}/out", f"{root}/progress").awaitTermination()
    compact_fold(spark, f"{root}/out")
    f = read_fold(spark, f"{root}/out")
    return f.select("pool_id", "n", R("g11", F.element_at("gram", 1)), R("g12", F.element_at("gram", 2)), R("g22", F.element_at("gram", 4)))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def event_windows(spark, sf):
    from gramlake.plans.fixtures import table

    return windowed_rates(table(spark, sf, "events"), "ts", "event_type", "value").withColumn("mean", F.round("mean", 6))
