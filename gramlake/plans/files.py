"""Queries that write a feature table to the shared folder and load it by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramlake.functions import vectors as V
from gramlake.plans.fixtures import pools, table
from gramlake.plans.registry import query
from gramlake.plans.streams import scratch
from gramlake.plans.unary import R
from gramlake.sources import features as SRC
from gramlake.sources import sinks

_SPLIT = "CASE WHEN substr(md5(CAST(vec_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') THEN 'test' ELSE 'train' END"


def written(spark, sf) -> str:
    path = f"{scratch(spark)}/features"
    sinks.write_features(pools(spark, sf), path)
    return path


@query("loaded_features", f"""WITH r AS (SELECT 'p' || label AS pool_id, vec_id AS row_id, {_SPLIT} AS split, md5('42:' || vec_id) AS h FROM embeddings)
SELECT pool_id, row_id, 1.0 AS norm, 64 AS d FROM r WHERE split = 'train' AND pool_id IN ('p1', 'p2', 'p5') QUALIFY row_number() OVER (PARTITION BY pool_id ORDER BY h, row_id) <= 15""")
def loaded_features(spark, sf):
    """SRC2/SNK1: of three pools, the train rows, at most 15 each (the reader's cap), normalised."""
    f = SRC.load_features(spark, written(spark, sf), "emb", ["p1", "p2", "p5"], "train", 15)
    return f.select("pool_id", "row_id", R("norm", V.norm("features")), F.size("features").alias("d"))


@query("discovered_splits", f"SELECT DISTINCT 'emb' AS probe, 'p' || label AS pool_id, {_SPLIT} AS split FROM embeddings")
def discovered_splits(spark, sf):
    """SRC3 over a partitioned table."""
    return SRC.discover(spark, written(spark, sf))


@query("parsed_names", """WITH r AS (SELECT DISTINCT lang, source, CAST(doc_id % 4 AS INTEGER) AS s FROM documents)
SELECT DISTINCT lang AS probe, source AS pool_id, CASE s WHEN 1 THEN 'test' ELSE 'train' END AS split FROM r WHERE s < 3""")
def parsed_names(spark, sf):
    """SRC3 over flat file names, built from languages and sources with each suffix that there is."""
    suffix = F.element_at(F.array(*map(F.lit, ("_train", "_test", "", "_wl"))), (F.col("doc_id") % 4 + 1).cast("int"))
    names = table(spark, sf, "documents").select(F.concat(F.lit("feat_"), "lang", F.lit("_"), "source", suffix, F.lit(".npz")).alias("name")).distinct()
    return SRC.parse_names(names).select("probe", "pool_id", "split")
