"""Connected components by alternating large-star and small-star rounds.

Edges never meet in one task: every round takes minima per node (combined before the shuffle)
and joins them back. The edges of each half round are written to the shared folder, which cuts lineage;
a star's hot centre is an ordinary skewed sort-merge join, which adaptive execution splits.
Rounds grow with the logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.llm.common import discard, stash


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u") % 1000003).alias("s")).first()
    return row["n"], row["x"], row["s"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    low = low.select(F.col("u").alias("w"), F.least("u", "low").alias("low"))
    joined = edges.join(low, edges["u"] == low["w"]).select("u", "v", "low")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        moved = joined.filter(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        out = moved.unionByName(low.select(F.col("w").alias("u"), F.col("low").alias("v")))
    return stash(out.filter(F.col("u") != F.col("v")).distinct(), "star")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links over orderable nodes -> (node, root): root is the smallest node reachable.

    Loops and repeated links change nothing; nodes without links don't appear; no links, no rows.
    """
    e = edges.select("u", "v").filter(F.col("u") != F.col("v"))
    e = stash(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _signature(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = _star(both, large=True)
        tight = _star(wide, large=False)
        discard(wide, e)
        e, after = tight, _signature(tight)
        if after == before:
            break
        before = after
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
