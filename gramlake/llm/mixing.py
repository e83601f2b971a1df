"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document draws an exponential key, -ln(u) / weight, from a hash of its own content, so a
re-run agrees. Within a source, documents in key order fill the word budget that complete epochs
leave. The prefix sum never needs a source in one task: keys are cut into ranges of about equal row
counts, ranges are summed, and only the range in which a budget ends is looked at row by row. The
cuts are quantiles of the keys' distribution, which the counts of weights give: of rows that weigh
w a share of 1 - exp(-w x) has keys up to x.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramlake.llm.common import WORD, stash, text_key, text_or_empty

#: Marks whose share lowers a document's quality weight.
SYMBOLS = "#$%&*|@~^<>{}[]\\_=+"
ROWS_A_RANGE = 4096


def quality_weight(text_col: str = "text"):
    """Weight in [0.05, 1]: falls with the share of symbols. The empty text weighs 1."""
    text = text_or_empty(text_col)
    n = F.length(text)
    share = (n - F.length(F.translate(text, SYMBOLS, ""))) / F.greatest(n, F.lit(1))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * share)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) -> plus target.

    Sources in code-point order (null last) take the weights in turn and share the sum of all
    sizes; no target exceeds most times its source, and the excess is shared again by weight until
    none does. That fixed point has one level: targets are min(most * size, level * weight), where
    the sources with the smallest most * size / weight are the full ones. One row per source here.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    t = sizes.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    t = t.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    # the level that holds is the one at the first source that isn't full
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(Window.partitionBy())
    t = t.withColumn("at", level)
    return t.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("at.level") * F.col("w")).cast("double").alias("target"))


def _level(weight):
    """Weights in steps of a square root of two, for counting."""
    return F.greatest(F.lit(-60), F.least(F.lit(60), F.round(F.log2(weight) * 2))).cast("int")


def key_share(levels, key):
    """Share of a source's rows, counted as (level, share) structs, whose keys are expected up to key."""
    parts = F.transform(levels, lambda x: x["share"] * (F.lit(1.0) - F.exp(-key * F.pow(F.lit(2.0), x["level"] / 2))))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, weight=None, seed: int = 7) -> DataFrame:
    """One row per row of docs: id, size, source, source_size, target, taken, h1, h2.

    size is the number of words (null text: 0). A source whose target is e times its size plus a
    remainder takes each document e times, then documents in key order while they fit into the
    remainder. What is left takes, from the rest of that key range, documents that fit, in key order,
    and then the one nearest in size, if that comes nearer to the target. Empty documents take
    nothing. weight: a positive column, such as a classifier's score; null weighs 1.
    Ties in the key go by text key, then id; repeated rows draw the same key and are interchangeable.
    A null source is a source of its own, ordered last. Tables without rows or words give targets of 0.
    """
    weight = quality_weight(text_col) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))
    h1, h2 = text_key(text_col)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), h1, h2), 11) + F.lit(0.5)) / F.lit(float(2**53))
    light = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint").alias("size"), h1, h2,
        (-F.log(u) / weight).alias("key"), _level(weight).alias("level"),
    )
    light = stash(light, "sizes")
    per_level = light.groupBy("source", "level").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    per_source = per_level.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("rows"), F.collect_list(F.struct("level", "n")).alias("levels"))
    shares = F.transform(F.array_sort("levels"), lambda x: F.struct(x["level"].alias("level"), (x["n"] / F.col("rows")).alias("share")))
    rows = per_source.select("source", "rows", shares.alias("levels"))
    targets = source_targets(per_source.select("source", "source_size"), weights, most)
    plan = targets.join(rows.select(F.col("source").alias("s2"), "rows", "levels"), F.col("source").eqNullSafe(F.col("s2"))).select(
        F.col("source").alias("s"), "source_size", "target", "levels", F.greatest(F.ceil(F.col("rows") / ROWS_A_RANGE), F.lit(1)).alias("ranges"),
        F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("bigint").alias("epochs"),
    )
    plan = stash(plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    keyed = light.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("range", F.floor(key_share(F.col("levels"), F.col("key")) * F.col("ranges"))).drop("levels", "level")
    sums = keyed.groupBy("s", "budget", "range").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = sums.withColumn("upto", upto).select(
        F.col("s").alias("s3"), F.col("range").alias("range3"), (F.col("upto") - F.col("words")).alias("before"), (F.col("upto") <= F.col("budget")).alias("inside"), ((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") < F.col("budget"))).alias("edge")
    )
    sums = stash(sums, "ranges")
    placed = keyed.join(sums, F.col("s").eqNullSafe(F.col("s3")) & (F.col("range") == F.col("range3")))
    own = Window.partitionBy("s")
    cols = ["id", "h1", "h2", "source", "size", "source_size", "target", "epochs"]
    edge = placed.filter("edge").withColumn("sum", F.col("before") + F.sum("size").over(own.orderBy("key", "h1", "h2", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edge = edge.withColumn("fits", F.col("sum") <= F.col("budget"))
    edge = edge.withColumn("left", F.col("budget") - F.max(F.when(F.col("fits"), F.col("sum")).otherwise(F.col("before"))).over(own))
    # of the rest, numbered in key order, some more fill what is left: a range's rows, so few numbers
    edge = edge.withColumn("nth", F.row_number().over(own.orderBy("fits", "key", "h1", "h2", "id")))
    open_ = edge.filter("not fits and size > 0").groupBy("s").agg(F.max("left").alias("left"), F.sort_array(F.collect_list(F.struct("nth", "size"))).alias("open"))
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<int>").alias("picked"))
    fill = F.aggregate("open", start, lambda a, x: F.when(x["size"] <= a["left"], F.struct((a["left"] - x["size"]).alias("left"), F.array_append(a["picked"], x["nth"]).alias("picked"))).otherwise(a))
    open_ = open_.withColumn("fill", fill)
    others = F.filter("open", lambda x: ~F.array_contains(F.col("fill.picked"), x["nth"]))
    off = F.array_min(F.transform(others, lambda x: F.struct(F.abs(x["size"] - F.col("fill.left")).alias("off"), x["nth"].alias("nth"))))
    open_ = open_.withColumn("last", off)
    picked = F.when(F.col("last.off") < F.col("fill.left"), F.array_append("fill.picked", F.col("last.nth"))).otherwise(F.col("fill.picked"))
    edge = edge.join(open_.select(F.col("s").alias("s4"), picked.alias("picked")), F.col("s").eqNullSafe(F.col("s4")), "left")
    edge = edge.select(*cols, (F.col("fits") | F.coalesce(F.array_contains("picked", F.col("nth")), F.lit(False))).alias("more"))
    rest = placed.filter("not edge").select(*cols, F.col("inside").alias("more"))
    out = rest.unionByName(edge)
    return out.select(F.col("id").alias(id_col), "size", "source", F.col("source_size").cast("bigint"), "target", (F.col("size") * (F.col("epochs") + F.col("more").cast("bigint"))).alias("taken"), "h1", "h2")


def repeat_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it."""
    names = docs.columns
    copies = F.coalesce(F.try_divide("taken", "size"), F.lit(0)).cast("int")
    often = mixed.groupBy(F.col(id_col).alias("__i"), F.col("h1").alias("__a"), F.col("h2").alias("__b")).agg(F.sum(copies).cast("int").alias("__n")).filter("__n > 0")
    h1, h2 = text_key(text_col)
    rows = docs.select("*", F.col(id_col).alias("__id"), h1.alias("__h1"), h2.alias("__h2"))
    rows = rows.join(often, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h1") == F.col("__a")) & (F.col("__h2") == F.col("__b")))
    rows = rows.dropDuplicates(["__id", "__h1", "__h2"])
    return rows.select(*names, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy")).select(*names)


def op6_query(spark, sf_dir):
    """The contract's rows over all of documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
