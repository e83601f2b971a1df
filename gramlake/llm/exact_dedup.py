"""Exact dedup by deterministic block naming.

Texts are normalised (each run of white space becomes one space) and cut into blocks of fixed
size. The distinct blocks are sorted and numbered: equal blocks, and only those, get one integer
name. Adjacent names are then named pair by pair until one name is left, which identifies the
whole text without any chance of collision.

Names travel back to their blocks over a 128-bit hash, which only routes: a naming is used once
it is shown on the blocks themselves that no two distinct blocks share a hash. If any do, the
blocks are routed by their own bytes instead, which costs one more exchange of the text. So the
text otherwise crosses the network to be named alone, combined beforehand, and a hot group of
copies is a single row from each map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.llm.common import SPACE, discard, is_empty, stash, text_key, text_or_empty


def normalised(text_col: str = "text"):
    return F.regexp_replace(text_or_empty(text_col), SPACE, " ")


def _blocks(size: int):
    """Blocks of the binary column b; the empty text has one empty block."""
    last = F.greatest(F.ceil(F.octet_length("b") / F.lit(size)).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("b"), i * size + 1, F.lit(size)))


def _route(block, bits: int | None):
    """What names travel by: bits of hash, or the block itself."""
    if bits is None:
        return block
    high, low = (F.xxhash64(F.lit(seed), block) for seed in (0, 1))
    return F.struct(F.shiftrightunsigned(high, max(0, 128 - bits) // 2).alias("a"), F.shiftrightunsigned(low, (max(0, 128 - bits) + 1) // 2).alias("b"))


def name_blocks(docs: DataFrame, text_col: str, size: int, bits: int | None) -> tuple[DataFrame, bool]:
    """(h, name) of every distinct block, and whether each h stands for one block.

    Blocks are sorted within the partitions that their distinct values are dealt to, and numbered
    through all of them. (One order over all partitions gave the same groups, but its range bounds
    are drawn from whole blocks on the driver: 37 MB from 0.5 GB.)
    """
    blocks = docs.select(normalised(text_col).cast("binary").alias("b")).select(F.explode(_blocks(size)).alias("block"))
    ordered = blocks.distinct().sortWithinPartitions("block")
    names = stash(ordered.select(_route(F.col("block"), bits).alias("h"), F.monotonically_increasing_id().alias("name")), "names")
    return names, bits is None or is_empty(names.groupBy("h").count().filter("count > 1"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, route_bits: int = 128) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, n_bytes, h1, h2.

    A null text counts as empty. Of equal texts the row with the smallest id stays (null ids come
    last); of repeated rows with one id and text exactly one is kept. Other columns of docs are not
    read. An empty table gives an empty result. h1 and h2 name the raw text, for joining back.
    """
    bits: int | None = min(route_bits, 128)
    names, clean = name_blocks(docs, text_col, block_bytes, bits)
    if not clean:
        discard(names)
        bits = None
        names, _ = name_blocks(docs, text_col, block_bytes, bits)
    h1, h2 = text_key(text_col)
    base = docs.select(F.col(id_col).alias("id"), h1, h2, normalised(text_col).alias("norm")).select("id", "h1", "h2", "norm", F.col("norm").cast("binary").alias("b"))
    base = stash(
        base.select(
            F.monotonically_increasing_id().alias("rid"), "id", "h1", "h2", F.octet_length("b").cast("long").alias("n_bytes"), F.sha2("b", 256).alias("text_sha256"),
            F.transform(_blocks(block_bytes), lambda x: _route(x, bits)).alias("hs"),
        ),
        "base",
    )
    # level 0: a row for each block of a text, with its name
    spread = base.select("rid", F.posexplode("hs").alias("pos", "h"))
    level, used = spread.join(names, "h").select("rid", "pos", "name"), names
    done, depth = [], 0
    while True:
        # texts with a single name are through; the others name their adjacent pairs
        pairs = level.groupBy("rid", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"), F.max("pos").alias("top")
        )
        pairs = stash(pairs.select("rid", "pos", "a", F.coalesce("b", F.lit(-1)).alias("b"), (F.col("pos") + F.col("top") > 0).alias("more")), "pairs")
        # blocks are numbered without gaps, so a lone block at position 0 is a whole text
        done.append((depth, pairs.filter("not more").select("rid", F.col("a").alias("name"))))
        todo = pairs.filter("more")
        discard(used)
        if is_empty(todo):
            break
        depth += 1
        named = stash(todo.groupBy("a", "b").count().sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name")), "pairnames")
        level, used = todo.join(named, ["a", "b"]).select("rid", "pos", "name"), named
    identity = None
    for at, part in done:
        part = part.select("rid", F.lit(at).alias("depth"), "name")
        identity = part if identity is None else identity.unionByName(part)
    whole = stash(base.drop("hs").join(identity, "rid"), "whole")
    groups = whole.groupBy("depth", "name").agg(
        F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("rid").alias("rid"))).alias("first"), F.count("*").alias("group_size")
    )
    out = whole.join(groups, ["depth", "name"])
    return out.select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256", "n_bytes", "h1", "h2"
    )


def op3_query(spark, sf_dir):
    """The contract's rows over all of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
