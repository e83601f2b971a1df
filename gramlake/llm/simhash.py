"""SimHash near-dedup by multi-index hashing.

Fingerprints are split into two 32-bit segments, each with a table from segment value to the
fingerprints that own it. Of two fingerprints at most two bits apart, either the second segments
agree, or the first ones differ by at most one bit. So each fingerprint fetches its own bucket of
both tables and, in the first table, the buckets in the Hamming ball of radius one around its
segment; complete distances are verified inside the fetched row. Only zero bits are flipped: of
two neighbours one reaches the other that way.

Buckets above a size are never paired. Every fingerprint that owns or meets one is linked through
its full Hamming ball of radius one instead: two fingerprints are at most two bits apart exactly
if their balls meet, and a point lies in at most 65 balls, so nothing grows with the bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.llm.common import discard, stash, text_key, text_or_empty
from gramlake.llm.components import components

SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, n: int) -> list[int]:
    """XXH64 of each n-word shingle of the lower-cased text; the whole sequence if it is shorter."""
    words = text.translate(_LOWER).split()  # bytes.split() takes \x20 and \x09-\x0D
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())]


def fingerprints(texts: list[bytes], n: int = 3, step: int = 65536) -> np.ndarray:
    """SimHash of each text as a signed 64-bit number; zero for a text without words."""
    out = np.zeros(len(texts), "<i8")
    for i, text in enumerate(texts):
        h = np.array(shingle_hashes(text, n), "<u8")
        if not len(h):
            continue
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), step):
            bits = np.unpackbits(h[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int32)
        out[i] = np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]
    return out


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, h1, h2, fp) for each row."""

    def run(batches):
        for batch in batches:
            texts = batch.column(3)
            fps = np.concatenate([fingerprints([t.as_py() for t in texts.slice(at, 256)], shingle) for at in range(0, len(texts), 256)] or [np.zeros(0, "<i8")])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(fps, pa.int64())], names=["id", "h1", "h2", "fp"])

    kind = dict(docs.dtypes)[id_col]
    table = docs.select(F.col(id_col).alias("id"), *text_key(text_col), text_or_empty(text_col).cast("binary").alias("b"))
    return table.mapInArrow(run, f"id {kind}, h1 bigint, h2 bigint, fp bigint")


def _near(a, b, bits: int):
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def links(fps: DataFrame, cap: int = 64) -> DataFrame:
    """(u, v) links among the distinct fingerprints fps(fp): enough to connect exactly those whose
    graph of distances of at most 2 is connected."""
    low32 = F.lit(0xFFFFFFFF)
    owned = fps.select("fp", F.posexplode(F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(low32))).alias("seg", "key"))
    sizes = stash(owned.groupBy("seg", "key").agg(F.count("*").alias("n")), "sizes")
    own = owned.join(sizes, ["seg", "key"])
    small = own.filter(F.col("n") <= cap).groupBy("seg", "key").agg(F.collect_list("fp").alias("members"))
    large = sizes.filter(F.col("n") > cap).select("seg", "key", F.array().cast("array<bigint>").alias("members"))
    table = stash(small.unionByName(large), "table")
    # radius 0 in both tables: pairs inside a bucket
    inside = table.filter(F.size("members") > 1).select(
        F.explode(F.flatten(F.transform("members", lambda a: F.transform(F.filter("members", lambda b: (b > a) & _near(a, b, 2)), lambda b: F.struct(b.alias("u"), a.alias("v")))))).alias("e")
    ).select("e.u", "e.v")
    # radius 1 in the first table
    ball = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.shiftrightunsigned("fp", 32).bitwiseOR(F.expr("1L") * F.pow(F.lit(2.0), i).cast("bigint"))), lambda k: k != F.shiftrightunsigned("fp", 32))
    probes = fps.select("fp", F.explode(ball).alias("key"))
    first = table.filter("seg = 0").select("key", "members")
    met = stash(
        probes.join(first, "key").select("fp", F.filter("members", lambda m: _near(m, F.col("fp"), 2)).alias("found"), (F.size("members") == 0).alias("big")).filter(F.col("big") | (F.size("found") > 0)),
        "met",
    )
    across = met.filter(~F.col("big")).select(F.explode("found").alias("u"), F.col("fp").alias("v"))
    # large buckets: owners and those that meet one are linked through ball points
    hot = own.filter(F.col("n") > cap).select("fp").unionByName(met.filter("big").select("fp")).distinct()
    points = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.when(i < 63, F.pow(F.lit(2.0), F.least(i, F.lit(62))).cast("bigint")).otherwise(F.lit(-(2**63))))))
    met_at = hot.select("fp", F.explode(points).alias("point")).groupBy("point").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    star = met_at.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).filter("u <> v")
    return inside.unionByName(across).unionByName(star).distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, cap: int = 64) -> DataFrame:
    """One row per row of docs: id, fingerprint (hex), component_id, kept, h1, h2.

    component_id is the smallest id that can be reached over links of at most two differing bits;
    kept marks one row of each component: the smallest id, then the smallest text key, and of
    repeated rows all (keep_rows leaves one). A null text counts as empty; texts without words
    have fingerprint zero and are linked like any other. Null ids rank last, and name a component
    only if it has no other. Other columns are not read; an empty table gives an empty result.
    """
    base = stash(with_fingerprint(docs, id_col, text_col, shingle), "fingerprints")
    fps = stash(base.select("fp").distinct(), "fps")
    roots = components(links(fps, cap))
    classes = base.join(roots, base["fp"] == roots["node"], "left").select("id", "h1", "h2", "fp", F.coalesce("root", "fp").alias("root"))
    classes = stash(classes, "classes")
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("h1").alias("h1"), F.col("h2").alias("h2"))).alias("first"))
    discard(base, fps)
    return classes.join(first, "root").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2"))).alias("kept"), "h1", "h2",
    )


def op4_query(spark, sf_dir):
    """The contract's rows over all of documents: three-word shingles, two bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_dedup(docs, shingle=3).select("doc_id", "fingerprint", "component_id")
