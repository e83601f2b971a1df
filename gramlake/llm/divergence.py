"""Source divergence audit: which sources of a language use their words unlike the others.

Most distinct words of a corpus stand in one or two documents and would fill the shuffle for
nothing. So a first pass adds document frequencies to a count-min sketch, in counters that stop at
the least frequency asked for; the sketches of the partitions are merged in levels of ``FAN``. A
cell never says less than the truth, so a term with a cell below the least frequency cannot qualify
and is left out by the second pass, which counts exactly what survives: occurrences for each
language, source and term, and documents for each language and term. What the sketch let through
wrongly goes by the exact document frequency.

Divergences are sums over all kept terms of a language, also those that a source lacks, yet only
pairs of occurrences are joined. With p0 and q0 as the values of a term that doesn't occur, and
f(p, q) as the term's share of the divergence,

    sum over all terms = V f(p0, q0) + sum over terms of the one  (f(p, q0) - f(p0, q0))
                                     + sum over terms of the other (f(p0, q) - f(p0, q0))
                                     + sum over terms of both      (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))

The sums over one side need only the number of its terms at each count; the last is a join by term.
All arithmetic is on integers. Sketch width and depth set how much is shuffled, never the result.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlake.llm.common import discard, stash

#: Cells of a slab; a sketch travels in slabs.
SLAB = 1 << 16
#: Sketches merged by one task.
FAN = 64
#: Distinct terms a task holds before it passes them on.
HELD = 1 << 19
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes, slab: int = 1 << 22):
    """Lists of a text's terms: letters A-Z (lower-cased), a-z and everything beyond ASCII.

    A long text comes in several lists, cut between terms.
    """
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        stop = folded.find(b" ", at + slab)
        stop = len(folded) if stop < 0 else stop
        yield folded[at:stop].split()
        at = stop


def cells(lang: bytes, words: list[bytes], width: int, depth: int) -> np.ndarray:
    """(depth, words) cells of a language's terms, numbered through all rows of the sketch; width is a power of two."""
    seed = zlib.crc32(lang)
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    step = (h >> np.uint64(32)) | np.uint64(1)
    rows = np.arange(depth, dtype=np.uint64)[:, None]
    return ((h + rows * step) & np.uint64(width - 1)) + rows * np.uint64(width)


class Frequencies:
    """A count-min sketch of document frequencies whose counters stop at most."""

    def __init__(self, width: int, depth: int, most: int):
        self.width, self.depth, self.most = width, depth, most
        self.table = np.zeros(width * depth, np.uint8)

    def add(self, lang: bytes, found: Counter) -> None:
        if not found:
            return
        at = cells(lang, list(found), self.width, self.depth)
        n = np.minimum(np.fromiter(found.values(), np.uint64, len(found)), np.uint64(self.most))
        for row in at:
            # cell and count in one number: plain numbers sort much faster than places do
            both = np.sort(row << np.uint64(8) | n)
            cell = (both >> np.uint64(8)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            to = cell[first]
            self.table[to] = np.minimum(self.table[to] + np.add.reduceat(both & np.uint64(255), first), np.uint64(self.most))

    def slabs(self):
        """(number, cells) of the slabs that hold anything."""
        for i, at in enumerate(range(0, len(self.table), SLAB)):
            part = self.table[at : at + SLAB]
            if part.any():
                yield i, zlib.compress(part.tobytes(), 1)


def _columns(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    return docs.select(read(lang_col).alias("lang"), read(source_col).alias("source"), read(text_col).alias("text"))


def sketched(docs: DataFrame, width: int, depth: int, least: int) -> bytes:
    """One bit for each cell of the merged sketch of docs(lang, text): does it reach least?

    The bits are width * depth / 8 bytes whatever the corpus; they are all that the driver sees.
    """

    def run(batches):
        sketch, held, size = Frequencies(width, depth, least), defaultdict(Counter), 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                found = set()
                for words in terms(text.as_py()):
                    found.update(words)
                counter = held[lang.as_py()]
                size -= len(counter)
                counter.update(found)
                size += len(counter)
                if size > HELD:
                    for k, c in held.items():
                        sketch.add(k, c)
                    held.clear()
                    size = 0
        for k, c in held.items():
            sketch.add(k, c)
        part = TaskContext.get().partitionId()
        for i, data in sketch.slabs():
            yield pa.RecordBatch.from_pydict({"slab": pa.array([i], pa.int32()), "part": pa.array([part], pa.int32()), "cells": pa.array([data], pa.binary())})

    def merge(key, table):  # FAN compressed slabs
        total = np.zeros(SLAB, np.uint8)
        for data in table.column("cells"):
            part = np.frombuffer(zlib.decompress(data.as_py()), np.uint8)
            total[: len(part)] = np.minimum(total[: len(part)] + part, least)
        return pa.table({"slab": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "slab int, part int, cells binary"
    found = stash(docs.select("lang", "text").mapInArrow(run, schema), "sketches")
    while (found.agg(F.max("part")).first()[0] or 0) > 0:
        merged = found.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("slab", "part").applyInArrow(merge, schema)
        merged = stash(merged, "sketches")
        discard(found)
        found = merged

    def pack(batches):
        for batch in batches:
            bits = [np.packbits(np.frombuffer(zlib.decompress(c.as_py()), np.uint8) >= least).tobytes() for c in batch.column("cells")]
            yield pa.RecordBatch.from_arrays([batch.column("slab"), pa.array(bits, pa.binary())], names=["slab", "bits"])

    out = bytearray(-(-width * depth // 8))
    for row in found.mapInArrow(pack, "slab int, bits binary").collect():
        out[row["slab"] * SLAB // 8 : row["slab"] * SLAB // 8 + len(row["bits"])] = row["bits"]
    discard(found)
    return bytes(out)


def possible(bits: np.ndarray, lang: bytes, words: list[bytes], width: int, depth: int) -> np.ndarray:
    """Which terms may be frequent enough: all their cells are."""
    at = cells(lang, words, width, depth)
    flags = (bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1
    return flags.all(axis=0)


def surviving(docs: DataFrame, bits: bytes, width: int, depth: int) -> DataFrame:
    """(lang, source, term, n, docs): partial counts of the terms that the sketch lets through.

    Every occurring language and source has a row with the empty term as well.
    """
    if width & (width - 1):
        raise ValueError("width must be a power of two")
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("lang", pa.binary()), ("source", pa.binary()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        table = np.frombuffer(shared.value, np.uint8)
        held, size = {}, 0

        def passed_on():
            for (lang, source), (n, d) in held.items():
                words = list(d)
                keep = pa.array(possible(table, lang, words, width, depth)) if words else pa.array([], pa.bool_())
                counts = [pa.array([n[w] for w in words], pa.int64()), pa.array(d.values(), pa.int64())]
                kept = [c.filter(keep) for c in (pa.array(words, pa.binary()), *counts)]
                some = pa.Table.from_arrays([pa.chunked_array([c, pa.array([v], c.type)]) for c, v in zip(kept, (b"", 0, 0), strict=True)], names=["term", "n", "docs"])
                for part in some.to_batches(1 << 16):
                    own = [pa.repeat(pa.scalar(v, pa.binary()), len(part)) for v in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*own, *part.columns], schema=schema)

        for batch in batches:
            for lang, source, text in zip(*batch.columns, strict=True):
                n, d = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                size -= len(d)
                found = set()
                for words in terms(text.as_py()):
                    n.update(words)
                    found.update(words)
                d.update(found)
                size += len(d)
                if size > HELD:
                    yield from passed_on()
                    held, size = {}, 0
        yield from passed_on()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang binary, source binary, term binary, n bigint, docs bigint")


def share(n: str, total: str, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / total), exact; null where total is 0."""
    wide = f"(cast({scale} as decimal(18, 0)) * cast({n} + 1 as decimal(20, 0))) div nullif(cast({total} as decimal(20, 0)), 0)"
    return F.expr(f"1 + if({n} < {2**62 // scale}, ({scale} * (cast({n} as bigint) + 1)) div nullif({total}, 0), {wide})")


def excess(p: str, q: str) -> Column:
    """floor((p - q)^2 / q)."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 3, top: int = 200, scale: int = 10**9, width: int = 1 << 22, depth: int = 4) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs.

    Part ``pair``: each other source of the language (item) with the divergence of the source's
    distribution of terms from that one's. Part ``term``: the top terms that the source has more often
    than its language, by their share of the divergence from the language. Kept terms are those in
    at least ``least`` documents of the language; ranks count from 1 by value, descending, then item.

    Null texts, languages and sources count as empty; the empty language or source is one like any
    other. Repeated rows are documents like others. A language without kept terms gives pairs of value
    0 and no terms; a source without others gives no pairs. Other columns are not read; an empty
    table gives an empty result.
    """
    table = _columns(docs, lang_col, source_col, text_col)
    bits = sketched(table, width, depth, least)
    # by language and term: what one task needs of a term is a row for each source and partial count
    counts = surviving(table, bits, width, depth).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    counts = counts.select("lang", "source", "term", "n", F.sum("docs").over(of).alias("df"), F.sum("n").over(of).alias("total"), (F.min("source").over(of) == F.col("source")).alias("once"))
    none = F.octet_length("term") == 0
    kept = stash(counts.filter(none | (F.col("df") >= least)).select("lang", "source", "term", "n", "total", (F.col("once") & ~none).alias("once")), "kept")

    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum(F.col("once").cast("bigint")).alias("v"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n")).join(langs, "lang")
    groups = groups.select("lang", "source", "v", (F.col("source_n") + F.col("v")).alias("d"), (F.col("lang_n") + F.col("v")).alias("lang_d"))
    groups = stash(groups.withColumn("p0", share("0", "d", scale)), "groups")
    rows = kept.filter(~none).join(groups, ["lang", "source"])

    # terms that stand out
    rated = rows.select("lang", "source", "term", share("n", "d", scale).alias("p"), share("total", "lang_d", scale).alias("q")).filter("p > q")
    rated = rated.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess("p", "q").alias("value"))
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rated = rated.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= top)

    # pairs: what doesn't occur in either, in one, in both
    a = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "v")
    b = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    pairs = a.join(b, "lang").filter("a <> b")
    base = pairs.select("lang", "a", "b", F.coalesce(F.col("v") * excess("a0", "b0"), F.lit(0).cast("bigint")).alias("value"))
    levels = rows.groupBy("lang", "source", "n", "d").agg(F.count("*").alias("m"))
    levels = levels.select("lang", F.col("source").alias("a"), share("n", "d", scale).alias("p"), "m")
    single = pairs.join(levels, ["lang", "a"])
    forth = single.select("lang", "a", "b", (F.col("m") * (excess("p", "b0") - excess("a0", "b0"))).alias("value"))
    back = single.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), (F.col("m") * (excess("b0", "p") - excess("b0", "a0"))).alias("value"))
    sides = [rows.select("lang", "term", F.col("source").alias(s), share("n", "d", scale).alias(f"{s}p"), F.col("p0").alias(f"{s}0")) for s in ("a", "b")]
    met = sides[0].join(sides[1], ["lang", "term"]).filter("a < b")
    both = lambda x, y: F.sum(excess(f"{x}p", f"{y}p") - excess(f"{x}p", f"{y}0") - excess(f"{x}0", f"{y}p") + excess(f"{x}0", f"{y}0"))
    met = met.groupBy("lang", "a", "b").agg(both("a", "b").alias("ab"), both("b", "a").alias("ba"))
    met = met.select("lang", F.explode(F.array(F.struct(F.col("a"), F.col("b"), F.col("ab").alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ba").alias("value")))).alias("x")).select("lang", "x.*")
    total = base.unionByName(forth).unionByName(back).unionByName(met).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b")
    total = total.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value", F.row_number().over(order).alias("rank"))
    out = total.unionByName(rated)
    return out.select(F.col("lang").cast("string"), F.col("source").cast("string"), "part", F.col("item").cast("string"), F.col("value").cast("bigint"), "rank")


def op11_query(spark, sf_dir):
    """The contract's rows over all of documents: terms in three documents, 200 of them a group."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     o AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
     t AS (SELECT lang, term, count(*) AS c, count(DISTINCT rid) AS df FROM o GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
     g AS (SELECT DISTINCT lang, source FROM d),
     c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN t USING (lang, term) GROUP BY ALL),
     n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
     v AS (SELECT lang, count(term) AS v, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang FROM g) LEFT JOIN t USING (lang) GROUP BY ALL),
     p AS (SELECT g.lang, g.source, t.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (n.n + v.v)::HUGEINT AS p
           FROM g JOIN t USING (lang) JOIN n USING (lang, source) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
     q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (v.n + v.v)::HUGEINT AS q FROM t JOIN v USING (lang)),
     pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
     terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
