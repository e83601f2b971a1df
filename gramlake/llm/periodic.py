"""Runs of periodic words in documents, by bit-parallel lags.

A document's words are numbered, and the numbers' binary digits make bit planes: big integers with a
bit for each word. Shifting a plane by a lag q and XORing it with itself marks the words that differ
in this digit from the word q further on; ORed over the planes that gives all mismatches at lag q.
A run of period q is a long stretch of zeros there. AND with itself, shifted by 1, 2, 4 and so on,
leaves only the places where enough zeros follow, whole machine words at a time.

Not all lags can have a run, and long texts have many. In a run of period q and four periods, equal
blocks of q to 2q words follow each other at distance q and no nearer (a shorter distance would be a
shorter period), at more than q places. So blocks of 1, 2, 4, ... words are named by ranks, each from
two of the size before; lags that are not often the distance between equal neighbours have no run.
This only leaves out lags that cannot succeed, and ends as soon as no block of some size comes twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.llm.common import SPACE, text_or_empty

#: Periods that a run has at least, and words.
PERIODS, WORDS = 4, 6


def lags(ids: np.ndarray) -> list[int]:
    """The lags at which a run of PERIODS periods is possible, ascending."""
    n, names, size, out = len(ids), ids.astype(np.int64), 1, []
    while size // 2 < n // PERIODS and len(names) > 1:
        order = np.argsort(names, kind="stable")
        equal = names[order[1:]] == names[order[:-1]]
        if not equal.any():
            break
        gaps = (order[1:] - order[:-1])[equal]
        gaps = gaps[(gaps > size // 2) & (gaps <= size)]
        if len(gaps):
            often = np.bincount(gaps)
            out += np.flatnonzero(often > np.arange(len(often))).tolist()
        ranks = np.empty(len(names), np.int64)
        ranks[order] = np.concatenate(([0], np.cumsum(~equal)))
        names = ranks[:-size] * (int(ranks.max()) + 1) + ranks[size:]
        size *= 2
    return [q for q in out if 0 < q <= n // PERIODS]


def planes(ids: np.ndarray) -> list[int]:
    """Bit planes: bit i of plane b is digit b of ids[i]."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(top)]


def matches(bits: list[int], n: int, lag: int) -> int:
    """Bit i is set if words i and i + lag are equal."""
    differ = 0
    for plane in bits:
        differ |= plane ^ (plane >> lag)
    mask = (1 << (n - lag)) - 1
    return ~differ & mask


def stretches(same: int, least: int) -> list[tuple[int, int]]:
    """(first, bits) of each maximal stretch of least or more set bits."""
    have = 1
    while have < least and same:
        step = min(have, least - have)
        same &= same >> step
        have += step
    if not same:
        return []
    bits = np.unpackbits(np.frombuffer(same.to_bytes(-(-same.bit_length() // 8), "little"), np.uint8), bitorder="little")
    edge = np.diff(np.concatenate(([0], bits, [0])).astype(np.int8))
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(a), int(b - a + least - 1)) for a, b in zip(first, stop, strict=True)]


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, by start, then period."""
    possible = lags(ids)
    if not possible:
        return []
    bits, n, found = planes(ids), len(ids), {}
    for q in possible:
        # a stretch of a shorter period that divides q comes again at lag q, with the same ends
        for start, zeros in stretches(matches(bits, n, q), max(WORDS, PERIODS * q) - q):
            found.setdefault((start, zeros + q), q)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what any run repeats after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per row of docs: id, runs array<struct<start, length, period>>, collapsed_sha256 (and collapsed, the text, if texts).

    Words are what white space separates, numbered from 0. A run is a maximal stretch of words with
    smallest period q, of max(6, 4 q) words or more; runs may overlap. collapsed joins the words by
    one space, without those that any run contains after its first q words.

    A null text counts as empty and has no runs; null ids are kept, repeated rows are judged alike.
    Long texts are whole: n words take about n log n steps and n / 64 for each possible lag. Other columns are
    not read; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = text.as_py().split()  # bytes.split() takes \x20 and \x09-\x0D
                found = runs(numbered(words))
                rows.append((*(zip(*found, strict=True) if found else ((), (), ())), b" ".join(collapsed(words, found))))
            at, length, period, rest = zip(*rows, strict=True) if rows else ((), (), (), ())
            digest = [hashlib.sha256(r).hexdigest() for r in rest]
            many = [pa.array([list(r) for r in c], pa.list_(pa.int64())) for c in (at, length, period)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *many, pa.array(digest, pa.string()), pa.array(rest if texts else [None] * len(rows), pa.binary())], names=["id", "at", "length", "period", "sha", "rest"])

    table = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("b"))
    out = table.mapInArrow(run, f"id {kind}, at array<bigint>, length array<bigint>, period array<bigint>, sha string, rest binary")
    each = F.transform(F.arrays_zip("at", "length", "period"), lambda x: F.struct(x["at"].alias("start"), x["length"].alias("length"), x["period"].alias("period")))
    return out.select(F.col("id").alias(id_col), each.alias("runs"), F.col("sha").alias("collapsed_sha256"), *([F.col("rest").cast("string").alias("collapsed")] if texts else []))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs(id, text) with the contract's periods written over the ends of a tenth of the texts.

    A null id leaves its text as it is.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    text = text_or_empty(text_col)
    words = F.array_remove(F.split(text, SPACE), "")

    def rewritten(w):
        n, g = F.size(w).cast("bigint"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, rewritten(w)).otherwise(text))[0]
    return docs.select(F.col(id_col), F.when(h % 10 == 0, changed).otherwise(text).alias(text_col))


def op12_query(spark, sf_dir):
    """The contract's rows over all of documents."""
    docs = planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = periodic_runs(docs, texts=False)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    out = found.withColumn("best", best)
    none = F.size("runs") == 0
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * -best.l) div best.period").alias("exponent_milli"), F.sha2(F.when(none, F.lit("")).otherwise(F.concat(lines, F.lit("\n"))).cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256",
    )


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o FROM documents),
     h AS (SELECT *, len(o) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c : ascii(c)::BIGINT)),
             lambda s, b : list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z : xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) AS h FROM d),
     g AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
     p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
     t AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i : o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE o END AS words FROM p),
     w AS (SELECT rid, n, unnest(range(n)) AS i, unnest(words) AS word FROM t),
     m AS (SELECT a.rid, b.i - a.i AS q, a.i FROM w a JOIN w b ON a.rid = b.rid AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
     s AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS part FROM m) GROUP BY rid, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
     r AS (SELECT rid, start, length, min(q) AS q FROM s GROUP BY ALL),
     best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, q) = 1),
     lines AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM r GROUP BY rid),
     gone AS (SELECT DISTINCT w.rid, w.i FROM w JOIN r ON w.rid = r.rid AND w.i >= r.start + r.q AND w.i < r.start + r.length),
     rest AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS rest FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM t LEFT JOIN lines USING (rid) LEFT JOIN best USING (rid) LEFT JOIN rest USING (rid)
"""
