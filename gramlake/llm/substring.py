"""Substring dedup by longest-previous-factor arrays over suffix order.

A repeat of at least ``length`` bytes makes every window of that length in it occur twice. Each
window is assigned to its minimizer, the smallest-hashed k-mer in it (the leftmost of equals), so
equal windows carry equal minimizers at equal offsets wherever they are. Runs of windows with one
minimizer are segments; only segments whose minimizer occurs more than once in the corpus can hold
repeats, and segments equal as a whole are repeats throughout; they are named by 128 bits of BLAKE2 over their
bytes and the minimizer's offset, for which no two different strings with one name are known, made on purpose or not. What
is left, the distinct segments around the edges of repeats, is gathered by minimizer.

There the segments are laid over each other with their minimizers in one column, as windows that
agree lie in one column then. Going from the last column to the first, segments are kept in the
lexicographic order of their suffixes: one more byte in front is a stable sort by that byte, and the
common prefixes of neighbours (the LCP array) grow by one or start anew. At the columns where windows begin,
the previous and the next smaller text position in this order, among neighbours with a common prefix
of the full length, tell whether a window has an earlier match, and the larger ones whether it has a
later one: the longest-previous-factor array, cut at ``length``, and its mirror.

Minimizers with more text than a task should hold go another way: each of their windows is counted
by 128 bits of BLAKE2 in a shuffled aggregation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramlake.llm.common import discard, is_empty, stash, text_key, text_or_empty

CHUNK = 1 << 19
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any substring of a buffer, modulo 2**64 under two bases."""

    def __init__(self, size: int):
        self.symbols = [np.random.default_rng(s).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1) for s in (1, 2)]
        self.powers, self.inverses = [], []
        for base in _BASES:
            for value, into in ((base, self.powers), (pow(base, -1, 2**64), self.inverses)):
                p = np.full(size + 1, value, np.uint64)
                p[0] = 1
                into.append(np.multiply.accumulate(p))

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.symbols[which][data] * self.powers[which][: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, which: int, start, stop) -> np.ndarray:
        return (sums[stop] - sums[start]) * self.inverses[which][start]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n = len(x) - w + 1
    pad = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    pad[: len(x)] = x
    blocks = pad.reshape(-1, w)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[w - 1 : w - 1 + n])


def names(pieces) -> np.ndarray:
    """(pieces, 2) whole numbers: 128 bits of BLAKE2 of each."""
    return np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in pieces), "<i8").reshape(-1, 2)


def segments(data: np.ndarray, ends: np.ndarray, length: int, k: int, rolling: Rolling):
    """Segments of concatenated texts: (text, first window, bytes, minimizer hash, minimizer's offset).

    ends: where each text stops in data. Texts shorter than length have none. Minimizers of one hash share a
    task; whether they are equal is for their bytes to say.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64), empty
    a = rolling.sums(data, 0)
    at = np.arange(len(data) - k + 1)
    h = _mix(rolling.of(a, 0, at, at + k))
    low = sliding_min((h & ~np.uint64((1 << 20) - 1)) | at.astype(np.uint64), length - k + 1)
    pos = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
    s = np.arange(len(pos))
    text = np.searchsorted(ends, s, "right")
    valid = s + length <= ends[np.minimum(text, len(ends) - 1)]
    first = np.flatnonzero(valid & np.concatenate(([True], (pos[1:] != pos[:-1]) | ~valid[:-1])))
    last = np.flatnonzero(valid & np.concatenate(((pos[1:] != pos[:-1]) | ~valid[1:], [True])))
    return text[first], first, last + length - first, h[pos[first]], pos[first] - first


def _batches(keys, texts, size: int, overlap: int):
    """Texts joined up to size bytes; a longer text in pieces that overlap. Yields (data, ends, [(row, offset)])."""
    parts, rows, total = [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - overlap), size):
            part = text[at : at + size + overlap]
            if total + len(part) > size + overlap and parts:
                yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), rows
                parts, rows, total = [], [], 0
            parts.append(part)
            rows.append((row, at))
            total += len(part)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), rows


def find_segments(docs: DataFrame, length: int, k: int, text_col: str) -> DataFrame:
    """(ah, x, y, h1, h2, s0, len, off): minimizer, the segment's name, text key, first byte, bytes, minimizer's offset."""

    def run(batches):
        rolling = Rolling(CHUNK + 2 * length)
        for batch in batches:
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for data, ends, rows in _batches(None, (t.as_py() for t in batch.column(2)), CHUNK, length - 1):
                text, first, size, ah, off = segments(data, ends, length, k, rolling)
                whole = data.tobytes()
                name = names(whole[a : a + n] + bytes((o & 255, o >> 8)) for a, n, o in zip(first.tolist(), size.tolist(), off.tolist(), strict=True))
                rows = np.array(rows, np.int64).reshape(-1, 2)
                starts = np.concatenate(([0], ends[:-1]))
                row = rows[text, 0]
                s0 = first - starts[text] + rows[text, 1]
                yield pa.RecordBatch.from_arrays([pa.array(ah.view(np.int64)), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(h1[row]), pa.array(h2[row]), pa.array(s0), pa.array(size.astype(np.int32)), pa.array(off.astype(np.int32))], names=["ah", "x", "y", "h1", "h2", "s0", "len", "off"])

    table = docs.select(*text_key(text_col), text_or_empty(text_col).cast("binary").alias("b")).filter(F.octet_length("b") >= length)
    return table.mapInArrow(run, "ah bigint, x bigint, y bigint, h1 bigint, h2 bigint, s0 bigint, len int, off int")


def laid_over(data: np.ndarray, size: np.ndarray, offset: np.ndarray, length: int, k: int) -> np.ndarray:
    """(columns, pieces): bytes of the joined pieces plus 1, anchors in one column; 0 where there are none."""
    lead = length - k
    out = np.zeros((lead + length, len(size)), np.uint16)
    piece = np.repeat(np.arange(len(size)), size)
    column = np.arange(len(data)) - np.repeat(np.cumsum(size) - size + offset - lead, size)
    out[column, piece] = data.astype(np.uint16) + np.uint16(1)
    return out


def suffix_order(table: np.ndarray, group: np.ndarray):
    """From the last column to the first: (column, pieces in the order of their suffixes from there
    on, common prefix of each with the one before it). group is sorted; orders are within groups."""
    n = table.shape[1]
    order, lcp = np.arange(n), np.zeros(n, np.int32)
    place = group.astype(np.int64) << 9
    for column in range(len(table) - 1, -1, -1):
        key = place + table[column][order]
        at = None
        if (key[1:] < key[:-1]).any():
            at = np.argsort(key, kind="stable")
            key, order = key[at], order[at]
        same = key[1:] == key[:-1]
        grown = np.zeros(n, np.int32)
        if at is None:
            grown[1:][same] = lcp[1:][same] + 1
        else:
            before, now = at[:-1], at[1:]
            near = same & (now == before + 1)
            grown[1:][near] = lcp[now[near]] + 1
            far = np.flatnonzero(same & ~near)
            if len(far):
                # others lay between the two: the least common prefix on the way
                ends = np.stack((before[far] + 1, now[far] + 1), 1).ravel()
                grown[far + 1] = np.minimum.reduceat(np.append(lcp, np.int32(0)), ends)[::2] + 1
        lcp = grown
        yield column, order, lcp


def previous_factors(table: np.ndarray, group: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, windows) flags: does a window's neighbourhood of full common prefix in suffix order hold
    a smaller position (a previous factor of full length), and a larger one? Pieces are in text order."""
    starts = length - k + 1
    earlier, later = np.zeros((2, starts, table.shape[1]), bool)
    for column, order, lcp in suffix_order(table, group):
        if column >= starts:
            continue
        agrees = lcp >= length
        if not agrees.any():
            continue
        first = np.flatnonzero(~agrees)
        run = np.cumsum(~agrees) - 1
        earlier[column, order] = order > np.minimum.reduceat(order, first)[run]
        later[column, order] = order < np.maximum.reduceat(order, first)[run]
    whole = (table[:starts] > 0) & (table[length - 1 : length - 1 + starts] > 0)
    return (earlier & whole).T, (later & whole).T


def _spans(flags: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of flags within a group."""
    cut = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
    before = np.concatenate(([False], flags[:-1])) & ~cut
    after = np.concatenate((flags[1:] & ~cut[1:], [False])) if len(flags) else flags
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after)


def _match_bucket(length: int, k: int, keep_first: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("ah", "h1", "h2", "s0")])
        ah, h1, h2, s0, offset = (table.column(c).to_numpy() for c in ("ah", "h1", "h2", "s0", "off"))
        new = np.concatenate(([True], (ah[1:] != ah[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (s0[1:] != s0[:-1])))  # repeated rows
        pieces = table.column("bytes").filter(pa.array(new)).to_pylist()
        ah, h1, h2, s0, offset = (c[new] for c in (ah, h1, h2, s0, offset))
        size = np.array([len(p) for p in pieces], np.int64)
        group = np.cumsum(np.concatenate(([0], ah[1:] != ah[:-1])))
        laid = laid_over(np.frombuffer(b"".join(pieces), np.uint8), size, offset.astype(np.int64), length, k)
        earlier, later = previous_factors(laid, group, length, k)
        flags = earlier if keep_first else earlier | later
        # windows of a piece begin in the column of its first byte
        a, b = _spans(flags.ravel(), np.repeat(np.arange(len(size)), flags.shape[1]))
        g = a // flags.shape[1]
        begin = s0[g] - (length - k - offset[g])
        return pa.table({"h1": h1[g], "h2": h2[g], "start": begin + a % flags.shape[1], "stop": begin + b % flags.shape[1] + length})

    return run


def _hash_windows(length: int):
    def run(batches):
        for batch in batches:
            for h1, h2, s0, piece in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "s0", "bytes")), strict=True):
                n = len(piece) - length + 1
                name = names(piece[i : i + length] for i in range(n))
                columns = [name[:, 0], name[:, 1], np.full(n, h1), np.full(n, h2), s0 + np.arange(n)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["x", "y", "h1", "h2", "s"])

    return run


PIECE = pa.schema([("ah", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("s0", pa.int64()), ("off", pa.int32()), ("bytes", pa.binary())])


def _extract(batches):
    for batch in batches:
        rows, size = [], 0
        for h1, h2, text, needs in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            for need in needs:
                piece = text[need["s0"] : need["s0"] + need["len"]]
                rows.append((need["ah"], h1, h2, need["s0"], need["off"], piece))
                size += len(piece)
            if size > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE, strict=True)], schema=PIECE)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE, strict=True)], schema=PIECE)


def _cut():
    def run(batches):
        for batch in batches:
            rows = []
            for h1, h2, text, spans in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "b", "spans")), strict=True):
                kept, at, gone, n = [], 0, 0, 0
                reach = -1
                for start, stop in sorted((x["start"], x["stop"]) for x in spans):
                    if start > reach:
                        kept.append(text[max(at, 0) : start])
                        n += 1
                        gone += stop - start
                        at = reach = stop
                    elif stop > reach:
                        gone += stop - reach
                        at = reach = stop
                kept.append(text[at:])
                rest = b"".join(kept)
                rows.append((h1, h2, gone, n, hashlib.sha256(rest).hexdigest(), rest))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=True)], names=["h1", "h2", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep_first: bool = True, k: int = 48, bucket_bytes: int = 2 << 20, heavy_bytes: int = 8 << 20, texts: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes, if texts).

    Removed is every byte in a string of length bytes that starts anywhere else too (judged on the
    input, in one text or two). With keep_first only matches of an earlier start are removed, where
    earlier means the smaller text key, then position; of equal texts the row with the smallest id
    has the first copy. Null texts count as empty; texts under length bytes lose nothing; repeated
    rows are documents like others. Null ids are allowed. Other columns are not read. An empty
    table gives an empty result.
    """
    if not 16 <= k < length:
        raise ValueError("k must be 16 at least and less than length")
    light = stash(docs.select(F.col(id_col).alias("id"), *text_key(text_col), F.octet_length(text_or_empty(text_col).cast("binary")).cast("long").alias("n_bytes"), F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("sha")), "light")
    copies = stash(light.filter(F.col("n_bytes") >= length).groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("id").alias("first")), "copies")
    segs = stash(find_segments(docs, length, k, text_col), "segments")
    kinds = stash(segs.groupBy("ah", "x", "y").agg(F.count("*").alias("n"), F.min("h1").alias("r1")), "kinds")
    anchors = stash(kinds.groupBy("ah").agg(F.sum("n").alias("total"), F.sum((F.col("n") == 1).cast("int")).alias("single"), F.count("*").alias("kinds")).filter("total > 1").select("ah", F.col("single").cast("int").alias("single"), F.col("kinds").cast("int").alias("kinds")), "anchors")
    known = stash(kinds.join(anchors, "ah").select("ah", "x", "y", "r1", (F.col("n") > 1).alias("full"), ((F.col("single") > 0) if not keep_first else (F.col("kinds") > 1)).alias("open")), "known")
    discard(kinds, anchors)
    named = ["x", "y"] if keep_first else []
    seen = segs.join(known, ["ah", "x", "y"]).select("ah", *named, "h1", "h2", "s0", "len", "off", "full", (F.col("open") & (~F.col("full") | (F.col("h1") == F.col("r1")))).alias("need"), (F.col("h1") == F.col("r1")).alias("first"))
    # stored first: an aggregation on top would keep adaptive execution from splitting a hot segment
    kept = stash(seen, "seen")
    discard(segs, known)
    seen = kept.distinct()  # rows of equal texts are one text from here on
    full = seen.filter("full")
    if keep_first:
        nth = F.row_number().over(Window.partitionBy("ah", "x", "y", "h1").orderBy("h2", "s0"))
        full = full.filter("not first").unionByName(full.filter("first").withColumn("nth", nth).filter("nth > 1").drop("nth"))
    spans = full.select("h1", "h2", F.col("s0").alias("start"), (F.col("s0") + F.col("len")).alias("stop"))
    # one row of each text that has any repeated minimizer, with the text
    wanted = seen.select("h1", "h2").distinct().join(copies, ["h1", "h2"]).select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("first").alias("wid"))
    raw = docs.select(F.col(id_col).alias("id"), *text_key(text_col), text_or_empty(text_col).cast("binary").alias("b"))
    raw = raw.join(wanted, (raw["h1"] == wanted["w1"]) & (raw["h2"] == wanted["w2"]) & raw["id"].eqNullSafe(wanted["wid"]), "left_semi")
    work = stash(raw.select("h1", "h2", "b"), "work")
    needs = seen.filter("need").select("h1", "h2", "ah", "s0", "len", "off").distinct()
    weight = stash(needs.groupBy("ah").agg(F.sum("len").alias("bytes")), "weight")
    total = weight.filter(F.col("bytes") <= heavy_bytes).agg(F.sum("bytes")).first()[0] or 0
    heavy = weight.filter(F.col("bytes") > heavy_bytes).select("ah")
    any_heavy = not is_empty(heavy)
    gathered = needs.groupBy("h1", "h2").agg(F.collect_list(F.struct("ah", "s0", "len", "off")).alias("needs"))
    pieces = work.join(gathered, ["h1", "h2"]).select("h1", "h2", "b", "needs").mapInArrow(_extract, "ah bigint, h1 bigint, h2 bigint, s0 bigint, off int, bytes binary")
    buckets = max(1, -(-int(total) // bucket_bytes))
    if any_heavy:
        pieces = stash(pieces, "pieces")
        beyond = pieces.join(heavy, "ah", "left_semi")
        pieces = pieces.join(heavy, "ah", "left_anti")
    found = pieces.withColumn("bucket", F.pmod(F.xxhash64("ah"), F.lit(buckets))).groupBy("bucket").applyInArrow(_match_bucket(length, k, keep_first), "h1 bigint, h2 bigint, start bigint, stop bigint")
    spans = spans.unionByName(found)
    if any_heavy:
        windows = stash(beyond.mapInArrow(_hash_windows(length), "x bigint, y bigint, h1 bigint, h2 bigint, s bigint").distinct(), "windows")
        often = windows.groupBy("x", "y").agg(F.count("*").alias("n"), F.min(F.struct("h1", "h2", "s")).alias("first")).filter("n > 1").select(F.col("x").alias("fx"), F.col("y").alias("fy"), "first")
        hit = windows.join(often, (F.col("x") == F.col("fx")) & (F.col("y") == F.col("fy")))
        if keep_first:
            hit = hit.filter(F.struct("h1", "h2", "s") != F.col("first"))
        spans = spans.unionByName(hit.select("h1", "h2", F.col("s").alias("start"), (F.col("s") + length).alias("stop")))
    covered = spans.distinct().groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cut = work.join(covered, ["h1", "h2"]).select("h1", "h2", "b", "spans").mapInArrow(_cut(), "h1 bigint, h2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    cut = stash((cut if texts else cut.drop("kept")).dropDuplicates(["h1", "h2"]), "cut")
    discard(kept, work, weight)
    many = copies.filter("copies > 1").select("h1", "h2", "first")
    out = light.join(cut, ["h1", "h2"], "left").join(many, ["h1", "h2"], "left")
    whole = F.col("first").isNotNull()
    if keep_first:
        # of equal texts the first row keeps what its text keeps; one of its repeats, if there are any
        again = F.row_number().over(Window.partitionBy("h1", "h2", "id").orderBy(F.lit(0)))
        rows = out.filter("first is null").withColumn("again", F.lit(1)).unionByName(out.filter("first is not null").withColumn("again", again))
        out, whole = rows, F.col("first").isNotNull() & ~(F.col("id").eqNullSafe(F.col("first")) & (F.col("again") == 1))
    nothing = hashlib.sha256(b"").hexdigest()
    cols = [
        F.col("id").alias(id_col), "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"), F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if texts:
        cols.append(F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*cols)


def op10_query(spark, sf_dir):
    """The contract's rows over all of documents: every copy's bytes count as removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs, length=200, keep_first=False)
