"""Substring dedup by paragraphs: MinHash banding, exact verification, removal by components.

Paragraphs are lines. Passages can also hide inside lines or be wrapped over several, so every
window of ``PASSAGE`` words of a text is looked for as well, across its line breaks. Windows in a row whose smallest hash of ``SEED`` words is the same one make a
segment (winnowing): equal windows have equal seeds, wherever they lie. Equal segments repeat each
other as a whole; of seeds with several distinct segments the first copy of each is opened, and its
windows meet one by one. So every passage of ``PASSAGE`` words or more that is copied word by word
is found, in full length. Lines of fewer than ``BANDED`` words are matched as they are, since none of them is
similar to another without being equal, longer ones by similarity:

Each distinct line of enough words gets a MinHash signature over its
five-word shingles, cut into bands tuned for a recall; lines that collide in a band are
candidates. In a bucket of up to ``small`` distinct lines all pairs are verified. Those of up to
``TASK_SHINGLES`` together are connected within a task, over an inverted index of their shingles. In still
larger ones members are verified against leaders for a few rounds, in which those that match none
choose the next; then members that are still apart from the largest connected part of their bucket
meet all its other parts. So no bucket is paired with itself, and no connection is lost. Verification is the
exact Jaccard similarity of the shingle sets. Verified links join into components, and of each
component only the first occurrence stays.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gramlake.llm.common import discard, is_empty, stash, text_key, text_or_empty
from gramlake.llm.components import components
from gramlake.llm.substring import Rolling, _mix, sliding_min

CHUNK = 1 << 19
_C = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0xD1342543DE82EF95
#: Words of a passage, and words hashed for the choice of seeds.
PASSAGE, SEED = 50, 12
LEADER_ROUNDS = 3
#: Numbers (of texts, of buckets) that may be broadcast, 16 MB; more of them are joined by a shuffle.
FEW = 1 << 21
#: Shingles of a bucket's distinct lines that may meet in one task, 8 bytes each and some more for the index.
TASK_SHINGLES = 2_000_000
#: Words from which a line of five-word shingles can be similar without being equal: one word changed at
#: an end leaves n - 5 of n - 3 shingles, which is 0.8 or more from 13 words on.
BANDED = 13


def tune(threshold: float, recall: float, most: int = 12) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands, at most most, reach the recall at the threshold."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands <= most:
            return bands, rows
    return most, 1


class Shingler:
    """Words, paragraphs and shingle hashes of joined texts."""

    def __init__(self, n: int, size: int):
        self.n = n
        self.size = 0
        self._grow(size)
        lower = np.arange(256)
        lower[65:91] += 32
        self.lower = lower.astype(np.uint8)
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True

    def _grow(self, size: int) -> None:
        if size > self.size:
            self.size = size
            self.rolling = Rolling(size)
            self.powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, _BASE, np.uint64))))
            self.inverses = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, pow(_BASE, -1, 2**64), np.uint64))))

    def _words(self, texts: list[bytes]) -> None:
        joined = b"\n".join(texts)
        self._grow(len(joined))
        data = self.lower[np.frombuffer(joined, np.uint8)]
        space = self.space[data]
        before = np.concatenate(([True], space[:-1])) if len(data) else space
        after = np.concatenate((space[1:], [True])) if len(data) else space
        self.first, self.last = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        sums = self.rolling.sums(data, 0)
        self.words = _mix(self.rolling.of(sums, 0, self.first, self.last) + (self.last - self.first).astype(np.uint64))
        self.line = np.cumsum(data == 10)[self.first]  # over all texts; each text begins a new line
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(sizes + 1) - sizes - 1
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.words * self.powers[: len(self.words)])))

    def _unit(self, start, count):
        text = np.searchsorted(self.begins, self.first[start], "right") - 1
        name = _mix((self.total[start + count] - self.total[start]) * self.inverses[start] + count.astype(np.uint64))
        return text, self.first[start] - self.begins[text], self.last[start + count - 1] - self.begins[text], name

    def _lines(self):
        start = np.flatnonzero(np.concatenate(([True], self.line[1:] != self.line[:-1])) if len(self.line) else np.zeros(0, bool))
        return start, np.diff(np.append(start, len(self.line)))

    def short_lines(self, least: int, below: int):
        """Lines of the texts just read of least words or more, under below: (text, start, stop, id)."""
        start, count = self._lines()
        keep = (count >= least) & (count < max(below, self.n))
        return self._unit(start[keep], count[keep])

    def read(self, texts, least: int, whole: bool = False):
        """Lines of at least least words: (text, start, stop, id, shingle hashes, first shingle of each);
        start and stop are bytes of the text. whole: a text is one line."""
        self._words(texts)
        if whole:
            self.line = np.searchsorted(self.begins, self.first, "right")
        words = self.words
        start, count = self._lines()
        keep = count >= max(least, self.n)
        start, count = start[keep], count[keep]
        m = len(words) - self.n + 1
        if m <= 0 or not len(start):
            return *self._unit(start, count), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        hashes = np.zeros(m, np.uint64)
        for j in range(self.n):
            hashes += words[j : j + m] * _C[j]
        hashes = _mix(hashes)
        each = count - self.n + 1
        offset = np.cumsum(each) - each
        index = np.repeat(start - offset, each) + np.arange(each.sum())
        return *self._unit(start, count), hashes[index], offset

    def segments(self, length: int = PASSAGE, k: int = SEED):
        """Segments of the texts just read: (text, start, stop, id, seed)."""
        n = len(self.words) - length + 1
        if n <= 0:
            return *self._unit(np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(0, np.uint64)
        h = _mix((self.total[k:] - self.total[:-k]) * self.inverses[: len(self.words) - k + 1])
        low = np.uint64((1 << 24) - 1)
        at = np.arange(len(h), dtype=np.uint64)
        least = sliding_min((h & ~low) | (at & low), length - k + 1)
        s = np.arange(n)
        seed = s + ((least - s.astype(np.uint64)) & low).astype(np.int64)
        owner = np.searchsorted(self.begins, self.first, "right")
        valid = owner[s] == owner[s + length - 1]
        differs = seed[1:] != seed[:-1]
        first = np.flatnonzero(valid & np.concatenate(([True], differs | ~valid[:-1])))
        stop = np.flatnonzero(valid & np.concatenate((differs | ~valid[1:], [True]))) + length
        text, start, end, name = self._unit(first, stop - first)
        return text, start, end, _mix(name + (seed[first] - first).astype(np.uint64)), h[seed[first]]

    def windows(self, starts: np.ndarray, stops: np.ndarray, length: int = PASSAGE):
        """Windows of the one text just read that lie in [start, stop) bytes: (start, stop, id, which)."""
        a = np.searchsorted(self.first, starts)
        each = np.searchsorted(self.last, stops) + 1 - a - length + 1
        at = np.repeat(a - (np.cumsum(each) - each), each) + np.arange(each.sum())
        return *self._unit(at, np.full(len(at), length))[1:], np.repeat(np.arange(len(each)), each)


def signatures(hashes: np.ndarray, offset: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(paragraphs, bands) band keys."""
    out = np.empty((len(offset), bands), np.uint64)
    rng = np.random.default_rng(3)
    for b in range(bands):
        key = np.full(len(offset), b + 1, np.uint64)
        for _ in range(rows):
            a, c = (rng.integers(1, 2**63, 2, dtype=np.uint64) | np.uint64(1)).tolist()
            low = np.minimum.reduceat(hashes * np.uint64(a) + np.uint64(c), offset) if len(offset) else np.zeros(0, np.uint64)
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, b] = key
    return out


def _rows(batches):
    """(id, h1, h2, text, times) of sorted rows; equal neighbours are one row."""
    held, times = None, 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if held is not None and held[:3] == row[:3]:
                times += 1
                continue
            if held is not None:
                yield *held, times
            held, times = row, 1
    if held is not None:
        yield *held, times


def _groups(rows, size: int):
    part, total = [], 0
    for row in rows:
        part.append(row)
        total += len(row[3])
        if total >= size:
            yield part
            part, total = [], 0
    if part:
        yield part


def _listed(owner: np.ndarray, rows: int, names: list[str], columns: list) -> pa.Array:
    """For each row the structs that it owns; owner is sorted."""
    ends = np.cumsum(np.bincount(owner, minlength=rows)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(1, np.int32), ends))), pa.StructArray.from_arrays(columns, names=names))


LINE = "start int, stop int, pid bigint, bands array<bigint>"
SEGMENT = "start int, stop int, pid bigint, seed bigint"


def find_units(docs: DataFrame, id_col: str, text_col: str, n: int, least: int, bands: int, rows: int, short: int | None = None, whole: bool = False) -> DataFrame:
    """(doc, id, h1, h2, b, times, lines, segments): a row for each distinct row of docs, b its text.

    Rows are dealt out in order of id (null last), then text key; doc is where a text begins if all
    are joined in that order (with gaps between partitions). So doc + start orders all positions.
    lines: those of at least least words with their bands; if short is given, also those of at
    least short words without bands, and the segments of passages. whole: a text is one line.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc bigint, id {kind}, h1 bigint, h2 bigint, b binary, times int, lines array<struct<{LINE}>>, segments array<struct<{SEGMENT}>>"
    names = ["doc", "id", "h1", "h2", "b", "times", "lines", "segments"]

    def run(batches):
        shingler = Shingler(n, CHUNK * 2)
        at = TaskContext.get().partitionId() << 40
        for part in _groups(_rows(batches), CHUNK):
            ids, h1, h2, texts, times = zip(*part, strict=True)
            text, start, stop, name, hashes, offset = shingler.read(texts, least, whole)
            keys = signatures(hashes, offset, bands, rows).view(np.int64)
            more = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
            segments = [*more, np.zeros(0, np.uint64)]
            if short is not None:
                more, segments = shingler.short_lines(short, least), shingler.segments()
            text, start, stop, name = (np.concatenate(x) for x in zip((text, start, stop, name), more, strict=True))
            banded = pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(len(text) + 1), len(keys)) * bands, pa.int32()), pa.array(keys.ravel()))
            order = np.argsort(text, kind="stable")
            lines = _listed(text[order], len(part), ["start", "stop", "pid", "bands"], [pa.array(start[order], pa.int32()), pa.array(stop[order], pa.int32()), pa.array(name[order].view(np.int64)), banded.take(pa.array(order))])
            owner, first, end, pid, seed = segments
            found = _listed(owner, len(part), ["start", "stop", "pid", "seed"], [pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(pid.view(np.int64)), pa.array(seed.view(np.int64))])
            sizes = np.array([len(t) + 1 for t in texts], np.int64)
            doc = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(ids, arrow_kind), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(texts, pa.binary()), pa.array(times, pa.int32()), lines, found], names=names)

    arrow_kind = to_arrow_type(docs.schema[id_col].dataType)
    order = [F.col("id").isNull(), "id", "h1", "h2"]
    table = docs.select(F.col(id_col).alias("id"), *text_key(text_col), text_or_empty(text_col).cast("binary").alias("b"))
    return table.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _reread(n: int, least: int, whole: bool):
    """(doc, b, needs, starts) -> (doc, windows, sets): windows of the segments in needs, shingle sets
    of the lines at starts."""

    def run(batches):
        shingler = Shingler(n, CHUNK)
        for batch in batches:
            for doc, text, needs, starts in zip(*(batch.column(c) for c in range(4)), strict=True):
                _, start, _, name, hashes, offset = shingler.read([text.as_py()], least, whole)
                pick = np.flatnonzero(np.isin(start, np.array(starts.as_py() or [], np.int64)))
                ends = np.append(offset[1:], len(hashes))
                shingles = [np.unique(hashes[offset[i] : ends[i]]).view(np.int64) for i in pick]
                sets = _listed(np.zeros(len(pick), np.int64), 1, ["pid", "set"], [pa.array(name[pick].view(np.int64)), pa.array(shingles, pa.list_(pa.int64()))])
                if needs.is_valid:
                    first, stop, seed = (needs.values.field(f).to_numpy() for f in ("start", "stop", "seed"))
                    a, b, wid, of = shingler.windows(first, stop)
                    windows = [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(seed[of]), pa.array(wid.view(np.int64))]
                else:
                    windows = [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64())]
                windows = _listed(np.zeros(len(windows[0]), np.int64), 1, ["start", "stop", "seed", "wid"], windows)
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()]), windows, sets], names=["doc", "windows", "sets"])

    return run


def few(numbers: DataFrame) -> DataFrame:
    """A stashed column of numbers, to be broadcast if there are FEW at most."""
    return F.broadcast(numbers) if numbers.count() <= FEW else numbers


def reread(units: DataFrame, needs: DataFrame | None, asked: DataFrame, n: int, least: int, whole: bool = False) -> DataFrame:
    """The texts that needs(doc, needs) or asked(doc, starts) name are read once more."""
    if needs is None:
        both = asked.select(F.col("doc").alias("d"), F.lit(None).cast("array<struct<start:int,stop:int,seed:bigint>>").alias("needs"), "starts")
    else:
        both = needs.join(asked, "doc", "full").withColumnRenamed("doc", "d")
    both = stash(both, "named")
    texts = units.select("doc", "b")
    # the texts that nobody asks for stay where they are, or at least are not sorted
    texts = texts.join(few(both.select(F.col("d").alias("asking"))), F.col("doc") == F.col("asking"), "left_semi")
    rows = texts.join(both, F.col("doc") == F.col("d")).select("doc", "b", "needs", "starts")
    return rows.mapInArrow(_reread(n, least, whole), "doc bigint, windows array<struct<start int, stop int, seed bigint, wid bigint>>, sets array<struct<pid bigint, set array<bigint>>>")


def _firsts(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, first, keep, stop): how many there are, and position, doc and end of the first."""
    pos = F.col("doc") + F.col("start")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(pos).alias("first"), F.min_by("doc", pos).alias("keep"), F.min_by("stop", pos).alias("stop"))


def _later(rows: DataFrame, firsts: DataFrame, *keys: str) -> DataFrame:
    """(doc, start, stop, keep) of the rows that aren't the first of their key."""
    renamed = firsts.filter("n > 1").select(*(F.col(k).alias(f"of_{k}") for k in keys), "first", "keep")
    on = [F.col(k) == F.col(f"of_{k}") for k in keys]
    return rows.join(renamed, on).filter(F.col("doc") + F.col("start") != F.col("first")).select("doc", "start", "stop", "keep")


def _joined(spans: DataFrame) -> DataFrame:
    """Spans of a text that overlap and are kept by one row -> one span."""
    w = Window.partitionBy("doc", "keep").orderBy("start")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    new = new.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return new.groupBy("doc", "keep", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("doc", "start", "stop", "keep")


def _shared_bands(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (bucket, pid) of the bands that distinct lines share, and where each such line is first
    found, as (doc, starts)."""
    banded = lines.select("pid", F.explode("bands").alias("bucket"))
    shared = stash(banded.groupBy("bucket").agg(F.min("pid").alias("low"), F.max("pid").alias("high")).filter("low <> high").select("bucket"), "shared")
    members = stash(banded.join(few(shared), "bucket").select("bucket", "pid").distinct(), "members")
    discard(shared)
    wanted = members.select("pid").distinct()
    asked = _firsts(lines.filter(F.size("bands") > 0).join(wanted, "pid", "left_semi"), "pid")
    return members, asked.groupBy(F.col("keep").alias("doc")).agg(F.collect_list((F.col("first") - F.col("keep")).cast("int")).alias("starts"))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def connected(owners: np.ndarray, sizes: np.ndarray, values: np.ndarray, threshold: float) -> np.ndarray:
    """Component of each set under links of Jaccard similarity threshold or more.

    owners and values: the sets' elements, set by set; sizes: elements of each. A set is compared with
    all others by counting over an inverted index. Any link between two components has an end outside
    the largest, so only sets that are still outside it are compared; in a group of near copies few are.
    """
    n = len(sizes)
    inverse = np.unique(values, return_inverse=True)[1]
    order = np.argsort(inverse, kind="stable")
    posted = owners[order]
    ptr = np.concatenate(([0], np.cumsum(np.bincount(inverse, minlength=1))))
    stops = np.cumsum(sizes)
    label = np.arange(n)
    compared = np.zeros(n, bool)
    while True:
        counts = np.bincount(label, minlength=n)
        open_ = np.flatnonzero(~compared & (label != counts.argmax()))
        if not len(open_):
            return label
        u = open_[0]
        compared[u] = True
        near = np.concatenate([posted[ptr[x] : ptr[x + 1]] for x in inverse[stops[u] - sizes[u] : stops[u]]])
        common = np.bincount(near, minlength=n)
        parts = np.unique(label[common >= threshold * (sizes[u] + sizes - common)])
        if len(parts) > 1:
            label[np.isin(label, parts)] = parts[0]


def _connect(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("pid").to_numpy()
        sets = table.column("set").combine_chunks()
        sets = pa.concat_arrays(sets.chunks) if isinstance(sets, pa.ChunkedArray) else sets
        sizes = sets.value_lengths().to_numpy().astype(np.int64)
        label = connected(np.repeat(np.arange(len(ids)), sizes), sizes, sets.flatten().to_numpy(), threshold)
        at = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"u": ids[at], "v": ids[label[at]]})

    return run


def similar_links(members: DataFrame, sets: DataFrame, threshold: float, small: int, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """(u, v) verified links among the members (bucket, pid) of buckets, enough to connect what all
    pairs within buckets would connect."""

    def verify(pairs):
        a = sets.select(F.col("pid").alias("u"), F.col("set").alias("su"))
        b = sets.select(F.col("pid").alias("v"), F.col("set").alias("sv"))
        both = pairs.join(a, "u").join(b, "v")
        common = F.size(F.array_intersect("su", "sv"))
        return both.filter(common >= F.lit(threshold) * (F.size("su") + F.size("sv") - common)).select("u", "v")

    weights = sets.select(F.col("pid").alias("of"), F.size("set").cast("long").alias("shingles"))
    weighed = members.join(weights, F.col("pid") == F.col("of"), "left")
    sizes = stash(weighed.groupBy("bucket").agg(F.count("*").alias("n"), F.coalesce(F.sum("shingles"), F.lit(0)).alias("shingles")), "sizes")
    sized = members.join(sizes, "bucket")
    few = sized.filter(F.col("n") <= small).groupBy("bucket").agg(F.collect_list("pid").alias("p"))
    few = few.select(F.explode(F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b > a), lambda b: F.struct(b.alias("u"), a.alias("v")))))).alias("e")).select("e.u", "e.v")
    links = verify(few.distinct())
    # middling buckets: the members' sets meet in a task, which gives back one link for each member at most
    some = sized.filter((F.col("n") > small) & (F.col("shingles") <= task_shingles)).select("bucket", "pid").join(sets, "pid").select("bucket", "pid", "set")
    links = stash(links.unionByName(some.groupBy("bucket").applyInArrow(_connect(threshold), "u bigint, v bigint")).distinct(), "links")
    # larger ones never meet in a task
    large = stash(sized.filter((F.col("n") > small) & (F.col("shingles") > task_shingles)).select("bucket", "pid"), "large")
    if is_empty(large):
        return links
    rest = large
    for _ in range(LEADER_ROUNDS):
        lead = stash(rest.groupBy("bucket").agg(F.min("pid").alias("low"), F.max("pid").alias("high")), "lead")
        near = rest.join(lead, "bucket").select("bucket", "pid", F.explode(F.array("low", "high")).alias("leader"))
        found = stash(verify(_pairs(near.select(F.col("pid").alias("u"), F.col("leader").alias("v")))), "found")
        links = links.unionByName(found)
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"))).select(F.col("u").alias("pid"), F.col("v").alias("leader"))
        done = near.join(both, ["pid", "leader"], "left_semi").select("bucket", "pid").unionByName(near.filter("pid = leader").select("bucket", "pid"))
        rest = stash(rest.join(done.distinct(), ["bucket", "pid"], "left_anti"), "rest")
        if is_empty(rest):
            break
    # what is not yet connected to the largest part of its bucket meets all other parts of it
    links = stash(links.distinct(), "links")
    roots = stash(components(links), "parts")
    sized = sets.select(F.col("pid").alias("__p"), F.size("set").alias("size"))
    placed = large.join(roots, large["pid"] == roots["node"], "left").select("bucket", "pid", F.coalesce("root", "pid").alias("root"))
    placed = stash(placed.join(sized, placed["pid"] == sized["__p"]).select("bucket", "pid", "root", "size"), "placed")
    main = placed.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts"))
    main = stash(main.filter("parts > 1").select("bucket", F.col("top.root").alias("main")), "main")
    apart = placed.join(main, "bucket")
    stray = apart.filter("root <> main").select("bucket", F.col("pid").alias("u"), F.col("root").alias("ru"), F.col("size").alias("su"))
    t = F.lit(threshold)
    across = stray.join(apart.select("bucket", F.col("pid").alias("v"), F.col("root").alias("rv"), F.col("size").alias("sv")), "bucket")
    across = across.filter((F.col("ru") != F.col("rv")) & (F.col("su") >= t * F.col("sv")) & (F.col("sv") >= t * F.col("su")))
    return links.unionByName(verify(_pairs(across.select("u", "v"))))


def paragraph_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, least: int = BANDED, recall: float = 0.999, small: int = 32, task_shingles: int = TASK_SHINGLES, short: int = 5) -> DataFrame:
    """One row per row of docs: id, n_units (lines and segments looked at), n_removed (spans), spans
    (removed bytes [start, stop) of the text, one for each line and each passage; they may overlap),
    keep_ids (for each the id of the row that keeps it), h1, h2.

    Lines of short words or more, but fewer than least, repeat each other only if they are equal (case
    and white space aside); shorter ones count as parts of passages alone. Lines and passages are
    judged on the input, each for itself. Null and empty texts have no units. The first occurrence of
    a component stays: smallest id (null last), then text key, then position. Repeated rows are one
    text, whose units are judged once. Other columns are not read. An empty table gives an empty
    result. Segments, windows and lines are named by 64 bits of hash each, segments and windows within those of one seed; similar lines are compared over 64-bit hashes of their shingles.
    """
    bands, rows = tune(threshold, recall)
    units = stash(find_units(docs, id_col, text_col, n, least, bands, rows, short), "units")
    lines, segments = units.select("doc", F.inline("lines")), units.select("doc", F.inline("segments"))
    # equal segments, and the seeds whose segments differ
    kinds = stash(_firsts(segments, "seed", "pid"), "kinds")
    # stored first: an aggregation on top would keep adaptive execution from splitting a hot segment
    copies = stash(_later(segments, kinds, "seed", "pid"), "copies")
    open_ = kinds.groupBy("seed").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("seed")
    needs = kinds.join(open_, "seed").groupBy(F.col("keep").alias("doc")).agg(F.collect_list(F.struct((F.col("first") - F.col("keep")).cast("int").alias("start"), "stop", "seed")).alias("needs"))
    members, asked = _shared_bands(lines)
    again = stash(reread(units, needs, asked, n, least), "again")
    discard(kinds)
    # what the first copy of a segment loses, all its copies lose too: they are removed whole already
    windows = again.select("doc", F.inline("windows"))
    later = stash(_later(windows, _firsts(windows, "seed", "wid"), "seed", "wid"), "later")
    links = similar_links(members, again.select(F.inline("sets")), threshold, small, task_shingles)
    roots = stash(components(links), "roots")
    discard(members, again)
    # lines that occur once and are similar to none are through
    often = lines.groupBy("pid").agg(F.count("*").alias("n")).filter("n > 1").select("pid")
    often = often.unionByName(roots.select(F.col("node").alias("pid"))).distinct()
    placed = lines.select("doc", "start", "stop", "pid").join(often, "pid")
    placed = stash(placed.join(roots, placed["pid"] == roots["node"], "left").select("doc", "start", "stop", F.coalesce("root", "pid").alias("root")), "placed")
    gone = _later(placed, _firsts(placed, "root"), "root").unionByName(copies).unionByName(_joined(later))
    ids = units.select(F.col("doc").alias("kept_doc"), F.col("id").alias("keep_id"))
    gone = gone.join(ids, gone["keep"] == ids["kept_doc"]).groupBy(F.col("doc").alias("of")).agg(F.sort_array(F.collect_set(F.struct(F.struct(F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop")).alias("span"), F.col("keep_id").alias("keep")))).alias("gone"))
    n_units = (F.size("lines") + F.size("segments")).cast("bigint")
    light = units.select("doc", "id", "h1", "h2", n_units.alias("n_units"), F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    out = light.join(gone, light["doc"] == gone["of"], "left")
    kind = dict(docs.dtypes)[id_col]
    return out.select(
        F.col("id").alias(id_col), "n_units", F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.col("gone.span"), F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"), F.coalesce(F.col("gone.keep"), F.array().cast(f"array<{kind}>")).alias("keep_ids"), "h1", "h2",
    )


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999, small: int = 32, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """One row per row of docs: id, component_id, kept, h1, h2, where whole documents are compared.

    The same banding, verification and components with each text as one line. component_id is the
    smallest id of the component (null ids rank last); kept marks its first row (then smallest text
    key; repeated rows are all marked). Texts of fewer than n words, null and empty ones are alone,
    unless their rows repeat. An empty table gives an empty result.
    """
    bands, rows = tune(threshold, recall)
    units = stash(find_units(docs, id_col, text_col, n, n, bands, rows, whole=True), "units")
    lines = units.select("doc", F.inline("lines"))
    members, asked = _shared_bands(lines)
    again = stash(reread(units, None, asked, n, n, whole=True), "again")
    roots = components(similar_links(members, again.select(F.inline("sets")), threshold, small, task_shingles))
    discard(members, again)
    named = units.select("doc", "id", "h1", "h2", F.get("lines", F.lit(0))["pid"].alias("pid"), F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    placed = stash(named.join(roots, named["pid"] == roots["node"], "left").select("doc", "id", "h1", "h2", F.coalesce("root", "pid").alias("root")), "placed")
    first = placed.filter("root is not null").groupBy(F.col("root").alias("of")).agg(F.min("doc").alias("first"), F.min_by("id", "doc").alias("first_id"))
    out = placed.join(first, placed["root"] == first["of"], "left")
    alone = F.col("of").isNull()
    return out.select(F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("first_id")).alias("component_id"), (alone | (F.col("doc") == F.col("first"))).alias("kept"), "h1", "h2")


def without_paragraphs(docs: DataFrame, result: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed spans taken out of their texts (a cut may leave white space behind)."""
    names = docs.columns
    hit = result.filter("n_removed > 0").select(F.col(id_col).alias("__i"), F.col("h1").alias("__a"), F.col("h2").alias("__b"), F.col("spans").alias("__gone")).distinct()
    h1, h2 = text_key(text_col)
    rows = docs.select("*", h1.alias("__h1"), h2.alias("__h2")).join(hit, F.col(id_col).eqNullSafe(F.col("__i")) & (F.col("__h1") == F.col("__a")) & (F.col("__h2") == F.col("__b")), "left")
    b = F.col(text_col).cast("binary")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<binary>").alias("kept"))

    def step(acc, s):
        part = F.substring(b, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["kept"], F.array(part)).alias("kept"))

    def rest(acc):
        tail = F.substring(b, (acc["at"] + 1).cast("int"), F.octet_length(b))
        return F.array_join(F.transform(F.concat(acc["kept"], F.array(tail)), lambda x: F.decode(x, "UTF-8")), "")

    cut = F.aggregate(F.col("__gone"), zero, step, rest)
    return rows.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(cut)).select(*names)


def op8_query(spark, sf_dir):
    """Every document, and which lines and passages of it repeat earlier ones."""
    return paragraph_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h1", "h2")
