"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Each passage is described by counts over its bytes and words,
encoded by a learned layer; gated attention (tanh and sigmoid branches) weighs the encodings, and
the weighted sum is scored. Only documents carry labels; attention learns which passages matter.
Training runs on the driver over a bounded sample of labelled documents; scoring reads every
passage of every text, in Arrow batches.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.llm.common import text_or_empty

#: Bytes of a passage; passages end at the next white space.
PASSAGE = 768
#: At most so many labelled documents are learnt from, those first in hash order, and of them those
#: whose texts fit into so many bytes together. Each is learnt from whole.
TRAIN_DOCS, TRAIN_BYTES = 6000, 48 << 20
#: Columns that count words by hash, a power of two, and passages featurised at a time. Of 16, 64 and 256
#: columns, 16 had the least loss in cross-validation over the three quarters that may be learnt from (each
#: scored by a model of the other two): 0.065, 0.084 and 0.156 with 305 labels, 0.009, 0.029 and 0.113 with 1,800.
HASHED, SLAB = 16, 512
_LETTER = np.array([1 if chr(c).isalpha() and c < 128 or c >= 128 else 0 for c in range(256)], np.uint8)
_UPPER = np.array([1 if 65 <= c <= 90 else 0 for c in range(256)], np.uint8)
_DIGIT = np.array([1 if 48 <= c <= 57 else 0 for c in range(256)], np.uint8)
_SPACE = np.array([1 if c == 32 or 9 <= c <= 13 else 0 for c in range(256)], np.uint8)
_LINE = np.array([1 if c == 10 else 0 for c in range(256)], np.uint8)
_STOP = np.array([1 if c in b".,;:!?'\"()-" else 0 for c in range(256)], np.uint8)
_OTHER = ((_LETTER | _DIGIT | _SPACE | _STOP) == 0).astype(np.uint8)
_CLASSES = (_LETTER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _OTHER)
#: Bytes outside letters, digits and space each get a column of their own.
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
WIDTH = 14 + len(_MARKS) + HASHED


def passage_starts(data: np.ndarray) -> np.ndarray:
    """Where the passages of a text begin; the empty text has one."""
    n = len(data)
    cuts = np.arange(PASSAGE, n, PASSAGE)
    if not len(cuts):
        return np.zeros(1, np.int64)
    gaps = np.flatnonzero(_SPACE[data])
    at = np.searchsorted(gaps, cuts)
    ends = np.where(at < len(gaps), gaps[np.minimum(at, len(gaps) - 1)] if len(gaps) else cuts, n)
    ends = np.where(ends - cuts > PASSAGE, cuts, ends)  # without white space passages end where they are
    return np.unique(np.concatenate(([0], ends[ends < n])))


def passage_features(text: bytes) -> np.ndarray:
    """(passages, WIDTH) features; the empty text has one passage of zeros."""
    data = np.frombuffer(text, np.uint8)
    starts = passage_starts(data)
    ends = np.append(starts[1:], len(data))
    return np.vstack([_features_of(data[starts[i] : ends[min(i + SLAB, len(ends)) - 1]], starts[i : i + SLAB] - starts[i]) for i in range(0, len(starts), SLAB)])


def _features_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = len(data)
    if not n:
        return np.zeros((1, WIDTH), np.float32)
    space = _SPACE[data].astype(bool)
    m = len(starts)
    sizes = np.diff(np.append(starts, n)).astype(np.float32)
    which = np.repeat(np.arange(m), sizes.astype(np.int64))
    table = np.bincount(which * 256 + data, minlength=m * 256).reshape(m, 256).astype(np.float32)
    parts = [table @ c[:, None].astype(np.float32) / sizes[:, None] for c in _CLASSES]
    marks = table[:, _MARKS] / sizes[:, None]
    # words: a polynomial hash of each, from prefix sums
    begins, stops = np.concatenate(([True], space[:-1])), np.concatenate((space[1:], [True]))
    begins[starts], stops[starts[1:] - 1] = True, True  # a word longer than a passage is cut with it
    first, last = np.flatnonzero(~space & begins), np.flatnonzero(~space & stops) + 1
    hashed = np.zeros((m, HASHED), np.float32)
    extra = np.zeros((m, 6), np.float32)
    if len(first):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(n))))
        h = (sums[last] - sums[first]) * _inverse(n)[first]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        of = which[first]
        count = np.bincount(of, minlength=m).astype(np.float32)
        some = np.maximum(count, 1)
        size = (last - first).astype(np.float64)
        order = np.lexsort((h, of))
        ho, oo = h[order], of[order]
        fresh = np.concatenate(([True], (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])))
        extra[:, 0] = np.bincount(oo[fresh], minlength=m) / some
        extra[:, 1] = np.bincount(of, size, m) / some / 10
        extra[:, 2] = np.sqrt(np.maximum(np.bincount(of, size * size, m) / some - (np.bincount(of, size, m) / some) ** 2, 0)) / 10
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (of[1:] == of[:-1])))
        extra[:, 3] = np.bincount(of[again], minlength=m) / some
        extra[:, 4] = np.log1p(count) / 5
        # the last byte of a word tells of marks appended to each
        extra[:, 5] = np.bincount(of[_LETTER[data[last - 1]] == 0], minlength=m) / some
        hashed = np.bincount(of * HASHED + (h >> np.uint64(64 - HASHED.bit_length() + 1)).astype(np.int64), minlength=m * HASHED).reshape(m, HASHED).astype(np.float32) / some[:, None]
    return np.hstack([*parts, marks * 4, extra, np.log1p(sizes)[:, None] / 7, hashed]).astype(np.float32)


_POWERS: dict[str, np.ndarray] = {}


def _series(name: str, value: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 17), value, np.uint64)
        p[0] = 1
        have = _POWERS[name] = np.multiply.accumulate(p)
    return have[:n]


def _power(n: int) -> np.ndarray:
    return _series("p", 0x9E3779B97F4A7C15, n)


def _inverse(n: int) -> np.ndarray:
    return _series("i", pow(0x9E3779B97F4A7C15, -1, 2**64), n)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(model: dict, x: np.ndarray, bag: np.ndarray, n: int) -> dict:
    """Scores of n bags whose passages are the rows of x; bag: the sorted bag of each row."""
    h = np.tanh((x - model["mean"]) / model["std"] @ model["W"] + model["b"])
    t, g = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    e = (t * g) @ model["w"]
    first = np.searchsorted(bag, np.arange(n))  # every bag has a passage
    a = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a = a / np.bincount(bag, a, n)[bag]
    z = np.add.reduceat(a[:, None] * h, first)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ model["c"] + model["c0"])}


def gradient(model: dict, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict:
    """The mean log loss of bags with labels y, by each parameter."""
    n = len(y)
    f = forward(model, x, bag, n)
    h, t, g, a = f["h"], f["t"], f["g"], f["a"]
    dp = (f["p"] - y) / n
    dz = dp[:, None] * model["c"]
    da = (dz[bag] * h).sum(1)
    de = a * (da - np.bincount(bag, a * da, n)[bag])
    dt, dg = de[:, None] * g * model["w"] * (1 - t * t), de[:, None] * t * model["w"] * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ model["V"].T + dg @ model["U"].T) * (1 - h * h)
    xs = (x - model["mean"]) / model["std"]
    return {"c": f["z"].T @ dp, "c0": np.array([dp.sum()]), "w": (t * g).T @ de, "V": h.T @ dt, "U": h.T @ dg, "W": xs.T @ dh, "b": dh.sum(0)}


def train(bags: list[np.ndarray], labels: np.ndarray, width: int = 24, gate: int = 12, epochs: int = 30, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 5) -> dict:
    """Fit by Adam on the log loss. Without both labels the model scores the labels' mean (0.5 if none)."""
    rng = np.random.default_rng(seed)
    d = WIDTH
    model = {"W": rng.normal(0, d**-0.5, (d, width)), "b": np.zeros(width), "V": rng.normal(0, width**-0.5, (width, gate)), "U": rng.normal(0, width**-0.5, (width, gate)), "w": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, width**-0.5, width), "c0": np.zeros(1)}
    fixed = {"mean": np.zeros(d), "std": np.ones(d)}
    y = np.asarray(labels, float)
    if len(set(y.tolist())) < 2:
        rate_1 = float(y.mean()) if len(y) else 0.5
        model["c"] *= 0
        model["c0"] += np.log((rate_1 + 0.01) / (1.01 - rate_1))
        return model | fixed
    rows = np.vstack(bags)
    fixed = {"mean": rows.mean(0), "std": rows.std(0) + 1e-3}
    m1, m2, step = {k: 0.0 for k in model}, {k: 0.0 for k in model}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = np.vstack([bags[i] for i in pick])
            bag = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
            grad = gradient(model | fixed, x, bag, y[pick])
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k, v in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                model[k] = model[k] - lr * (m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8) + decay * model[k])
    return model | fixed


def score_texts(model: dict, texts: list[bytes]) -> np.ndarray:
    bags = [passage_features(t) for t in texts]
    x = np.vstack(bags)
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return forward(model, x, bag, len(bags))["p"]


def held_out(id_col: str = "doc_id"):
    """Rows that must not be learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features():
    def run(batches):
        for batch in batches:
            rows = [passage_features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], names=["label", "o", "x"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_bytes: int) -> list[tuple]:
    """(id, label, text bytes) of the documents learnt from: those of the first most labels in hash order
    that aren't held out and whose documents are there, each taken if it still fits. The driver sees at most
    most rows of numbers."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).filter(~held_out(id_col)).select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("label"))
    asked = docs.sparkSession.createDataFrame(known.orderBy(F.xxhash64(F.lit("train"), "lid"), "label").limit(most).collect(), known.schema)
    # at most most rows, so they go to the documents, whose texts and ids stay where they are
    size = F.octet_length(text_or_empty(text_col).cast("binary")).cast("long")
    rows = docs.select(F.col(id_col).alias("lid"), size.alias("size")).join(F.broadcast(asked), "lid").groupBy("lid", "label").agg(F.sum("size").alias("size")).select("lid", "label", "size").collect()
    taken, left = [], most_bytes
    for r in sorted(map(tuple, rows), key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]), r[1])):
        if r[2] <= left:
            taken.append(r)
            left -= r[2]
    return taken


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> dict:
    """The model learnt from at most most labelled documents that aren't held out, of most_bytes together."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, most, most_bytes)
    known = docs.sparkSession.createDataFrame([r[:2] for r in rows], f"lid {dict(docs.dtypes)[id_col]}, label int")
    used = docs.select(F.col(id_col).alias("lid"), text_or_empty(text_col).cast("binary").alias("b")).join(F.broadcast(known), "lid").select("b", "label", F.xxhash64("lid", "b").alias("o"))
    rows = used.mapInArrow(_features(), "label int, o bigint, x binary").collect()
    rows = sorted(((r["o"], r["label"], r["x"]) for r in rows), key=lambda r: r[:2])
    return train([np.frombuffer(x, np.float32).reshape(-1, WIDTH) for *_, x in rows], np.array([label for _, label, _ in rows]))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """(id, score under the given name) and the columns of keep, for every row; null texts count as empty, texts are read whole.

    Very long texts are featurised by themselves, short ones in small groups; repeated rows get
    equal scores. The score reads nothing but the text. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [id_col, *keep]

    def run(batches):
        model = shared.value
        for batch in batches:
            texts, done, part, size = batch.column(len(names)), [], [], 0
            for t in texts:
                part.append(t.as_py())
                size += len(part[-1])
                if size > 1 << 20:
                    done.append(score_texts(model, part))
                    part, size = [], 0
            if part:
                done.append(score_texts(model, part))
            p = np.concatenate(done) if done else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(p, pa.float64())], names=[*names, name])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + f", `{name}` double"
    return docs.select(*names, text_or_empty(text_col).cast("binary").alias("__b")).mapInArrow(run, schema)


def op5_query(spark, sf_dir):
    """The contract's rows over all of documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
