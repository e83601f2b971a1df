"""Search, archives, classifier, mixing, pieces, chat and the pipeline."""

import base64
import collections
import hashlib

import edges
import numpy as np
import pytest

from gramlake.llm import chat, mixing, pieces, quality, topk, warc
from oracle import check, connect


# ---- top-k ------------------------------------------------------------------------------------


def test_top_k_sql(spark, sf):
    check(spark, sf, topk.op1_query, topk.OP1_SQL)


def test_no_random_access_keeps_ties():
    r = np.random.default_rng(0)
    for k, kind in ((1, float), (6, float), (6, object)):
        c = r.integers(-20, 20, (1500, 5)).astype(kind)
        c[:, 0] *= 10**25 if kind is object else 30
        for q in (r.integers(-9, 9, 5).astype(kind), np.zeros(5, int).astype(kind), np.array([7, 0, 0, 0, 0]).astype(kind), np.array([-3, 0, 2, 0, 0]).astype(kind)):
            score = c @ q
            best = sorted(score)[-k]
            for floor in (None, float(best) if kind is float else None, float(sorted(score)[-4 * k]) if kind is float else None):
                found = topk.Lists(c).candidates(q, k, floor)
                assert set(np.flatnonzero(score >= best)) <= set(found.tolist())
    assert topk.Lists(c).candidates(q, 2000).tolist() == list(range(1500))


def test_reading_stops():
    """A few candidates stand out, as in skewed collections: under half of the entries are read, and with a
    known score a block that holds none of the best is left after the first stretch."""
    r = np.random.default_rng(1)
    c = np.floor(r.lognormal(0, 2.5, (4000, 16)))
    lists, queries = topk.Lists(c), np.floor(10 * r.random((20, 16)))
    for q in queries:
        score = c @ q
        found = lists.candidates(q, 6)
        assert set(np.flatnonzero(score >= np.sort(score)[-6])) <= set(found.tolist())
    assert lists.entries < 0.5 * 20 * c.size
    far, other = topk.Lists(np.floor(c / 1000)), 0
    for q in queries:
        best = np.sort(c @ q)[-6]
        other += len(far.candidates(q, 6, float(best)))
    assert other == 0 and far.entries <= 20 * c.size / 16
    # nothing is read of dimensions in which the query is 0
    some = topk.Lists(c)
    some.candidates(np.where(np.arange(16) < 2, 1.0, 0.0), 6)
    assert some.entries <= 2 * 4000


def test_floors(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(-9, 9, 4)]) for i in range(60)] + [(100, [1e12, 1e12, 0.0, 0.0]), (101, [2.0])]
    v = spark.createDataFrame(rows, "id bigint, v array<double>").selectExpr("*", "size(v) as d")
    got = {q["id"]: q["floor"] for q in topk.with_floor(v, v, 5, 256).collect()}
    for i, x in rows[:60]:
        true = sorted(sum(int(256 * a) * int(256 * b) for a, b in zip(x, y, strict=True)) for j, y in rows[:61] if j != i)[-5]
        assert got[i] <= true and true - got[i] <= abs(true) * 1e-12
    assert got[101] is None


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (150, []), (7, [1e12, -1e12]), (8, [1e307, 1e307]), (9, [-3e13, 0.1]), (50, [1.0, 2.0, 3.0]), (100, [0.1, -0.3])]
    v = edges.clashing(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").drop("id", "v"))
    got = topk.top_k(v, v.filter("vec_id % 50 = 0")).collect()
    from fractions import Fraction

    q = lambda x: [int(np.floor(256 * Fraction(c))) for c in x]
    ok = {i: q(x) for i, x in rows if i in (0, 1, 7, 8, 9, 100)}
    want = {(150, 1, 6, 0)}
    for a in (0, 100):
        ranked = sorted((-sum(x * y for x, y in zip(ok[a], ok[b], strict=True)), b) for b in ok if b != a)
        want |= {(a, i + 1, b, min(max(-s, -(2**63)), 2**63 - 1)) for i, (s, b) in enumerate(ranked[:5])}
    assert {tuple(r) for r in got} == want
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert topk.top_k(empty, empty).count() == 0


# ---- WARC -------------------------------------------------------------------------------------


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/\r\nx", "<p>one</p>"), (1, None, "<p>one</p>"), (2, "http://b", None), (9, "http://c", ""), (None, "u", "<p>one</p>"), (4, "http://ü", "日本" * 50000), (4, "http://ü", "日本" * 50000), (None, None, None), (5, "u5", "a\r\n\r\nb")]
    pages = edges.clashing(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2))
    index = warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_records(index, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    text = lambda v: None if v is None else str(v)
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        first[b] = i if first.get(b) is None else first[b] if i is None else min(first[b], i)
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = first[b] != i
        want[text(i), len(b), digest(b), "revisit" if revisit else "response", text(first[b]) if revisit else None] += 1
    assert collections.Counter((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert {r["url"] for r in got if r["record_id"] == "4"} == {"http://ü"}
    assert [bytes(r["payload"]) for r in got if r["record_id"] == "5"] == [b"a\r\n\r\nb"]
    # selected records are read by few ranges, and only theirs
    few = warc.plan_ranges(index.filter("record_type = 'response'"), gap=0)
    assert few.agg({"stop": "max"}).first()[0] <= index.selectExpr("max(offset + length)").first()[0]
    one = warc.read_records(index.filter("record_id = '5'"), str(tmp_path / "w")).collect()
    assert len(one) == 1 and one[0]["record_id"] == "5"


def test_warc_files_are_gzip_members(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(20)], "page_id bigint, url string, html string").coalesce(1)
    index = warc.write_archives(pages, str(tmp_path / "w")).collect()
    for r in index:
        with open(tmp_path / "w" / r["archive"], "rb") as f:
            f.seek(r["offset"])
            assert gzip.decompress(f.read(r["length"])).startswith(b"WARC/1.1\r\nWARC-Type: response")
    least = warc.write_archives(spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id bigint, url string, html string"), str(tmp_path / "v"), least=2)
    assert {r["record_type"] for r in least.collect()} == {"response"}
    empty = warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_records(empty, str(tmp_path / "e")).count() == 0


def test_warc_ids_and_tasks(spark, tmp_path, monkeypatch):
    """Text ids of any kind come back; reads are dealt to several tasks by bytes."""
    ids = ["null", "", None, "a b", "x\r\ny", "<urn>", "ü%20"]
    pages = spark.createDataFrame([(i, "u", f"{i}" * 400) for i in ids], "page_id string, url string, html string")
    index = warc.write_archives(pages, str(tmp_path / "i"))
    got = warc.read_records(index, str(tmp_path / "i")).collect()
    assert collections.Counter((r["record_id"], bytes(r["payload"])) for r in got) == collections.Counter((i, (f"{i}" * 400).encode()) for i in ids if i != "null") + collections.Counter([("null", b"null" * 400)])
    monkeypatch.setattr(warc, "TASK_BYTES", 200)
    monkeypatch.setattr(warc, "RANGE_BYTES", 100)
    assert warc.read_records(index, str(tmp_path / "i")).rdd.getNumPartitions() > 2


def test_op2_sql(spark, sf):
    check(spark, sf, warc.op2_query, warc.OP2_SQL)


def test_op2(spark, sf):
    got = {r["page_id"]: r for r in warc.op2_query(spark, sf).collect()}
    for i, h in connect(sf).execute("SELECT page_id, html FROM pages").fetchall():
        b = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"]) == (len(b), digest(b), "response")


# ---- quality ----------------------------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.op5_query(spark, sf).collect()}
    rows = [(got[i]["predicted"], q) for i, q in connect(sf).execute("SELECT doc_id, quality FROM labels").fetchall() if got[i]["held_out"]]
    assert np.mean([p == q for p, q in rows]) > 0.95
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())


def test_quality_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(14)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    docs = edges.clashing(edges.documents(spark)).drop("id", "score")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(edges.texts()) and all(0 <= r["score"] <= 1 for r in got)
    alone = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, alone).collect()} == {0.5}
    assert quality.score(edges.documents(spark, []), model).count() == 0


def test_scores_by_a_plain_forward_pass(spark, sf):
    """op5's scores against the attention formulas written out for one document at a time."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.op5_query(spark, sf).collect()}
    for i, t in connect(sf).execute("SELECT doc_id, text FROM documents").fetchall():
        codes = [np.tanh((x - m["mean"]) / m["std"] @ m["W"] + m["b"]) for x in quality.passage_features((t or "").encode()).astype(float)]
        gates = [float(np.tanh(h @ m["V"]) * (1 / (1 + np.exp(-(h @ m["U"])))) @ m["w"]) for h in codes]
        weights = np.exp(np.array(gates) - max(gates))
        z = sum(w * h for w, h in zip(weights / weights.sum(), codes, strict=True))
        assert got[i] == pytest.approx(float(1 / (1 + np.exp(-(z @ m["c"] + m["c0"][0])))), abs=1e-6)


def test_training_rows_are_bounded_and_whole(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    docs = edges.documents(spark, [(i, "x" * (100 if i % 3 else 5000), "en", "s") for i in range(0, 80, 2)])
    rows = quality.training_rows(docs, labels, "doc_id", "text", "quality", 6000, 6000)
    assert sum(r[2] for r in rows) <= 6000 and all(r[0] % 2 == 0 and r[2] in (100, 5000) for r in rows) and len(rows) > 3


def test_slabs_give_the_same_features(monkeypatch):
    t = (edges.words(3, 3000) + " " + "z" * 4000).encode()
    whole = quality.passage_features(t)
    monkeypatch.setattr(quality, "SLAB", 2)
    assert np.allclose(whole, quality.passage_features(t))


def test_gradient_against_differences():
    """Every parameter's gradient against finite differences of the loss, over bags of several sizes."""
    r = np.random.default_rng(1)
    sizes = [1, 4, 2, 7]
    x, bag, y = r.normal(size=(14, quality.WIDTH)), np.repeat(np.arange(4), sizes), np.array([1.0, 0.0, 1.0, 0.0])
    m = {"W": r.normal(0, 0.2, (quality.WIDTH, 5)), "b": r.normal(size=5), "V": r.normal(size=(5, 3)), "U": r.normal(size=(5, 3)), "w": r.normal(size=3), "c": r.normal(size=5), "c0": r.normal(size=1)}
    m |= {"mean": x.mean(0), "std": x.std(0) + 0.1}

    def loss(model):
        p = quality.forward(model, x, bag, 4)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = quality.gradient(m, x, bag, y)
    for name, g in found.items():
        assert g.shape == m[name].shape
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 12)]:
            up, down = ({**m, name: m[name].copy()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def test_gradient_of_the_bag_model():
    """Training separates bags by a rare passage, which plain averaging of labels could not."""
    r = np.random.default_rng(0)
    bags, y = [], []
    for i in range(80):
        b = r.normal(0, 0.1, (6, quality.WIDTH)).astype(np.float32)
        if i % 2:
            b[r.integers(6), :4] += 3
        bags.append(b)
        y.append(i % 2)
    m = quality.train(bags, np.array(y), epochs=40)
    x, bag = np.vstack(bags), np.repeat(np.arange(80), 6)
    f = quality.forward(m, x, bag, 80)
    assert np.mean((f["p"] > 0.5) == np.array(y)) > 0.95
    assert np.allclose(np.bincount(bag, f["a"]), 1)


def test_passages_cover_the_text():
    t = (edges.words(1, 4000) + "é" * 5000).encode()
    assert len(quality.passage_features(t)) >= len(t) // (2 * quality.PASSAGE)
    assert quality.passage_features(b"").shape == (1, quality.WIDTH)


# ---- mixing -----------------------------------------------------------------------------------


def targets(sizes, weights=(1, 2, 3), most=3):
    """Share, cut at most times the size, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = {s for s in open_ if unit * w[s] >= most * sizes[s]}
        if not over:
            return full | {s: unit * w[s] for s in open_}
        for s in over:
            full[s] = float(most * sizes[s])
            left -= full[s]
        open_ -= over
    return full


def test_targets(spark):
    for sizes in ({"a": 100, "b": 1, "c": 5, None: 7, "B": 40}, {"a": 0, "b": 0}, {"x": 10}, {"a": 3, "b": 3, "c": 3, "d": 1000}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(targets(sizes)) if None not in sizes else all(got[s] == pytest.approx(t) for s, t in targets(sizes).items())


def test_mix(spark):
    docs = edges.documents(spark)
    got = mixing.mix(edges.clashing(docs)).collect()
    assert len(got) == len(edges.texts())
    sizes = collections.Counter()
    for _, t, _, s in edges.texts():
        sizes[s] += len((t or "").split())
    want = targets(dict(sizes))
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    again = mixing.mix(docs.repartition(7)).collect()
    assert collections.Counter((r["doc_id"], r["taken"]) for r in got) == collections.Counter((r["doc_id"], r["taken"]) for r in again)
    assert mixing.mix(edges.documents(spark, [])).count() == 0
    mixed = mixing.repeat_rows(docs, mixing.mix(docs))
    assert mixed.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(taken.values())


def test_mix_comes_near_and_splits_hot_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", 16)
    rows = [(i, edges.words(i, 5 + i % 40), "en", f"s{i % 3 if i % 2 else 0}") for i in range(300)]
    got = mixing.mix(edges.documents(spark, rows)).collect()
    taken, target, size = collections.Counter(), {}, {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    assert all(abs(taken[s] - target[s]) <= 45 for s in target)
    epochs = {s: int(target[s] // size[s]) for s in target}
    assert all(r["taken"] in (epochs[r["source"]] * r["size"], (epochs[r["source"]] + 1) * r["size"]) for r in got)
    plan = mixing.mix(edges.documents(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def reference_mix(rows, weights=(1, 2, 3), most=3, seed=7):
    """Which documents the mix takes, and how often, by sorting each source whole."""
    import math

    import xxhash

    def x64(*values):
        h = 42
        for v in values:
            if v is not None:
                h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, h)
        return h

    size = {i: len((t or "").split()) for i, t, s in rows}
    total = collections.Counter()
    for i, _, s in rows:
        total[s] += size[i]
    want, taken = targets(dict(total), weights, most), {}
    for source in total:
        drawn = []
        for i, t, s in rows:
            if s == source:
                t = t or ""
                signed = [v - 2**64 if v >= 2**63 else v for v in (x64(t), x64("second seed", t))]
                u = ((x64(*(int(v).to_bytes(n, "little", signed=True) for v, n in ((seed, 4), (i, 8), (signed[0], 8), (signed[1], 8)))) >> 11) + 0.5) / 2**53
                share = sum(c in mixing.SYMBOLS for c in t) / max(len(t), 1)
                drawn.append((-math.log(u) / max(0.05, 1 - 5 * share), signed, i))
        epochs = int(want[source] // total[source]) if total[source] else 0
        left, more, at = want[source] - epochs * total[source], set(), 0
        order = [i for *_, i in sorted(drawn)]
        while at < len(order) and size[order[at]] <= left:
            left -= size[order[at]]
            more.add(order[at])
            at += 1
        rest = [i for i in order[at:] if size[i]]
        for i in rest:
            if size[i] <= left:
                left -= size[i]
                more.add(i)
        nearest = min(((abs(size[i] - left), k, i) for k, i in enumerate(rest) if i not in more), default=None)
        if nearest and nearest[0] < left:
            more.add(nearest[2])
        taken |= {i: size[i] * (epochs + (i in more)) for i in order}
    return taken


def test_op6_takes_what_sorting_takes(spark, sf):
    """The whole query against a plain sort of each source (sources here are one key range)."""
    rows = connect(sf).execute("SELECT doc_id, text, source FROM documents").fetchall()
    got = {r["doc_id"]: r["taken"] for r in mixing.op6_query(spark, sf).collect()}
    assert got == reference_mix(rows)


def test_key_ranges_hold_about_as_many_rows_each(spark):
    """Also when most documents weigh little."""
    from pyspark.sql import functions as F

    rows = spark.range(200_000).select((-F.log((F.shiftrightunsigned(F.xxhash64("id"), 11) + 0.5) / F.lit(2.0**53)) / F.when(F.col("id") % 10 == 0, 1.0).otherwise(0.05)).alias("key"), F.when(F.col("id") % 10 == 0, 1.0).otherwise(0.05).alias("w"))
    counted = {r["level"]: r["count"] / 200_000 for r in rows.groupBy(mixing._level(F.col("w")).alias("level")).count().collect()}
    levels = F.array(*[F.struct(F.lit(a).alias("level"), F.lit(b).alias("share")) for a, b in sorted(counted.items())])
    held = [r["count"] for r in rows.groupBy(F.floor(mixing.key_share(levels, F.col("key")) * 50).alias("range")).count().collect()]
    assert max(held) < 3 * 4000


# ---- pieces -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        return pieces.Codec(pieces.read_model(f.read()))


def unigram():
    """The library's own best segmentation: the model's type field set to unigram."""
    import sentencepiece

    with open(pieces.DEFAULT_MODEL, "rb") as f:
        raw = f.read()
    at = raw.index(b"\x18\x02", raw.rindex(b"tok_v0"))
    return sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x18\x01" + raw[at + 2 :])


def test_same_as_the_library(codec, sf):
    sp = unigram()
    texts = connect(sf).execute("SELECT text FROM documents").fetchall()
    for w in sorted({w for (t,) in texts for w in t.split()})[:1500]:
        assert codec.encode(w) == sp.nbest_encode_as_ids(w, 1)[0]


def total_score(codec, ids):
    """Sum of scores, where the bytes of a character that no piece covers cost one penalty."""
    total, k = 0.0, 0
    while k < len(ids):
        b = codec.bytes_of.get(ids[k])
        total += codec.pieces[ids[k]][1] if b is None else codec.floor
        k += 1 if b is None or b < 128 else 2 if b < 224 else 3 if b < 240 else 4
    return total


def test_whole_texts_score_as_well_as_the_library(codec, sf):
    """The library sums in 32 bits, so on whole texts it may settle for less."""
    sp = unigram()
    for (t,) in connect(sf).execute("SELECT text FROM documents").fetchall():
        ours, theirs = codec.encode(t or ""), sp.nbest_encode_as_ids(t or "", 1)[0]
        assert codec.decode(ours) == (t or "")
        assert total_score(codec, ours) >= total_score(codec, theirs) - 1e-6


def brute_score(codec, text):
    known = {p: s for p, s, kind in codec.pieces if kind in (pieces.NORMAL, pieces.USER_DEFINED)}
    best = [0.0]
    for e in range(1, len(text) + 1):
        best.append(max([best[e - 1] + codec.floor, *(best[s] + known[text[s:e]] for s in range(e) if text[s:e] in known)]))
    return best[-1]


def test_viterbi_is_best(codec):
    r = np.random.default_rng(1)
    for _ in range(200):
        text = "".join(r.choice(list("▁▁theaningoré⁂日"), r.integers(1, 15)))
        total, k, ids = 0.0, 0, codec.best(text)
        while k < len(ids):
            b = codec.bytes_of.get(ids[k])
            total += codec.pieces[ids[k]][1] if b is None else codec.floor
            k += 1 if b is None or b < 128 else 2 if b < 224 else 3 if b < 240 else 4
        assert total == pytest.approx(brute_score(codec, text))


def test_words_are_encoded_as_whole_texts(codec):
    assert codec.by_word
    for text in ("the quick  brown fox", "   lead and trail  ", "a\n\nb c"):
        assert codec.encode(text) == codec.best("▁" + text.replace(" ", "▁"))


def test_round_trips(spark, codec):
    for t in ["", " ", "  a  b ", "▁x ▁", "a\0b", "\n\n x", "日本", "x" * 5000, "\U0001f600 ok", *(t for _, t, *_ in edges.texts() if t)]:
        assert codec.decode(codec.encode(t)) == t
    rows = pieces.encode(edges.clashing(edges.documents(spark)).drop("id"))
    assert rows.filter("not restored").count() == 0 and rows.count() == len(edges.texts())
    back = pieces.decode(rows)
    assert collections.Counter((r["doc_id"], r["text"]) for r in back.collect()) == collections.Counter((i, t or "") for i, t, *_ in edges.texts())
    assert pieces.encode(edges.documents(spark, [])).count() == 0


# ---- chat -------------------------------------------------------------------------------------


def test_chat_sql(spark, sf):
    check(spark, sf, chat.op9_query, chat.OP9_SQL)


def test_chat_masks(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (1, 70, "ann", "late"), (1, None, "cy", None), (None, 0, None, "x"), (2, 0, "system", "alone")]
    got = chat.rotate(edges.clashing(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    by = {(r["conv_id"], r["perspective"]): r for r in got}
    r = by[1, "bob"]
    late = "<|im_start|>user name=ann\nlate<|im_end|>\n<|im_start|>user name=cy\n<|im_end|>\n"
    assert r["rendered"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi < |im_end|><|im_end|>\n" + "<|im_start|>assistant\nyo<|im_end|>\n" * 2 + late
    learnt = {who: [by[1, who]["rendered"][m["start"] : m["stop"]] for m in by[1, who]["mask"]] for who in ("ann", "bob", "cy")}
    assert learnt == {"bob": ["yo<|im_end|>\n"] * 2, "ann": ["hi < |im_end|><|im_end|>\n", "late<|im_end|>\n"], "cy": ["<|im_end|>\n"]}
    assert r["n_turns"] == 6 and (None, "unknown") in by and len(got) == 4
    assert not any(k[0] == 2 for k in by)
    assert chat.rotate(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# ---- pipeline ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    docs = edges.documents(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(15)], "doc_id bigint, quality int, toxic int")
    return edges.write(spark, tmp_path_factory.mktemp("world"), documents=docs, labels=labels)


def test_pipeline_against_its_parts(spark, world):
    """run() against brute force on texts: exact copies, then near copies by shingles, then the plain mix."""
    import re

    import corpus_pipeline as P

    docs = [(i, t, s) for i, t, _, s in edges.texts()]
    left, seen = [], {}
    for i, t, s in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        if seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i) == i and (i, t or "") not in [(a, b or "") for a, b, _ in left]:
            left.append((i, t, s))
    shingles = lambda t: frozenset(zip(*((t or "").lower().split()[k:] for k in range(5)), strict=False))
    kept = [r for n, r in enumerate(left) if not any(shingles(r[1]) and len(shingles(r[1]) & shingles(q[1])) >= 0.8 * len(shingles(r[1]) | shingles(q[1])) for q in left[:n])]
    stage = dict(P.STAGES)
    table = spark.read.parquet(f"{world}/documents.parquet")
    got = stage["simhash near-dedup"](spark, stage["exact dedup"](spark, table, world), world).select("doc_id", "text").collect()
    # texts without words have one fingerprint, so one of them stays
    words = lambda rows: {(i, t) for i, t in rows if (t or "").split()}
    assert words(map(tuple, got)) == words((i, t) for i, t, _ in kept) and len(got) - len(words(map(tuple, got))) == 1


def test_stages(spark, world):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "mixing", "sentencepiece"]
    stage = dict(P.STAGES)
    docs = spark.read.parquet(f"{world}/documents.parquet")
    kept = stage["quality classifier"](spark, docs, world)
    assert kept.columns == docs.columns and kept.count() == docs.count()  # only good labels: all stay
    exact = stage["exact dedup"](spark, docs, world)
    assert exact.columns == docs.columns
    assert sorted(r["doc_id"] for r in exact.filter("doc_id is not null").collect()) == [0, 2, 3, 5, 6, 8, 9, 10, 11, 12, 13, 14]
    near = stage["simhash near-dedup"](spark, exact, world)
    assert near.columns == docs.columns and near.filter("doc_id in (0, 2, 13)").count() == 1
    mixed = stage["mixing"](spark, near, world)
    assert mixed.columns == docs.columns
    out = stage["sentencepiece"](spark, mixed, world)
    assert out.count() == mixed.count() and out.filter("not restored").count() == 0


def test_stages_take_clashing_columns(spark, world):
    """Columns named as operators name theirs inside come through every stage but the last as they were."""
    import corpus_pipeline as P

    docs = edges.clashing(spark.read.parquet(f"{world}/documents.parquet"))
    for name, stage in P.STAGES:
        out = stage(spark, docs, world)
        assert out.count() > 5, name
        if name != "sentencepiece":
            assert out.columns == docs.columns and all(out.filter(f"`{c}` <> 'clash' or `{c}` is null").count() == 0 for c in edges.CLASH[:6]), name


def test_stages_take_empty_tables(spark, world):
    import corpus_pipeline as P

    docs = edges.documents(spark, [])
    for name, stage in P.STAGES:
        assert stage(spark, docs, world).count() == 0, name


def test_run(spark, world):
    import corpus_pipeline as P

    out = P.run(spark, world)
    assert out.count() > 5 and out.filter("not restored").count() == 0


def test_quality_and_mixing_stages(spark, sf):
    """What stays is what the classifier scores 0.7 or more; the mix comes near each target and draws as mix() does."""
    import corpus_pipeline as P

    stage = dict(P.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    score = {r["doc_id"]: r["score"] for r in quality.op5_query(spark, sf).collect()}
    kept = stage["quality classifier"](spark, docs, sf).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, s in score.items() if s >= 0.7)
    some = docs.join(spark.createDataFrame(kept), "doc_id", "left_semi").select(docs.columns)
    taken = collections.Counter(r["doc_id"] for r in stage["mixing"](spark, some, sf).select("doc_id").collect())
    rows = {r["doc_id"]: (r["source"], len([w for w in (r["text"] or "").split() if w])) for r in some.select("doc_id", "source", "text").collect()}
    size, got = collections.Counter(), collections.Counter()
    for i, (source, n) in rows.items():
        size[source] += n
        got[source] += n * taken[i]
    target = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(size.items()), "source string, source_size bigint")).collect()}
    assert set(target) == set(size) and all(abs(got[s] - target[s]) <= max(n for t, n in rows.values() if t == s) for s in size)
    assert max(taken.values()) <= 3
    # a score may weigh instead: heavier documents are drawn at least as often, all else equal
    weighed = some.join(spark.createDataFrame(list(score.items()), "doc_id bigint, s double"), "doc_id").select(*docs.columns, "s")
    mixed = mixing.mix(weighed, weight=weighed["s"]).collect()
    assert {r["doc_id"] for r in mixed} == set(rows) and sum(r["taken"] for r in mixed) == pytest.approx(sum(target.values()), rel=0.05)
