"""Source divergence, periodic runs and quality rules against SQL and plain versions."""

import collections
import hashlib
import re
import zlib

import edges
import numpy as np
import pandas as pd
import pytest

from gramlake.llm import divergence, periodic, rules
from oracle import check, connect, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# ---- divergence -------------------------------------------------------------------------------


def plain_divergence(docs, least, top):
    """docs: (lang, source, text) with empties for nulls."""
    lower = {c: c + 32 for c in range(65, 91)}
    df, occ, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for lang, source, text in docs:
        words = [w.translate(lower) for w in TERM.findall(text)]
        df[lang].update(set(words))
        occ[lang, source].update(words)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        whole = collections.Counter()
        for s in sources:
            whole.update(occ[lang, s])

        def p_of(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: p_of(occ[lang, s]) for s in sources}, p_of(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode()) for t in kept if occ[lang, s][t] and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(ranked)}
    return out


def test_divergence_sql(spark, sf):
    check(spark, sf, divergence.op11_query, divergence.OP11_SQL)


@pytest.mark.parametrize("least, top, width", [(3, 200, 1 << 16), (1, 4, 1 << 16), (2, 200, 1 << 10)])
def test_divergence(spark, least, top, width):
    r = np.random.default_rng(least)
    some = ["alpha", "Beta", "ÄÖü", "日本", "g-h", "i9j", "kk", "Kk", "z" * 300, "q", "r", "s", "t"]
    docs = edges.texts() + [(100 + i, " ".join(r.choice(some, r.integers(0, 40))), str(r.choice(["en", "de", "xx"])), str(r.choice(["s1", "s2", "s3", "", "é"]))) for i in range(150)]
    docs += [(900, "only words of its own here", "lonely", "s1"), (901, "other ones there", "lonely", "s2"), (902, "!!! 123", "bare", "s1")]
    table = edges.clashing(edges.documents(spark, docs).drop("id", "n", "b"))
    got = [tuple(x) for x in divergence.divergence(table, least=least, top=top, width=width, depth=2).collect()]
    want = plain_divergence([(lang or "", source or "", text or "") for _, text, lang, source in docs], least, top)
    assert len(got) == len(set(got)) and set(got) == want


def test_divergence_of_nothing(spark):
    assert divergence.divergence(edges.documents(spark, [])).count() == 0


def test_large_counts_are_exact(spark):
    """Beyond what a double holds, and where a product with the scale needs more than 64 bits."""
    n, d = [10**13 + 7, 3, 0], [10**14 + 1, 10, 0]
    df = spark.createDataFrame(list(zip(n, d, strict=True)), "n bigint, d bigint").select(divergence.share("n", "d", 10**9).alias("p"))
    assert [r["p"] for r in df.collect()] == [1 + 10**9 * (n[0] + 1) // d[0], 1 + 10**9 * 4 // 10, None]


def test_sketch_never_underestimates(spark):
    """Held against plain counts, with a sketch so narrow that cells are shared, merged in levels."""
    r = np.random.default_rng(1)
    docs = [(" ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}x" * int(1 + i // 100) for i in r.integers(0, 500, 30)), "en") for _ in range(400)]
    table = spark.createDataFrame([(lang.encode(), text.encode()) for text, lang in docs], "lang binary, text binary").repartition(70)
    df = collections.Counter(t for text, _ in docs for t in set(TERM.findall(text)))
    for width, depth in ((1 << 10, 2), (1 << 17, 4)):
        bits = np.frombuffer(divergence.sketched(table, width, depth, 3), np.uint8)
        often = divergence.possible(bits, b"en", [t.encode() for t in df], width, depth)
        assert all(ok for ok, n in zip(often, df.values(), strict=True) if n >= 3)
        if width > 1 << 16:
            assert not any(ok for ok, n in zip(often, df.values(), strict=True) if n < 3)


# ---- periodic runs ----------------------------------------------------------------------------


def plain_runs(words):
    """Each maximal stretch by its definition."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                found.add((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_by_bits():
    r = np.random.default_rng(0)
    cases = [[], [1], [1] * 5, [1] * 6, [1, 2] * 4, [1, 2] * 3, [1, 1, 2] * 4, [1, 2, 1, 3] * 4 + [1], [5] * 7 + [1, 2] * 9 + [5] * 6, [1] * 70]
    for _ in range(300):
        words = r.integers(0, r.integers(1, 6), r.integers(1, 60)).tolist()
        for _ in range(r.integers(0, 3)):
            block = r.integers(0, 4, r.integers(1, 12)).tolist()
            words[len(words) // 2 : len(words) // 2] = (block * int(r.integers(2, 7)))[: int(r.integers(1, 70))]
        cases.append(words)
    for words in cases:
        ids = periodic.numbered([str(w).encode() for w in words])
        assert periodic.runs(ids) == plain_runs(words)
        # the lags that are left out have no run
        assert {q for _, _, q in plain_runs(words)} <= set(periodic.lags(ids))


def test_runs_of_long_periods():
    r = np.random.default_rng(2)
    block = r.integers(0, 10**6, 3000)
    words = np.concatenate((r.integers(0, 10**6, 500), np.tile(block, 5), r.integers(0, 10**6, 20000)))
    ids = periodic.numbered([str(w).encode() for w in words.tolist()])
    assert [x for x in periodic.runs(ids)] == [(500, 15000, 3000)]
    assert len(periodic.lags(ids)) < 5


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_query(spark, tmp_path):
    many = [(i, " ".join(["ab", "cd", "ef", "gh", "ij"][int(k)] for k in np.random.default_rng(i).integers(0, 5, 30 + i % 40)), "en", "s") for i in range(1000, 1100)]
    docs = edges.texts() + many + [(i, None, None, None) for i in range(2000, 2030)] + [(i, " \n", "en", "s") for i in range(2030, 2060)] + [(i, "one", "en", "s") for i in range(2060, 2090)]
    path = edges.write(spark, tmp_path / "t", documents=edges.clashing(edges.documents(spark, docs)))
    got = collections.Counter(tuple(r) for r in periodic.op12_query(spark, path).collect())
    short = [d for d in docs if d[1] is not edges.LONG]
    want = collections.Counter(plain_row(i, t) for i, t, *_ in short)
    assert collections.Counter({k: n for k, n in got.items() if k[0] != 8}) == want
    assert sum(n for k, n in got.items() if k[0] == 8) == 1
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t and t.strip() for i, t, *_ in many)


def test_periodic_sql(spark, sf):
    as_float = lambda df: df.astype({c: "float64" for c in ("start", "length", "period", "exponent_milli")})
    assert rows(as_float(periodic.op12_query(spark, sf).toPandas())) == rows(as_float(connect(sf).execute(periodic.OP12_SQL).df()))


def test_periodic_edges(spark):
    docs = [(1, "a b " * 5, None, None), (1, "a b " * 5, None, None), (None, None, None, None), (2, "", None, None)]
    got = periodic.periodic_runs(edges.clashing(edges.documents(spark, docs))).collect()
    assert sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == [(0, [], ""), (1, [(0, 10, 2)], "a b"), (1, [(0, 10, 2)], "a b"), (2, [], "")]
    assert periodic.periodic_runs(edges.documents(spark, [])).count() == 0


# ---- quality rules ----------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n, r = len(words), len(again)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n)


def test_rules_sql(spark, sf):
    check(spark, sf, rules.op13_query, rules.OP13_SQL)


def test_rules_counts(spark):
    r = np.random.default_rng(4)
    extra = [(200 + i, " ".join(r.choice(["a", "b", "c d", "e\nf", "# %", "ü|"], r.integers(1, 90))), "en", "s1") for i in range(120)]
    extra += [(400, "x" * 100000, "en", "s1"), (401, "a a a", "en", "s1"), (402, "a a a a", "en", "s1"), (403, "\n\n a\n a\na", "en", "s1")]
    docs = edges.texts() + extra
    got = rules.quality_rules(edges.clashing(edges.documents(spark, docs).drop("id", "n"))).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert collections.Counter((r["doc_id"], *(r[c] for c in names)) for r in got) == collections.Counter((i, *plain_counts(t)) for i, t, *_ in docs)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert rules.quality_rules(edges.documents(spark, [])).count() == 0


def test_thresholds_adapt(spark):
    """A source full of symbols keeps its documents; one with a few such documents drops them; few rows fall back."""
    def text(seed, symbol):
        w = edges.words(seed, 80).split()
        return " ".join(x + ("#" if symbol and i % 2 else "") for i, x in enumerate(w))

    docs = [(i, text(i, True), "en", "formulas") for i in range(60)] + [(100 + i, text(i, i < 6), "en", "prose") for i in range(60)] + [(200, text(7, True), "en", "rare"), (201, text(8, False), None, None)]
    out = {r["doc_id"]: r for r in rules.quality_rules(edges.documents(spark, docs), least=50).collect()}
    assert all(out[i]["kept"] for i in range(60))
    assert [i for i in range(100, 160) if not out[i]["kept"]] == list(range(100, 106))
    assert out[201]["kept"]


def test_sketch_quantiles(spark):
    """Merged sketches give quantiles within a part in 64, whatever they are merged from."""
    r = np.random.default_rng(5)
    values = np.concatenate((np.zeros(300, int), (10 ** r.uniform(0, 6, 5000)).astype(int)))
    df = spark.createDataFrame(pd.DataFrame({"lang": "en", "source": [f"s{i % 7}" for i in range(len(values))], "m": values})).repartition(9)
    sketch = rules.sketches(df, ["m"])
    (q,) = rules.quantiles(rules.merged(sketch, ["lang"]), ["lang"]).collect()
    ordered = np.sort(values)
    for got, share in ((q["q25"], 0.25), (q["q50"], 0.5)):
        true = ordered[int(np.ceil(share * len(values))) - 1]
        assert true * (1 - 1 / 64) <= got <= true
    assert q["rows"] == len(values) and sketch.count() < 7 * 900
