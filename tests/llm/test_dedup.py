"""Exact, fingerprint, paragraph and substring dedup against brute force."""

import collections
import hashlib
import itertools
import re

import edges
import numpy as np
import pytest
import xxhash

from gramlake.llm import exact_dedup, paragraphs, simhash, substring
from gramlake.llm.common import keep_rows
from gramlake.llm.components import components
from oracle import check

SPACE = r"[\x20\x09-\x0D]+"


def key(v):
    return (v is None, v if v is not None else 0)


def roots(items, linked):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(items))]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(30)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize("route_bits,block", [(128, 4096), (2, 16), (0, 16), (64, 7)])
def test_exact(spark, route_bits, block):
    """Few bits of route, or none: hashes that collide for good."""
    rows = edges.texts()
    got = exact_dedup.exact_dedup(edges.clashing(edges.documents(spark)), block_bytes=block, route_bits=route_bits).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(SPACE, " ", t or "")].append(i)
    want = sorted(((i, min(g, key=key), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g), key=lambda r: (key(r[0]), r[3]))
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=lambda r: (key(r[0]), r[3])) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_sql(spark, sf):
    check(spark, sf, exact_dedup.op3_query, exact_dedup.OP3_SQL)


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(edges.documents(spark, [])).count() == 0


def fingerprint(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("cap", [64, 1])
def test_simhash(spark, cap):
    """cap=1 sends every bucket of two or more through the ball points."""
    rows = edges.texts()
    got = simhash.simhash_dedup(edges.clashing(edges.documents(spark)), shingle=3, cap=cap).collect()
    fps = [fingerprint(t, 3) for _, t, *_ in rows]
    at = roots(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {r: min((rows[i][0] for i in range(len(rows)) if at[i] == r), key=key) for r in set(at)}
    want = collections.Counter((rows[i][0], format(fps[i], "016x"), least[at[i]]) for i in range(len(rows)))
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


@pytest.mark.parametrize("cap", [64, 4, 1])
def test_links_join_what_is_near(spark, cap):
    r = np.random.default_rng(2)
    centres = r.integers(0, 2**63, 6, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(30):
            x = int(c)
            for b in r.integers(0, 64, r.integers(1, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp bigint"), cap)
    got = {x["node"]: x["root"] for x in components(links).collect()}
    at = roots(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert [got.get(x, x) for x in fps] == [fps[i] for i in at]


def test_simhash_empty(spark):
    assert simhash.simhash_dedup(edges.documents(spark, [])).count() == 0


def line_sets(text, n=5, least=13):
    for line in (text or "").split("\n"):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).split()
        if len(w) >= least:
            yield line, frozenset(zip(*(w[i:] for i in range(n)), strict=False))


@pytest.mark.parametrize("small,task_shingles", [(32, 10**6), (1, 10**6), (1, 1), (1, 300)])
def test_paragraphs(spark, small, task_shingles):
    """Buckets compared whole, connected in tasks, and sent through leader rounds."""
    base = edges.words(20, 60).split()
    rows = [r for r in edges.texts() if r[0] is not None]
    for i in range(12):
        w = list(base)
        w[5 * i % 60] = f"edit{i}"
        rows.append((50 + i, " ".join(w), "en", "s9"))
    got = {r["doc_id"]: r for r in paragraphs.paragraph_dedup(edges.clashing(edges.documents(spark, rows)), small=small, task_shingles=task_shingles).collect()}
    seen = sorted({(i, t) for i, t, *_ in rows if t})
    items = [(i, line, s) for i, t in seen for line, s in line_sets(t)]
    at = roots([s for _, _, s in items], lambda a, b: len(a & b) >= 0.8 * len(a | b))
    gone = {(items[k][0], items[k][1].strip()) for k in range(len(items)) if at[k] != k}
    bytes_of = {i: (t or "").encode() for i, t, *_ in rows}
    removed = {(i, bytes_of[i][s["start"] : s["stop"]].decode()) for i, r in got.items() for s in r["spans"]}
    assert gone <= removed
    assert got[3]["n_units"] == 0 and got[4]["n_units"] == 0 and got[9]["n_removed"] == 0
    # the passage inside a long line is found by its cuts, and points at the first that holds it
    assert got[11]["n_removed"] > 0 and set(got[11]["keep_ids"]) == {9}
    cut = {r["doc_id"]: r["text"] for r in paragraphs.without_paragraphs(edges.documents(spark, rows), paragraphs.paragraph_dedup(edges.documents(spark, rows))).collect()}
    assert len(cut[11]) < len(bytes_of[11].decode()) and cut[9] == bytes_of[9].decode() and cut[4] is None


def removed_words(spark, rows):
    """The words that paragraph_dedup takes out of each document."""
    out = {}
    docs = edges.documents(spark, [(i, t, "en", "s") for i, t in rows])
    for r in paragraphs.paragraph_dedup(docs).collect():
        b = dict(rows)[r["doc_id"]].encode()
        gone = np.zeros(len(b), bool)
        for s in r["spans"]:
            gone[s["start"] : s["stop"]] = True
        out[r["doc_id"]] = {m.group().decode() for m in re.finditer(rb"[^ \n]+", b) if gone[m.start()]}
    return out


def planted(seed, n):
    return " ".join(f"{w}{seed}" for w in edges.words(seed, n).split())


def test_passages_inside_lines_of_sixty_words(spark):
    """(a) between other words in two lines of 60; (b) a line of its own, then inside a longer line."""
    rows, passages = [], {}
    for i in range(20):
        p = planted(1000 + i, 51)
        a, b, c, d = (planted(2000 + 10 * i + j, 9 + 20 * (j == 3)) for j in range(4))
        rows += [(10 * i, f"{a} {p}"), (10 * i + 1, f"{p} {b}"), (1000 + 10 * i, p.replace("1", "7")), (1001 + 10 * i, f"{c} {p.replace('1', '7')} {d}")]
        passages |= {10 * i + 1: p, 1001 + 10 * i: p.replace("1", "7")}
    gone = removed_words(spark, rows)
    for first in (1, 1001):
        assert sum(bool(gone[i] & set(passages[i].split())) for i in range(first, first + 200, 10)) == 20


def test_passages_are_found_in_full(spark):
    """Every copied passage of 50 words or more goes, from its first word to its last, and nothing else."""
    rows, passages = [], {}
    for i in range(40):
        p = planted(3000 + i, 50 + i % 31)
        a, b, c, d = (planted(4000 + 10 * i + j, 70) for j in range(4))
        rows += [(10 * i, f"{a} {p} {b}"), (10 * i + 1, f"{c}  {p.upper()} {d}")]
        passages |= {10 * i: set(), 10 * i + 1: set(p.upper().split())}
    assert removed_words(spark, rows) == passages


def wrapped(text, n):
    w = text.split()
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


def test_wrapped_passages_and_short_lines(spark):
    """A passage wrapped at two widths, all lines under 20 words, and equal lines of 5 to 19 words."""
    p, lines = planted(5000, 60), [planted(5001 + n, n) for n in (4, 5, 12, 19)]
    own = [planted(5100 + i, 11) for i in range(4)]
    rows = [(1, f"{own[0]}\n{wrapped(p, 9)}\n{own[1]}"), (2, f"{own[2]}\n{wrapped(p, 13)}\n{own[3]}")]
    rows += [(3, "\n".join([planted(5200, 8), *lines])), (4, "\n".join([*reversed(lines), planted(5201, 8)]))]
    assert removed_words(spark, rows) == {1: set(), 2: set(p.split()), 3: set(), 4: set(" ".join(lines[1:]).split())}


def test_lines_of_few_words(spark):
    """From 13 words on a line whose last word is changed is as similar as 0.8; shorter ones repeat only as they are."""
    rows, want = [], {}
    for i, n in enumerate([5, 8, 12, *range(13, 20), *range(13, 20), 19, 19, 19]):
        line = planted(6000 + i, n).split()
        other = [*line[:-1], f"else{i}"]
        rows += [(10 * i, "\n".join((planted(6100 + i, 4), " ".join(line)))), (10 * i + 1, "\n".join((" ".join(other), planted(6200 + i, 4))))]
        want |= {10 * i: set(), 10 * i + 1: set(other) if n >= 13 else set()}
    assert removed_words(spark, rows) == want


def test_buckets_are_bounded_by_their_shingles(spark):
    """Few members with many shingles don't meet in a task, and give the same components."""
    base = edges.words(31, 900).split()
    rows = []
    for i in range(40):
        w = list(base)
        for j in range(i % 6):
            w[(97 * i + 131 * j) % 900] = f"edit{i}x{j}"
        rows.append((i, " ".join(w), "en", "s"))
    docs = edges.documents(spark, rows)
    one, two = ({(r["doc_id"], r["component_id"]) for r in paragraphs.similar_documents(docs, small=2, task_shingles=t).collect()} for t in (10**6, 2000))
    assert one == two and len({c for _, c in one}) == 1


def test_paragraphs_empty_and_nulls(spark):
    assert paragraphs.paragraph_dedup(edges.documents(spark, [])).count() == 0
    assert paragraphs.paragraph_dedup(edges.documents(spark)).count() == len(edges.texts())


def test_banding():
    bands, rows = paragraphs.tune(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_similar_documents(spark):
    rows = edges.texts()
    got = paragraphs.similar_documents(edges.clashing(edges.documents(spark))).collect()
    assert len(got) == len(rows)
    comp = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert comp[0] == comp[1] == comp[2] == comp[13] == 0 and comp[9] == 9 and comp[11] == 11
    kept = keep_rows(edges.documents(spark), paragraphs.similar_documents(edges.documents(spark)).filter("kept"))
    assert kept.filter("doc_id in (0, 1, 2, 13)").count() == 1 and kept.filter("doc_id = 5").count() == 1


def brute_substring(rows, length):
    count = collections.Counter()
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        count.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        m = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                m[j : j + length] = True
        spans = int((m & ~np.concatenate(([False], m[:-1]))).sum()) if len(b) else 0
        out.append((key(i), len(b), int(m.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("heavy", [8 << 20, 100])
def test_substring(spark, heavy):
    rows = [(i, t) for i, t, *_ in edges.texts()] + [(20, "ab" * 400), (21, "z" * 199), (21, "z" * 199), (22, "q" * 230)]
    docs = edges.documents(spark, [(*r, "en", "s") for r in rows])
    got = substring.substring_dedup(edges.clashing(docs), keep_first=False, heavy_bytes=heavy, bucket_bytes=4000).collect()
    assert sorted((key(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_substring(rows, 200)


@pytest.mark.parametrize("heavy", [8 << 20, 100])
def test_substring_keeps_the_first(spark, heavy):
    passage, other = edges.words(40, 60), edges.words(41, 60)
    rows = [(1, edges.words(42, 30) + passage + edges.words(43, 30)), (2, passage + other), (3, other + edges.words(44, 20)), (4, passage), (4, passage), (6, passage)]
    got = substring.substring_dedup(edges.documents(spark, [(*r, "en", "s") for r in rows]), length=200, heavy_bytes=heavy, texts=True).collect()
    kept = [(r["kept"] if r["kept"] is not None else None, r) for r in got]
    texts = {(r["doc_id"]): (bytes(k) if k is not None else dict(rows)[r["doc_id"]].encode()) for k, r in kept}
    # every 200-byte string of the input is left somewhere, and none is left twice
    left = collections.Counter()
    for r in got:
        b = bytes(r["kept"]) if r["kept"] is not None else dict(rows)[r["doc_id"]].encode()
        left.update(b[j : j + 200] for j in range(len(b) - 199))
    assert max(left.values()) == 1
    assert sum(r["n_removed"] for r in got) >= 3 * len(passage) + len(other) - 2
    assert len(texts) == 5


@pytest.mark.parametrize("heavy", [8 << 20, 100])
@pytest.mark.parametrize("keep_first", [False, True])
def test_substring_equates_nothing_that_differs(spark, heavy, keep_first):
    """Thue-Morse blocks around one passage: sums of powers modulo 2^64 are equal for many of these pairs."""
    flip = [0]
    while len(flip) < 128:
        flip += [1 - b for b in flip]
    symbols = substring.Rolling(16).symbols
    pairs = sorted(itertools.combinations(range(33, 127), 2), key=lambda p: -max(int((s[p[0]] - s[p[1]]) & -(s[p[0]] - s[p[1]])) for s in symbols))
    rows = []
    for i, (a, b) in enumerate([(93, 86), *pairs[:14]]):
        middle = edges.words(700 + i, 30)[:72]
        for one, two in ((a, b), (b, a)):
            block = "".join(chr((one, two)[x]) for x in flip)
            rows.append((len(rows), block + middle + block))
    rows += [(100, rows[0][1] + "!"), (101, "?" + rows[0][1])]
    got = substring.substring_dedup(edges.documents(spark, [(*r, "en", "s") for r in rows]), keep_first=keep_first, heavy_bytes=heavy).collect()
    want = brute_substring(rows, 200)
    if keep_first:
        assert sum(r["n_removed"] > 0 for r in got) == 2 and all(r["n_removed"] == 0 for r in got if 0 < r["doc_id"] < 100)
    else:
        assert sorted((key(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_substring_query(spark, sf):
    """The whole query against every 200-byte string of the table."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = substring.op10_query(spark, sf).collect()
    assert sorted((key(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_substring(rows, 200)


def test_segments_of_long_texts():
    """A text cut into pieces gives windows that are covered once each."""
    roll = substring.Rolling(1 << 12)
    data = edges.words(9, 900).encode()
    seen = []
    for piece, ends, rows in substring._batches(None, [data], 1000, 199):
        text, first, size, *_ = substring.segments(piece, ends, 200, 48, roll)
        begins = np.concatenate(([0], ends[:-1]))
        for t, f, s in zip(text, first, size, strict=True):
            at = f - begins[t] + rows[t][1]
            seen += range(at, at + s - 199)
    assert sorted(seen) == list(range(len(data) - 199))


def test_suffix_order_and_previous_factors():
    """Pieces around one anchor: orders, common prefixes and factors against plain comparison."""
    r = np.random.default_rng(8)
    k, length = 4, 10
    pieces, offset, group = [], [], []
    for g in range(5):
        for _ in range(30):
            left, right = (bytes(r.choice(list(b"ab"), r.integers(0, length - k + 1), p=(0.8, 0.2)).tolist()) for _ in range(2))
            if len(left) + len(right) + k >= length:
                pieces.append(left + b"KKKK" + right)
                offset.append(len(left))
                group.append(g)
    size, offset, group = np.array([len(p) for p in pieces]), np.array(offset), np.array(group)
    table = substring.laid_over(np.frombuffer(b"".join(pieces), np.uint8), size, offset, length, k)
    strings = ["".join(map(chr, table[:, i])) for i in range(len(pieces))]
    for column, order, lcp in substring.suffix_order(table, group):
        want = sorted(range(len(pieces)), key=lambda i: (group[i], strings[i][column:]))
        assert [(group[i], strings[i][column:]) for i in order] == [(group[i], strings[i][column:]) for i in want]
        for i in range(1, len(order)):
            a, b = (strings[j][column:] for j in order[i - 1 : i + 1])
            same = next((x for x, (p, q) in enumerate(zip(a, b, strict=True)) if p != q), len(a)) if group[order[i]] == group[order[i - 1]] else 0
            assert lcp[i] == same
    earlier, later = substring.previous_factors(table, group, length, k)
    seen = collections.defaultdict(list)
    for i, p in enumerate(pieces):
        for j in range(len(p) - length + 1):
            seen[group[i], length - k - offset[i] + j, p[j : j + length]].append(i)
    want = np.zeros((2, *earlier.shape), bool)
    for (_, column, _), at in seen.items():
        for i in at:
            want[0, i, column], want[1, i, column] = i > min(at), i < max(at)
    assert (earlier == want[0]).all() and (later == want[1]).all() and earlier.any()


def test_substring_empty(spark):
    assert substring.substring_dedup(edges.documents(spark, []), keep_first=False).count() == 0
    with pytest.raises(ValueError):
        substring.substring_dedup(edges.documents(spark, []), length=20)


def test_connected():
    r = np.random.default_rng(4)
    sets = [set(r.choice(60, 40, replace=False).tolist()) for _ in range(30)]
    for s in list(sets):
        for _ in range(3):
            t = set(s)
            for x in r.choice(sorted(t), 3, replace=False).tolist():
                t.discard(x)
                t.add(x + 100)
            sets.append(t)
    sizes = np.array([len(s) for s in sets])
    got = paragraphs.connected(np.repeat(np.arange(len(sets)), sizes), sizes, np.concatenate([sorted(s) for s in sets]), 0.8)
    want = roots(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert len(set(zip(got.tolist(), want, strict=True))) == len(set(want)) == len(set(got.tolist()))
