"""Selection and scaling over blocks of rows, against plain versions on whole matrices."""

import itertools

import numpy as np
import pytest

from gramlake.operators import downstream as D
from gramlake.operators import gram as G
from gramlake.operators import pairs as P
from gramlake.operators import select as S
from gramlake.operators import spectral as SP
from gramlake.operators.blocks import BlockRows
from gramlake.plans import QUERIES, fixtures

NAMES = [f"p{i:02d}" for i in range(30)]


def long(spark, d, names=NAMES, value="value"):
    return spark.createDataFrame([(a, b, float(d[i, j])) for i, a in enumerate(names[: len(d)]) for j, b in enumerate(names[: len(d)])], f"ds_i string, ds_j string, {value} double").repartition(3)


def alike(seed, m, levels=None):
    r = np.random.default_rng(seed)
    s = r.random((m, m)) if levels is None else r.integers(0, levels, (m, m)) / levels
    s = (s + s.T) / 2
    np.fill_diagonal(s, 1.0)
    return s


def plain_location(s, k):
    best, chosen = np.zeros(len(s)), []
    while len(chosen) < min(k, len(s)):
        gain = {c: round(float(np.maximum(best, s[:, c]).sum()), 9) for c in range(len(s)) if c not in chosen}
        pick = min(gain, key=lambda c: (-gain[c], c))
        chosen.append(pick)
        best = np.maximum(best, s[:, pick])
    return chosen


def plain_medoids(s, k):
    cost = lambda chosen: round(float((1 - s[:, chosen]).min(1).sum()), 9)
    medoids = sorted(plain_location(s, k))
    while True:
        options = [(cost(t), t) for out in medoids for new in range(len(s)) if new not in medoids for t in [sorted([*(c for c in medoids if c != out), new])]]
        if not options or min(options)[0] >= cost(medoids):
            return medoids
        medoids = min(options)[1]


@pytest.mark.parametrize("m, k, levels", [(10, 3, None), (30, 6, None), (20, 5, 3), (4, 9, None), (12, 1, 2)])
@pytest.mark.parametrize("block", [8 * 30 * 7, 16 << 20])
def test_facility_location_and_medoids(spark, m, k, levels, block):
    s = alike(m + k, m, levels)
    matrix = BlockRows(long(spark, s), block_bytes=block)
    assert matrix.blocks == (1 if block > 1 << 20 else -(-m // max(1, block // (8 * m))))
    assert S.facility_location(matrix, k) == [NAMES[c] for c in plain_location(s, k)]
    assert S.k_medoids(matrix, k) == [NAMES[c] for c in plain_medoids(s, k)]
    matrix.release()


@pytest.mark.parametrize("per_block", [1, 3, 100])
def test_a_partition_for_each_block(spark, per_block):
    d = np.random.default_rng(5).uniform(size=(7, 7))
    matrix = BlockRows(long(spark, d), value="value", block_bytes=8 * 7 * per_block)
    assert matrix.blocks == -(-7 // per_block) == matrix.frame.rdd.getNumPartitions()
    assert np.array_equal(np.concatenate([v for _, v in matrix.rows(lambda _, b, __: b, None)]), d.ravel())
    matrix.release()


def test_lazy_gains_skip_candidates(spark):
    """Tight groups: after the first round most bounds are too small to be looked at again."""
    r = np.random.default_rng(1)
    at = np.concatenate([c + 0.01 * r.standard_normal((50, 2)) for c in ((0, 0), (5, 5), (9, 0), (0, 9))])
    s = np.exp(-np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1)))
    names = [f"p{i:03d}" for i in range(200)]
    matrix = BlockRows(long(spark, s, names), block_bytes=8 * 200 * 64)
    assert S.facility_location(matrix, 4) == [names[c] for c in plain_location(s, 4)]
    assert matrix.evaluations < 200 + 3 * 199
    matrix.release()


@pytest.mark.parametrize("score, calls", [("prediction", 1), ("direction", 1)])
def test_one_decomposition_a_round(spark, sf, monkeypatch, score, calls):
    """SEL1b: scoring ten pools over four rounds decomposes the stack once a round and no candidate."""
    pools = S.Pools(fixtures.summaries(spark, sf))
    made = []
    for name in ("eigh", "eigvalsh", "svd"):
        true = getattr(np.linalg, name)
        monkeypatch.setattr(np.linalg, name, lambda *a, true=true, name=name, **kw: (made.append(name), true(*a, **kw))[1])
    got = [r["selected"] for r in S.greedy(pools, 5, score)]
    assert len(made) <= 4 * calls
    monkeypatch.undo()
    # the same choices as scoring by the stacked rows
    x = {p: np.array(g["features"].tolist()) for p, g in fixtures.pools(spark, sf).toPandas().groupby("pool_id")}
    rank = lambda s: np.exp(-np.sum(s / s.sum() * np.log(s / s.sum() + 1e-12)))
    chosen = [max(sorted(x), key=lambda p: round(rank(np.linalg.svd(x[p], compute_uv=False)), 9))]
    while len(chosen) < 5:
        _, s, v = np.linalg.svd(np.vstack([x[p] for p in chosen]), full_matrices=False)
        values = {}
        for p in sorted(set(x) - set(chosen)):
            _, t, w = np.linalg.svd(x[p], full_matrices=False)
            align = np.sum((v[:20] @ w[:20].T) ** 2) / 20
            values[p] = round(1 - align if score == "direction" else S.predicted_rank(rank(s), rank(t), t.sum() / (s.sum() + 1e-8), align), 6)
        chosen.append(min(values, key=lambda p: (-values[p], p)))
    assert got == chosen


def test_subsets_by_number():
    for m, k in ((6, 3), (7, 1), (5, 5), (9, 4)):
        every = [list(c) for c in itertools.combinations(range(m), k)]
        assert [S.unranked(i, m, k) for i in range(len(every))] == every
        at = S.unranked(0, m, k)
        for want in every[1:]:
            before = list(at)
            changed = S._following(at, m)
            assert at == want and at[:changed] == before[:changed] and at[changed] != before[changed]


@pytest.mark.parametrize("local", [0, 256 << 20])
def test_exhaustive(spark, local):
    r = np.random.default_rng(2)
    mats = {f"p{i}": r.standard_normal((15, 6)) * r.random(6) for i in range(7)}
    rows = [("p", n, i, v.tolist()) for n, m in mats.items() for i, v in enumerate(m)]
    grams = G.pool_grams(spark.createDataFrame(rows, "probe string, pool_id string, row_id bigint, features array<double>"))
    got = S.exhaustive(grams, 3, local).collect()
    rank = lambda s: np.exp(-np.sum(s / s.sum() * np.log(s / s.sum() + 1e-12)))
    want = {c: rank(np.linalg.svd(np.vstack([mats[n] for n in c]), compute_uv=False)) for c in itertools.combinations(sorted(mats), 3)}
    assert {tuple(r["subset"]) for r in got} == set(want) and all(np.isclose(r["r_eff"], want[tuple(r["subset"])]) for r in got)
    assert [round(r["r_eff"], 9) for r in got] == sorted((round(r["r_eff"], 9) for r in got), reverse=True)


def test_many_subsets_need_no_list(spark):
    """25 pools, five at a time: 53,130 subsets."""
    r = np.random.default_rng(3)
    rows = [(f"p{i:02d}", 9, (m.T @ m).ravel().tolist(), m.sum(0).tolist()) for i in range(25) for m in [r.standard_normal((9, 3)) * r.random(3)]]
    grams = spark.createDataFrame(rows, "pool_id string, n int, gram array<double>, colsum array<double>")
    got = S.exhaustive(grams, 5).limit(1).collect() and S.exhaustive(grams, 5)
    assert got.count() == 53130
    sums = {c: SP.effective_rank(sum(np.array(rows[i][2]).reshape(3, 3) for i in c), 45) for c in itertools.combinations(range(25), 5)}
    assert np.isclose(got.first()["r_eff"], max(sums.values()))


def test_classical_scaling(spark):
    """Eigenvectors by products with blocks, also where negative eigenvalues are larger or values repeat."""
    r = np.random.default_rng(4)
    flat = D.point_distances(r.normal(size=(30, 2)))
    rough = r.uniform(0.1, 1, (30, 30))
    rough = (rough + rough.T) / 2 * (1 - np.eye(30))
    even = 1 - np.eye(6)
    for d in (flat, rough, even, even[:1, :1], even[:2, :2]):
        m = len(d)
        c = np.eye(m) - 1 / m
        w, v = np.linalg.eigh(-0.5 * c @ d**2 @ c)
        want = np.sqrt(np.maximum(w[::-1][:2], 0))
        for block in (8 * m * 7, 16 << 20):
            x = np.array([q["x"] for q in sorted(D.classical_mds(long(spark, d, value="distance"), block_bytes=block).collect())])
            assert x.shape == (m, 2) and np.allclose(np.linalg.norm(x - x.mean(0), axis=0), np.pad(want, (0, 2 - len(want))), atol=1e-6)
            if d is flat:
                assert np.allclose(D.point_distances(x), d, atol=1e-6)


def test_stress_over_blocks(spark):
    r = np.random.default_rng(5)
    d = r.uniform(0.2, 1, (10, 10))
    d = (d + d.T) / 2 * (1 - np.eye(10))
    one, many = (sorted(D.stress_mds(long(spark, d, value="distance"), starts=2, rounds=25, block_bytes=b).collect()) for b in (16 << 20, 8 * 10 * 3))
    assert [q["ds_i"] for q in one] == [q["ds_i"] for q in many] == NAMES[:10]
    assert np.allclose([q["x"] for q in one], [q["x"] for q in many], atol=1e-7) and np.isclose(one[0]["stress"], many[0]["stress"])
    assert np.isclose(one[0]["stress"], D.stress(d, np.array([q["x"] for q in one])))
    assert D.stress_mds(long(spark, d, value="distance").filter("false")).count() == 0


def test_karcher_mean_by_rounds(spark):
    """Bases that don't fit into a task: the same mean, from sums of tangents; two probes end at different rounds."""
    r = np.random.default_rng(6)
    rows, want = [], {}
    for probe, spread in (("e", 0.05), ("f", 0.4)):
        base = np.linalg.qr(r.standard_normal((12, 4)))[0]
        bases = [np.linalg.qr(base + spread * r.standard_normal(base.shape))[0] for _ in range(9)]
        rows += [(probe, f"p{i}", 4 if i else 3, (b if i else b[:, :3]).ravel().tolist()) for i, b in enumerate(bases)]
        want[probe] = P.mean_subspace(np.stack([b[:, :3] for b in bases]))
    frame = spark.createDataFrame(rows, "probe string, pool_id string, k int, basis array<double>").repartition(4)
    for block in (0, 16 << 20):
        got = {q["probe"]: np.array(q["basis"]).reshape(q["d"], q["k"]) for q in P.karcher_mean(frame, block_bytes=block).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[p] @ got[p].T, want[p] @ want[p].T, atol=1e-8) for p in want)


def test_queries_by_blocks(spark, sf):
    from gramlake.plans.rounds import _similarity

    small = _similarity(spark, sf, 8 * 10 * 3)
    assert small.blocks == 4
    assert [r["pool_id"] for r in QUERIES["facility_location"](spark, sf).orderBy("round").collect()] == S.facility_location(small, 3)
    assert [r["pool_id"] for r in QUERIES["k_medoids"](spark, sf).orderBy("round").collect()] == S.k_medoids(small, 3)
    small.release()
