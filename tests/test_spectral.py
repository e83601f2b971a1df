"""Gram-based operators against plain NumPy on raw rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlake.functions import closed_form as CF
from gramlake.functions import vectors as V
from gramlake.operators import downstream as D
from gramlake.operators import gram as G
from gramlake.operators import pairs as P
from gramlake.operators import select as S
from gramlake.operators import spectral as SP
from gramlake.operators import statistics as ST
from gramlake.operators import synthetic as SY
from gramlake.operators import transfer as T
from gramlake.plans import fixtures as X


def frame(spark, mats, labels=None):
    rows = []
    for name, m in mats.items():
        rows += [("t", name, i, int(labels[name][i]) if labels else 0, [float(x) for x in r]) for i, r in enumerate(m)]
    return spark.createDataFrame(rows, "probe string, pool_id string, row_id bigint, label int, features array<double>")


def raw_rank(h, squared=False):
    w = np.linalg.svd(h, compute_uv=False) ** 2 / len(h)
    w = w[w > 1e-10]
    p = w / w.sum() if squared else np.sqrt(w) / np.sqrt(w).sum()
    return np.exp(-(p * np.log(p + 1e-12)).sum())


@pytest.fixture(scope="module")
def mats():
    r = np.random.default_rng(0)
    base = r.standard_normal((40, 3)) @ r.standard_normal((3, 8))
    q = np.linalg.qr(r.standard_normal((8, 8)))[0]
    return {"a": r.standard_normal((60, 8)), "b": base + 1e-3 * r.standard_normal((40, 8)), "c": r.standard_normal((5, 8)), "d": base @ q}


def test_summaries(spark, mats):
    got = {r["pool_id"]: r for r in SP.summarise(G.pool_grams(frame(spark, mats).repartition(3)), 3).collect()}
    for n, m in mats.items():
        s = np.linalg.svd(m, compute_uv=False)
        assert got[n]["r_eff"] == pytest.approx(raw_rank(m), rel=1e-6)
        assert got[n]["vendi"] == pytest.approx(raw_rank(m, True), rel=1e-6)
        assert got[n]["nuclear"] == pytest.approx(s.sum(), rel=1e-6)
        assert got[n]["n"] == len(m) and len(got[n]["sigma"]) == min(m.shape)
        v = np.array(got[n]["basis"]).reshape(8, -1)
        assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-8)
    assert abs(got["b"]["r_eff"] - 3) < 2


def test_merge_adds_grams(spark, mats):
    p = P.analyse(SP.summarise(G.pool_grams(frame(spark, mats)), 3), 3).filter("ds_a = 'a' and ds_b = 'b'").first()
    assert p["r_merged"] == pytest.approx(raw_rank(np.vstack([mats["a"], mats["b"]])), rel=1e-6)
    va, vb = (np.linalg.svd(mats[n])[2][:3].T for n in "ab")
    cos = np.clip(np.linalg.svd(va.T @ vb, compute_uv=False), 0, 1)
    assert p["sa_k"] == pytest.approx((cos**2).mean(), abs=1e-8)
    assert p["v_alpha"] == pytest.approx((cos**2).var(), abs=1e-8)
    assert p["grassmann"] == pytest.approx(np.sqrt((np.arccos(cos) ** 2).sum()), abs=1e-6)


def test_identical_pools(spark, mats):
    s = SP.summarise(G.pool_grams(frame(spark, {"x": mats["a"], "y": mats["a"]})), 4)
    r = P.analyse(s, 4).first()
    assert r["sa_k"] > 0.99 and r["grassmann"] < 1e-5 and r["delta_r"] == pytest.approx(0, abs=1e-6)
    assert not r["is_superadditive"] or r["delta_r"] < 1e-9


def test_dimension_mismatch():
    with pytest.raises(ValueError):
        P.principal_cosines(np.eye(3), np.eye(4))


def test_rank_of_nothing():
    assert SP.effective_rank(np.zeros((4, 4)), 3) == 1.0


def test_predictor_dialects(spark):
    df = spark.createDataFrame([(40.0, 300.0, 1.0, 0.9), (20.0, 20.0, 1.0, 0.0), (10.0, 30.0, 0.5, 1.0), (10.0, 30.0, 0.5, 0.4)], "a double, b double, g double, al double")
    rows = df.select(CF.merged_rank("a", "b", "g", "al").alias("l"), CF.merged_rank("a", "b", "g", "al", CF.SELECTION).alias("s")).collect()
    assert rows[0]["l"] > rows[0]["s"] + 200  # the tie at gamma = 1 goes to B here, to A there
    assert rows[1]["l"] == pytest.approx(40, rel=1e-6) and rows[1]["s"] == pytest.approx(40, rel=1e-6)
    assert rows[2]["l"] == pytest.approx(10, rel=1e-2)
    assert rows[3]["l"] == pytest.approx(rows[3]["s"], abs=1e-6)
    assert df.select(CF.merged_rank("a", "b", "g", "al").alias("l"), F.least("a", "b").alias("lo"), (F.col("a") + F.col("b")).alias("hi")).filter("l < lo or l > hi").count() == 0


def test_joint_score(spark):
    r = spark.range(1).select(P.joint_score(F.lit(45.0), F.lit(0.8)).alias("x")).first()["x"]
    assert r == pytest.approx(45**0.5 * 0.8)


def test_uid_small_pools(spark, mats):
    got = {r["pool_id"]: r["uid"] for r in SP.two_nn(frame(spark, mats)).collect()}
    assert got["c"] is None and got["a"] > 1


def brute_greedy(mats, k, score):
    names = sorted(mats)
    first = max(names, key=lambda n: (round(raw_rank(mats[n], score == "vendi"), 9), [-ord(c) for c in n]))
    chosen = [first]
    while len(chosen) < k:
        cur = np.vstack([mats[n] for n in chosen])
        best = {}
        for n in names:
            if n in chosen:
                continue
            if score == "vendi":
                best[n] = raw_rank(np.vstack([cur, mats[n]]), True)
            else:
                ke = min(20, len(cur), len(mats[n]), 8)
                va, vb = (np.linalg.svd(m, full_matrices=False)[2][:ke] for m in (cur, mats[n]))
                al = (np.linalg.svd(va @ vb.T, compute_uv=False) ** 2).mean()
                nu = lambda m: np.linalg.svd(m, compute_uv=False).sum()
                best[n] = S.predicted_rank(raw_rank(cur), raw_rank(mats[n]), nu(mats[n]) / (nu(cur) + 1e-8), al)
        chosen.append(min(best, key=lambda n: (-round(best[n], 9), n)))
    return chosen


@pytest.mark.parametrize("score", ["prediction", "vendi"])
def test_greedy(spark, mats, score):
    s = SP.summarise(G.pool_grams(frame(spark, mats)))
    got = [r["selected"] for r in S.greedy(S.Pools(s), 3, score)]
    assert got == brute_greedy(mats, 3, score)
    assert [r["selected"] for r in S.greedy(S.Pools(s, local_bytes=0), 3, score)] == got


def test_greedy_takes_all(spark, mats):
    s = SP.summarise(G.pool_grams(frame(spark, mats)))
    assert [r["selected"] for r in S.greedy(S.Pools(s), 9)] == sorted(mats)


def test_near_clone_is_not_first_choice(spark):
    r = np.random.default_rng(3)
    a = r.standard_normal((100, 2)) @ r.standard_normal((2, 12))
    s = SP.summarise(G.pool_grams(frame(spark, {"base": a, "clone": a + 1e-4 * r.standard_normal(a.shape), "new": r.standard_normal((100, 2)) @ r.standard_normal((2, 12))})), 2)
    assert S.greedy(S.Pools(s), 2, "direction", 2, start=["base"])[1]["selected"] == "new"


def test_exhaustive_beats_greedy(spark, mats):
    grams = G.pool_grams(frame(spark, mats))
    pools = S.Pools(SP.summarise(grams))
    best = S.exhaustive(grams, 2).first()["r_eff"]
    assert best >= pools.stack([r["selected"] for r in S.greedy(pools, 2)]).rank - 1e-9
    assert S.regret(best, best) == 0


def test_ties_go_to_the_first_name(spark, mats):
    s = SP.summarise(G.pool_grams(frame(spark, {"z": mats["a"], "y": mats["a"], "x": mats["c"]})))
    assert [r["pool_id"] for r in S.top_pools(s, 2).orderBy("round").collect()] == ["y", "z"]


def test_domain_rule_is_the_loop(spark):
    r = np.random.default_rng(5)
    ranks = {f"p{i:02d}": float(x) for i, x in enumerate(r.random(12))}
    doms = {n: f"d{r.integers(4)}" for n in ranks if n != "p03"}
    df = spark.createDataFrame([("t", n, v) for n, v in ranks.items()], "probe string, pool_id string, r_eff double")
    dd = spark.createDataFrame(list(doms.items()), "pool_id string, domain string")
    got = [x["pool_id"] for x in S.domain_diverse(df, dd, 7).orderBy("round").collect()]
    chosen, seen = [], {}
    while len(chosen) < 7:
        pick = min((n for n in ranks if n not in chosen), key=lambda n: (seen.get(doms.get(n, "unknown"), 0), -ranks[n]))
        seen[doms.get(pick, "unknown")] = seen.get(doms.get(pick, "unknown"), 0) + 1
        chosen.append(pick)
    assert got == chosen


def test_transfer_scores(spark, mats):
    y = {n: np.arange(len(m)) % 3 for n, m in mats.items()}
    y["c"] = np.array([0, 1, 1, 0, 2])  # class 2 has one row
    got = {r["pool_id"]: r for r in T.transferability(frame(spark, mats, y)).collect()}
    for n in ("a", "c"):
        h, lab = mats[n], y[n]
        mu = h.mean(0)
        within = sum((h[lab == c] - h[lab == c].mean(0)).T @ (h[lab == c] - h[lab == c].mean(0)) for c in set(lab) if (lab == c).sum() > 1) / len(h) + 1e-4 * np.eye(8)
        between = sum((lab == c).sum() * np.outer(h[lab == c].mean(0) - mu, h[lab == c].mean(0) - mu) for c in set(lab)) / len(h)
        assert got[n]["hscore"] == pytest.approx(np.trace(np.linalg.inv(within) @ between), rel=1e-6)
        rate = lambda z: 0.5 * np.linalg.slogdet(np.eye(8) + 8 / 0.25 * z.T @ z / len(z))[1]
        assert got[n]["transrate"] == pytest.approx(rate(h) - sum((lab == c).mean() * rate(h[lab == c]) for c in set(lab) if (lab == c).sum() > 1), rel=1e-6)
    assert np.isfinite(got["a"]["logme"])


def test_logme_on_raw_rows(mats):
    h, y = mats["a"], (np.arange(60) % 2).astype(float)
    u, s, _ = np.linalg.svd(h, full_matrices=False)
    al = be = 1.0
    last = -np.inf
    for _ in range(100):
        m = be * s * (u.T @ y) / (al + be * s * s)
        res = ((y - u @ (s * m)) ** 2).sum()
        ev = 0.5 * (8 * np.log(al) + 60 * np.log(be) - be * res - al * (m * m).sum() - np.log(al + be * s * s).sum() - 60 * np.log(2 * np.pi))
        g = (be * s * s / (al + be * s * s)).sum()
        al, be = g / ((m * m).sum() + 1e-10), (60 - g) / (res + 1e-10)
        if abs(ev - last) < 1e-5 * abs(ev):
            break
        last = ev
    assert T.log_evidence(h.T @ h, h.T @ y, 60, float(y @ y)) == pytest.approx(ev / 60, rel=1e-6)


def test_linear_probe_learns(spark):
    r = np.random.default_rng(1)
    lab = np.arange(120) % 3
    h = r.standard_normal((120, 4)) * 0.3 + np.eye(4)[lab]
    f = frame(spark, {"a": h}, {"a": lab})
    train, test = f.filter("row_id < 90"), f.filter("row_id >= 90")
    assert D.accuracy(D.linear_probe(train, test, 50)).first()["accuracy"] > 0.8
    assert D.accuracy(D.fair_probe(f, ["a"], train, test, 50)).first()["accuracy"] > 0.6


def test_augmented_rows_stay_where_they_are(spark):
    """Classes are numbered among themselves: no task gets a pool's rows, and none sorts features."""
    labels = {"a": [7, 3, None], "b": [5, 9, 2], "c": [3], "d": [1]}
    rows = [(p, i, labels[p][i % len(labels[p])], [float(i)]) for p in labels for i in range(30)]
    df = spark.createDataFrame(rows, "pool_id string, row_id bigint, label int, features array<double>").repartition(7).withColumn("at", F.spark_partition_id()).persist()
    out = D.augmented(df, "b", ["c", "b", "x", "a"]).withColumn("now", F.spark_partition_id()).collect()
    df.unpersist()
    number = {("b", 2): 0, ("b", 5): 1, ("b", 9): 2, ("c", 3): 3, ("a", 3): 4, ("a", 7): 5}
    assert {(r["pool_id"], r["row_id"]): r["label"] for r in out} == {(p, i): number[p, y] for p, i, y, _ in rows if (p, y) in number}
    assert len(out) == 80 and all(r["at"] == r["now"] and r["features"] == [float(r["row_id"])] for r in out)


def test_p_values():
    # t = 2.228 with 10 degrees is the two-sided 5 % point
    r = 2.228138852 / np.sqrt(10 + 2.228138852**2)
    assert ST.correlation_p(r, 12) == pytest.approx(0.05, abs=1e-8)
    assert np.isnan(ST.correlation_p(0.5, 2)) and ST.correlation_p(1.0, 5) == 0


def test_pearson_without_variance(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert ST.pearson(df, "x", "y").first()["r"] is None


def test_grid_prediction(spark):
    got = SY.grid(spark, (0.0, 0.5, 1.0), (0.5, 2.0), 1, 128, 15, 200).collect()
    true, pred = np.array([r["r_merged"] for r in got]), np.array([r["r_pred"] for r in got])
    assert 1 - ((true - pred) ** 2).sum() / ((true - true.mean()) ** 2).sum() > 0.999
    assert all(r["is_superadditive"] == (r["alpha"] < 1) for r in got)


def test_karcher_of_one_space(spark, mats):
    s = SP.summarise(G.pool_grams(frame(spark, {"x": mats["a"], "y": mats["a"]})), 3)
    v, b = (np.array(r["basis"]).reshape(8, 3) for r in (P.karcher_mean(s).first(), s.first()))
    assert np.allclose(v @ v.T, b @ b.T, atol=1e-6)


def test_mean_subspace():
    """Two spaces: the geodesic's middle; several: tangents cancel, and any rotation of a basis is the same."""
    r = np.random.default_rng(3)
    a, b, c = (np.linalg.qr(r.normal(size=(9, 3)))[0] for _ in range(3))
    angles = lambda x, y: np.linalg.norm(np.arccos(P.principal_cosines(x, y)))
    m = P.mean_subspace(np.stack([a, b]))
    assert np.isclose(angles(a, m), angles(b, m), atol=1e-6) and np.isclose(angles(a, m) + angles(b, m), angles(a, b), atol=1e-6)
    assert np.allclose(P.subspace_step(a, P.subspace_tangents(a, b[None])[0]) @ P.subspace_step(a, P.subspace_tangents(a, b[None])[0]).T, b @ b.T, atol=1e-9)
    near = np.stack([np.linalg.qr(a + 0.2 * r.normal(size=a.shape))[0] for _ in range(5)])
    m = P.mean_subspace(near)
    assert np.linalg.norm(P.subspace_tangents(m, near).mean(0)) < 1e-9
    turned = P.mean_subspace(near @ np.linalg.qr(r.normal(size=(3, 3)))[0])
    assert np.allclose(m @ m.T, turned @ turned.T, atol=1e-8)
    lines = np.array([[[np.cos(t)], [np.sin(t)]] for t in (0.3, -0.3, np.pi)])
    assert np.allclose(np.abs(P.mean_subspace(lines)[:, 0]), [1, 0], atol=1e-8)
    # a right angle has a direction too
    assert np.isclose(np.linalg.norm(P.subspace_tangents(np.eye(3)[:, :1], np.eye(3)[None, :, 1:2])), np.pi / 2)


def test_summaries_are_read_once(spark, sf):
    """Both halves of a hybrid, and all strategies, fold the features once."""
    from pyspark.sql import functions as F

    from gramlake.operators import select as S
    from gramlake.plans import fixtures

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = fixtures.pools(spark, sf)
    total = rows.count()
    s = SP.summarise(G.pool_grams(rows.mapInArrow(count, rows.schema))).persist()
    S.hybrid_spread_then_predict(S.Pools(s), s.select("pool_id", G.centroid().alias("centroid")), 5)
    S.compare_strategies(spark, s, s.select("pool_id", G.centroid().alias("centroid")), spark.createDataFrame([("p0", "d")], "pool_id string, domain string"), [3], [1])
    s.unpersist()
    assert seen.value == total


@pytest.mark.parametrize("name", ["classical_mds", "target_greedy_d2", "hybrid_col_dom", "hybrid_col_cen"])
def test_summaries_are_made_by_few_tasks(spark, sf, monkeypatch, name):
    """Ten pools are decomposed once, by one task, however many partitions their sums are shuffled to."""
    from gramlake.plans import fixtures, rounds

    begun = spark.sparkContext.accumulator(0)

    def count(batches):
        begun.add(1)
        yield from batches

    def summaries(spark, sf, **kw):
        grams = G.pool_grams(fixtures.pools(spark, sf, **kw))
        return SP.summarise(grams.mapInArrow(count, grams.schema))

    monkeypatch.setattr(rounds, "summaries", summaries)
    assert getattr(rounds, name)(spark, sf).count() and begun.value == 1


def test_held_by_bytes(spark, sf):
    from gramlake.plans import fixtures

    s = fixtures.summaries(spark, sf)
    for part_bytes, least, most in ((G.PART_BYTES, 1, 1), (3 * 8 * 64 * 64, 2, 4)):
        with G.held(s, part_bytes) as kept:
            assert least <= kept.rdd.getNumPartitions() <= most
            assert sorted(r["pool_id"] for r in kept.collect()) == [f"p{i}" for i in range(10)]


def test_farthest_first_near_and_far(spark, sf):
    from gramlake.operators import select as S
    from gramlake.plans import fixtures

    c = G.pool_grams(fixtures.pools(spark, sf)).select("pool_id", G.centroid().alias("centroid"))
    assert S.farthest_first(c, 5) == S.farthest_first(c, 5, local_bytes=0)


def test_two_nn_in_blocks(spark, sf):
    from gramlake.plans import fixtures

    rows = fixtures.pools(spark, sf)
    one, many = ({r["pool_id"]: (r["n"], round(r["uid"], 9)) for r in SP.two_nn(rows, block=b).collect()} for b in (2048, 7))
    assert one == many and len(one) == 10


def test_compaction_of_a_fold(spark, tmp_path):
    from gramlake.streaming import fold

    for i in range(3):
        G.pool_grams(frame(spark, {"x": np.eye(4)[i : i + 2]}), fold.KEYS).drop("d").write.parquet(f"{tmp_path}/batch={i}")
    read = lambda: [(r["pool_id"], r["n"], list(r["gram"])) for r in fold.read_fold(spark, str(tmp_path)).collect()]
    before = read()
    fold.compact_fold(spark, str(tmp_path))
    fold.compact_fold(spark, str(tmp_path))
    import os

    assert read() == before and [n for n in os.listdir(tmp_path) if "=" in n] == ["sum=2"]


def test_vectors(spark):
    r = spark.range(1).select(V.running(F.array(*map(F.lit, [1.0, 2.0, 3.0]))).alias("c"), V.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("z")).first()
    assert r["c"] == [1.0, 3.0, 6.0] and r["z"] == [0.0, 0.0]


def test_summaries_fixture(spark, sf):
    assert X.summaries(spark, sf, dims=2).count() == 10


def test_loss_gradient(spark):
    rng = np.random.default_rng(5)
    bases = [np.linalg.qr(rng.normal(size=(9, k)))[0] for k in (3, 3, 2)]
    loss = lambda bs, k: sum((np.arccos(np.clip(np.linalg.svd(a[:, : min(k, a.shape[1], b.shape[1])].T @ b[:, : min(k, a.shape[1], b.shape[1])], compute_uv=False), 1e-6, 1 - 1e-6)) ** 2).sum() for i, a in enumerate(bs) for b in bs[i + 1 :])
    pools = spark.createDataFrame([("e", f"p{i}", b.ravel().tolist(), b.shape[1]) for i, b in enumerate(bases)], "probe string, pool_id string, basis array<double>, k int")
    got = {r["pool_id"]: np.array(r["gradient"]).reshape(r["d"], r["k"]) for r in P.loss_gradient(P.pool_pairs(pools)).collect()}
    for i, b in enumerate(bases):
        want = np.zeros_like(b)
        for at in np.ndindex(b.shape):
            step = np.zeros_like(b)
            step[at] = 1e-6
            up, down = ([*bases[:i], b + sign * step, *bases[i + 1 :]] for sign in (1, -1))
            want[at] = (loss(up, 3) - loss(down, 3)) / 2e-6
        assert np.allclose(got[f"p{i}"], want, atol=1e-5)
    # equal spaces lie beyond the clamp: nothing pulls
    assert not P.angle_gradient(bases[0], bases[0]).any()


def test_stress_mds(spark):
    rng = np.random.default_rng(3)
    names = [f"p{i}" for i in range(8)]
    frame = lambda d: spark.createDataFrame([(a, b, float(d[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "ds_i string, ds_j string, distance double")
    flat = D.point_distances(rng.normal(size=(8, 2)))
    rows = sorted(D.stress_mds(frame(flat)).collect())
    assert rows[0]["stress"] < 1e-9 and np.allclose(D.point_distances(np.array([r["x"] for r in rows])), flat, atol=1e-5)
    # distances that no plane holds: no worse than the classical points, and stationary
    d = rng.uniform(0.2, 1, size=(8, 8))
    d = (d + d.T) / 2 * (1 - np.eye(8))
    x = np.array([r["x"] for r in sorted(D.stress_mds(frame(d)).collect())])
    classical = np.array([r["x"] for r in sorted(D.classical_mds(frame(d)).collect())])
    assert D.stress(d, x) < D.stress(d, classical)
    assert all(D.stress(d, x + rng.normal(scale=1e-3, size=x.shape)) > D.stress(d, x) - 1e-6 for _ in range(50))


def test_evaluator_correlations(spark):
    rows = [("a", i, float(i), float(i * i), None if i == 3 else float(-i)) for i in range(5)] + [("b", i, float(i), 2.0, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "dataset string, probe int, lp double, knn double, r_eff double")
    got = {(r["scope"], r["x"], r["y"]): (r["n"], r["r"], r["rho"]) for r in ST.evaluator_correlations(df, ["lp", "knn", "r_eff"]).collect()}
    assert {k[0] for k in got} == {"all", "a"}
    assert got["a", "lp", "knn"][0] == 5 and abs(got["a", "lp", "knn"][1] - np.corrcoef(range(5), np.arange(5) ** 2)[0, 1]) < 1e-9 and abs(got["a", "lp", "knn"][2] - 1) < 1e-9
    assert got["a", "lp", "r_eff"][0] == 4 and abs(got["a", "lp", "r_eff"][1] + 1) < 1e-9
    x, y = zip(*((r[2], r[3]) for r in rows))
    assert got["all", "lp", "knn"][0] == 8 and abs(got["all", "lp", "knn"][1] - np.corrcoef(x, y)[0, 1]) < 1e-9


def test_pool_pairs_over_blocks(spark):
    names = [f"p{i}" for i in range(12)]
    pools = spark.createDataFrame([(probe, n, i) for probe in ("e", "f") for i, n in enumerate(names)], "probe string, pool_id string, v int")
    want = sorted((probe, a, b) for probe in ("e", "f") for a in names for b in names if a < b)
    for blocks in (1, 3, 8):
        pairs = P.pool_pairs(pools, blocks=blocks)
        assert pairs.columns == ["probe", "pool_id_a", "v_a", "pool_id_b", "v_b"]
        assert sorted((r["probe"], r["pool_id_a"], r["pool_id_b"]) for r in pairs.collect()) == want
