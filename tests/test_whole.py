"""Queries over all rows and dimensions, which SQL does not express, against NumPy."""

import numpy as np

from gramlake.plans import QUERIES
from gramlake.plans.fixtures import pools


def test_cka_pairs(spark, sf):
    rows = pools(spark, sf).select("pool_id", "row_id", "features").toPandas().sort_values("row_id")
    x = {p: np.array(g["features"].tolist()) for p, g in rows.groupby("pool_id")}
    assert len({len(v) for v in x.values()}) > 1 and {v.shape[1] for v in x.values()} == {64}
    got = {(r["ds_a"], r["ds_b"]): r["cka"] for r in QUERIES["cka_pairs"](spark, sf).collect()}
    assert set(got) == {(a, b) for a in x for b in x if a < b}
    for (a, b), cka in got.items():
        n = min(len(x[a]), len(x[b]))
        ca, cb = (v[:n] - v[:n].mean(0) for v in (x[a], x[b]))
        want = np.sum((ca.T @ cb) ** 2) / np.sqrt(np.sum((ca.T @ ca) ** 2) * np.sum((cb.T @ cb) ** 2))
        assert abs(cka - want) < 2e-6


def test_full_width_against_numpy(spark, sf):
    """Ranks, energies and angles at 64 dimensions and 20 directions from the rows' own decomposition."""
    rows = pools(spark, sf).select("pool_id", "features").toPandas()
    x = {p: np.array(g["features"].tolist()) for p, g in rows.groupby("pool_id")}
    s = {p: np.linalg.svd(v, compute_uv=False) for p, v in x.items()}
    b = {p: np.linalg.svd(v, full_matrices=False)[2][:20].T for p, v in x.items()}
    rank = lambda t: np.exp(-np.sum(t / t.sum() * np.log(t / t.sum() + 1e-12)))
    for name, column, want in (("reff", "r_eff", lambda p: rank(s[p])), ("nuclear", "nuclear", lambda p: s[p].sum()), ("vendi", "vendi", lambda p: rank(s[p] ** 2)), ("condition", "kappa", lambda p: s[p][0] / s[p][19]), ("reff_normalised", "r_norm", lambda p: rank(s[p]) / min(x[p].shape))):
        got = {r["pool_id"]: r[column] for r in QUERIES[f"{name}_d64"](spark, sf).collect()}
        assert got.keys() == x.keys() and all(np.isclose(got[p], want(p), rtol=1e-4) for p in x), name
    cos = lambda p, q: np.clip(np.linalg.svd(b[p].T @ b[q], compute_uv=False), 0, 1)
    w1 = lambda p, q: np.abs(np.cumsum(s[p] / s[p].sum()) - np.cumsum(s[q] / s[q].sum())).sum()
    pair = {"sa1": ("sa_k", lambda p, q: np.mean(cos(p, q) ** 2)), "grassmann": ("distance", lambda p, q: np.linalg.norm(np.arccos(cos(p, q)))), "svcca": ("svcca", lambda p, q: cos(p, q).mean()), "direction_gain": ("gain", lambda p, q: 1 - np.mean(cos(p, q) ** 2)), "pwcca": ("pwcca", lambda p, q: np.sum(s[p][:20] ** 2 * cos(p, q)) / np.sum(s[p][:20] ** 2)), "joint_score": ("score", lambda p, q: np.sqrt(rank(s[p])) * np.mean(cos(p, q) ** 2)), "energy_alignment": ("alpha_e", lambda p, q: np.sum(s[p][:20] * cos(p, q) ** 2) / s[p][:20].sum())}
    if len({len(v) for v in s.values()}) == 1:
        pair |= {"w1_padded": ("w1", w1), "stg_truncated": ("stg", w1)}
    for name, (column, want) in pair.items():
        got = {(r["ds_a"], r["ds_b"]): r[column] for r in QUERIES[f"{name}_d64"](spark, sf).collect()}
        assert len(got) == 45 and all(np.isclose(got[p, q], want(p, q), atol=2e-5) for p, q in got), name
    best = QUERIES["exhaustive_k2_d64"](spark, sf).collect()
    want = {f"{p},{q}": rank(np.linalg.svd(np.vstack((x[p], x[q])), compute_uv=False)) for p in x for q in x if p < q}
    assert all(np.isclose(r["r_eff"], want[r["subset"]], rtol=1e-4) for r in best) and len(best) == 45


def test_joint_matrix_lookup_all(spark, tmp_path):
    """Odd nation keys have scores too; only a nation without suppliers has none."""
    spark.createDataFrame([(0, "a", 0), (1, "b", 0), (2, "c", 0), (3, "d", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(5, 1, 10.0), (2, 1, 20.0), (3, 0, 30.0)], "s_suppkey int, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r["ds_a"], r["ds_b"]): r["score"] for r in QUERIES["joint_matrix_lookup_all"](spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): 20.0, ("a", "c"): 30.0, ("a", "d"): 30.0, ("b", "c"): 20.0, ("b", "d"): 20.0, ("c", "d"): None}


def test_cka_by_stretches(spark):
    """Stretches of a few positions, pools of several lengths, two probes."""
    from gramlake.operators import pairs as P

    r = np.random.default_rng(9)
    x = {(probe, n): r.standard_normal((m, 4)) for probe, sizes in (("e", (30, 17, 23)), ("f", (9, 40))) for n, m in zip("abc", sizes, strict=False)}
    df = spark.createDataFrame([(p, n, i, v.tolist()) for (p, n), m in x.items() for i, v in enumerate(m)], "probe string, pool_id string, row_id bigint, features array<double>").repartition(3)
    for block, first in ((8 * 4 * 3 * 5, None), (1 << 24, None), (1, 12)):
        got = {(q["probe"], q["ds_a"], q["ds_b"]): q["cka"] for q in P.linear_cka(df, first, block).collect()}
        assert set(got) == {("e", "a", "b"), ("e", "a", "c"), ("e", "b", "c"), ("f", "a", "b")}
        for (p, a, b), cka in got.items():
            n = min(len(x[p, a]), len(x[p, b]), first or 99)
            ca, cb = (v[:n] - v[:n].mean(0) for v in (x[p, a], x[p, b]))
            assert np.isclose(cka, np.sum((ca.T @ cb) ** 2) / np.sqrt(np.sum((ca.T @ ca) ** 2) * np.sum((cb.T @ cb) ** 2)))


def test_strategies_are_evaluated(spark, sf):
    rows = QUERIES["strategy_targets"](spark, sf).collect()
    assert {r["strategy"] for r in rows} == {"prediction", "vendi", "max_rank", "domain_diverse", "farthest_first", "spread_then_predict", "predict_then_spread", "predict_then_domains", "random"}
    assert all(0 <= r["lp"] <= 1 and 0 <= r["knn"] <= 1 and r["seconds"] >= 0 and "p3" not in r["selected"] for r in rows)
    by = {}
    assert all(by.setdefault(tuple(sorted(r["selected"])), (r["lp"], r["knn"])) == (r["lp"], r["knn"]) for r in rows)
