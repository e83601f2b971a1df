"""Tiled Grams, kernels of rows, triangular factors and moments against NumPy."""

import numpy as np
import pyarrow as pa
import pytest

from gramlake.operators import downstream as D
from gramlake.operators import gram as G
from gramlake.operators import spectral as SP
from gramlake.plans import QUERIES
from gramlake.plans.fixtures import pools

SCHEMA = "probe string, pool_id string, row_id bigint, features array<double>"


def frame(spark, mats, parts=5):
    rows = [("p", name, i, v.tolist()) for name, m in mats.items() for i, v in enumerate(m)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def rank(s):
    return np.exp(-np.sum(s / s.sum() * np.log(s / s.sum() + 1e-12)))


@pytest.mark.parametrize("fan", [2, 64])
def test_tiles_add_up(spark, fan):
    """1,024 dimensions in tiles of 1 MB, over partitions that pass on what they hold after each pool."""
    r = np.random.default_rng(0)
    mats = {f"a{i}": r.standard_normal((60, 1024)) for i in range(3)}
    got = G.pool_grams(frame(spark, mats, 9), tile_bytes=1 << 20, held_bytes=9 << 20, fan=fan).collect()
    assert {x["pool_id"] for x in got} == set(mats) and all(x["n"] == 60 and x["d"] == 1024 for x in got)
    for x in got:
        m = mats[x["pool_id"]]
        assert np.allclose(np.array(x["gram"]).reshape(1024, 1024), m.T @ m) and np.allclose(x["colsum"], m.sum(0))


def test_a_partition_holds_bounded_bytes():
    """However many pools a partition meets, it never holds more Grams than held_bytes, and tiles stay small."""
    d, held = 256, 3 * 8 * 256 * 256
    tracked, most = [], 0
    x = np.random.default_rng(1).standard_normal((40, d))
    batch = pa.RecordBatch.from_arrays([pa.array([f"k{i % 20}" for i in range(40)]), pa.array(list(x), pa.list_(pa.float64()))], names=["pool_id", "features"])
    run = G._fold(["pool_id"], 1 << 16, held)
    import tracemalloc

    tracemalloc.start()
    for out in run(iter([batch, batch])):
        tracked.append(8 * len(out.column("part")[0]))
        most = max(most, tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert max(tracked) <= 1 << 16 and most < 2 * held
    assert len(tracked) >= 20 * (d * d * 8 >> 16)


def test_levels_follow_the_partitions(spark):
    few, many = spark.range(10), spark.range(10)
    assert G.levels(few, 64) == 1
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5000")
    try:
        assert G.levels(many, 64) == 3 and G.levels(many, 5000) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("block", [1 << 19, 64 << 20])
def test_row_side(spark, block):
    """50 rows of 4,096 dimensions: the products of rows have the ranks of the rows."""
    r = np.random.default_rng(2)
    mats = {"a": r.standard_normal((50, 4096)) * np.linspace(1, 0.1, 50)[:, None], "b": np.tile(r.standard_normal((1, 4096)), (7, 1)), "c": r.standard_normal((1, 4096))}
    got = {x["pool_id"]: x for x in G.row_kernels(frame(spark, mats), block_bytes=block).collect()}
    for name, m in mats.items():
        assert got[name]["n"] == len(m) and got[name]["d"] == 4096
        assert np.allclose(np.array(got[name]["gram"]).reshape(len(m), -1), m @ m.T) and np.allclose(got[name]["colsum"], m.sum(0))


def test_sides_agree(spark):
    r = np.random.default_rng(3)
    mats = {"wide": r.standard_normal((12, 40)), "square": r.standard_normal((40, 40)), "tall": r.standard_normal((90, 40))}
    got = {x["pool_id"]: x for x in SP.side_ranks(frame(spark, mats)).collect()}
    assert {k: x["side"] for k, x in got.items()} == {"wide": "rows", "square": "rows", "tall": "columns"}
    for name, m in mats.items():
        s = np.linalg.svd(m, compute_uv=False)
        assert np.allclose(got[name]["sigma"], s, atol=1e-6) and np.isclose(got[name]["r_eff"], rank(s)) and np.isclose(got[name]["nuclear"], s.sum()) and np.isclose(got[name]["vendi"], rank(s**2))
    assert SP.side_ranks(frame(spark, mats).filter("false")).count() == 0


@pytest.mark.parametrize("fan", [2, 64])
def test_small_singular_values_count(spark, fan):
    """Singular values of 1e-9 are above the floor, those of 1e-12 below; a Gram can't tell."""
    r = np.random.default_rng(4)
    u, v = np.linalg.qr(r.standard_normal((300, 8)))[0], np.linalg.qr(r.standard_normal((8, 8)))[0]
    sigma = np.array([1.0, 0.5, 1e-3, 1e-6, 1e-9, 5e-10, 1e-12, 0])
    mats = {"a": u * sigma @ v.T, "b": r.standard_normal((3, 8))}
    got = {x["pool_id"]: x for x in SP.sigma_ranks(frame(spark, mats, 7)).collect()}
    assert np.allclose(got["a"]["sigma"][:6], sigma[:6], rtol=1e-4) and (np.array(got["a"]["sigma"]) > 1e-10).sum() == 6
    for name, m in mats.items():
        s = np.linalg.svd(m, compute_uv=False)
        s = s[s > 1e-10]
        assert abs(got[name]["r_eff_sigma"] - np.exp(-np.sum(s / s.sum() * np.log(s / s.sum() + 1e-30)))) < 1e-10 and got[name]["n"] == len(m)


def test_whole_queries(spark, sf):
    x = {p: np.array(g["features"].tolist()) for p, g in pools(spark, sf).toPandas().groupby("pool_id")}
    got = {r["pool_id"]: r["r_eff_sigma"] for r in QUERIES["reff_sigma_d64"](spark, sf).collect()}
    assert got.keys() == x.keys() and all(abs(got[p] - rank(np.linalg.svd(x[p], compute_uv=False))) < 2e-6 for p in x)
    sides = QUERIES["reff_sides_d64"](spark, sf).collect()
    assert {r["side"] for r in sides if r["probe"] == "tenths"} == {"rows"}
    plain = {r["pool_id"]: r["r_eff"] for r in QUERIES["reff_d64"](spark, sf).collect()}
    assert all(abs(r["r_eff"] - plain[r["pool_id"]]) < 2e-6 for r in sides if r["probe"] == "emb") and len(sides) > 10


@pytest.mark.parametrize("parts", [1, 7])
def test_scaling(spark, parts):
    """Constants give exactly 1, columns far from zero keep their deviation."""
    r = np.random.default_rng(5)
    x = np.column_stack([np.full(1000, c) for c in (0.1, 0.3, 7.7, 1e9 / 3)] + [1e6 + r.standard_normal(1000), 1e9 + 1e-3 * r.standard_normal(1000), r.standard_normal(1000)])
    row = D.scaling(frame(spark, {"a": x}, parts)).first()
    assert row["std"][:4] == [1.0] * 4 and row["mean"][:4] == x[0, :4].tolist()
    assert np.allclose(row["std"][4:], x[:, 4:].std(0), rtol=1e-9) and np.allclose(row["mean"], x.mean(0), rtol=1e-12, atol=1e-15)
    assert D.scaling(frame(spark, {"a": x}).filter("false")).count() == 0
