"""Nearest neighbours by bounded blocks against all pairs."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlake.functions import vectors as V
from gramlake.operators import downstream as D
from gramlake.operators import neighbours as N
from gramlake.operators import spectral as SP


def clusters(seed, sizes, d=5, spread=0.05):
    r = np.random.default_rng(seed)
    return np.concatenate([10 * r.standard_normal(d) + spread * r.standard_normal((n, d)) for n in sizes])


def frame(spark, x, name, keys=None):
    keys = keys or ["a"] * len(x)
    return spark.createDataFrame([(g, i, v.tolist()) for i, (g, v) in enumerate(zip(keys, x, strict=True))], f"g string, {name} bigint, x array<double>").repartition(4)


def plain(q, x, k, same=False):
    out = set()
    for i, v in enumerate(q):
        d = np.round(np.sqrt(((x - v) ** 2).sum(1)), 9)
        ranked = sorted((d[j], j) for j in range(len(x)) if not (same and i == j))[:k]
        out |= {(i, j) for _, j in ranked}
    return out


@pytest.mark.parametrize("block", [2048, 40, 7])
def test_nearest(spark, block):
    """Clusters, ties, equal rows and a row far from all, in blocks of several sizes."""
    x = np.concatenate((clusters(0, (60, 90, 50)), np.zeros((30, 5)), np.full((1, 5), 1e3), np.round(np.random.default_rng(1).standard_normal((60, 5)))))
    q = np.concatenate((x[::7] + 0.01, np.full((2, 5), -500.0), np.zeros((3, 5))))
    got = {(r["row_id"], r["other_id"]) for r in N.nearest(frame(spark, x, "other_id"), frame(spark, q, "row_id"), 5, block=block).collect()}
    assert got == plain(q, x, 5)
    rows = frame(spark, x, "row_id")
    own = N.nearest(rows.withColumnRenamed("row_id", "other_id"), rows, 2, ["g"], same=True, block=block)
    assert {(r["row_id"], r["other_id"]) for r in own.collect()} == plain(x, x, 2, same=True)


def test_nearest_stays_within_keys(spark):
    x = clusters(2, (50, 50))
    keys = ["a" if i % 3 else None for i in range(100)]
    rows = frame(spark, x, "row_id", keys)
    got = {(r["row_id"], r["other_id"]) for r in N.nearest(rows.withColumnRenamed("row_id", "other_id"), rows, 2, ["g"], same=True, block=8).collect()}
    want = set()
    for g in ("a", None):
        at = [i for i in range(100) if keys[i] == g]
        want |= {(at[i], at[j]) for i, j in plain(x[at], x[at], 2, same=True)}
    assert got == want


def test_block_pairs_are_skipped(spark):
    """Ten groups far apart: blocks of other groups are not visited."""
    x = clusters(3, (100,) * 10)
    rows = frame(spark, x, "row_id")
    pivots = N.choose_pivots(rows, "row_id", 8)
    placed = N.dealt(N._measured(rows, pivots), "row_id", [], 50)
    bounds = N.block_bounds(placed, [], len(pivots)).persist()
    blocks = bounds.count()
    pairs = N.block_pairs(bounds, bounds, [], 3).count()
    assert blocks >= 20 and pairs < 0.35 * blocks * blocks
    assert placed.count() == 1000 and placed.groupBy("block").count().agg(F.max("count")).first()[0] <= 150
    bounds.unpersist()


def test_empty_and_small(spark):
    none, rows = frame(spark, np.zeros((0, 5)), "other_id"), frame(spark, clusters(4, (3,)), "row_id")
    assert N.nearest(none, rows, 5).count() == 0
    assert N.nearest(rows.withColumnRenamed("row_id", "other_id"), rows, 5, block=1).count() == 9
    big = frame(spark, clusters(5, (30, 30)), "row_id").withColumn("label", (F.col("row_id") >= 30).cast("int")).withColumnRenamed("x", "features")
    for block in (2048, 5):
        assert D.accuracy(D.knn_predict(big, big, 5, block)).first()["accuracy"] == 1.0


def test_two_nn_of_a_plane(spark):
    """Points of a plane in ten dimensions, whatever the blocks."""
    r = np.random.default_rng(6)
    x = r.standard_normal((600, 3)) @ np.linalg.qr(r.standard_normal((10, 10)))[0][:3]
    df = spark.createDataFrame([("p", "a", i, v.tolist()) for i, v in enumerate(x)], "probe string, pool_id string, row_id bigint, features array<double>")
    one, many = (SP.two_nn(df, block=b).first() for b in (2048, 64))
    assert one["n"] == many["n"] == 600 and np.isclose(one["uid"], many["uid"]) and 1.2 < one["uid"] < 3.5


def test_norm_is_computed_once(spark):
    """A norm inside the lambda is computed for each element, nested ones for each of those."""
    df = spark.range(1).select(V.unit(V.unit(F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda v: v.cast("double")))).alias("x")).select(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v).alias("s"))
    since = time.time()
    assert abs(df.first()["s"] - 1) < 1e-9 and time.time() - since < 15
    assert spark.range(1).select(V.unit(F.lit(None).cast("array<double>")).alias("x")).first()["x"] is None


def test_blocks_grow_with_the_table():
    """Twice the rows, as many blocks; a block's bytes end that."""
    assert N.block_rows(2048, 64) == 2048
    assert {-(-n // N.block_rows(n, 64)) for n in (20_000, 40_000, 80_000, 160_000)} == {N.PARTS}
    assert N.block_rows(10**9, 64) * 64 * 8 <= N.BLOCK_BYTES


@pytest.mark.parametrize("cells, picks, width", [(1 << 20, 1 << 16, 64), (700, 11, 4)])
@pytest.mark.parametrize("same", [False, True])
def test_k_nearest_of_copies(monkeypatch, cells, picks, width, same):
    """Many equal rows, ids out of order, and few distances at a time."""
    for name, value in (("CELLS", cells), ("PICKS", picks), ("WIDTH", width)):
        monkeypatch.setattr(N, name, value)
    r = np.random.default_rng(7)
    x = np.concatenate((np.repeat(r.standard_normal((3, 4)), 60, 0), r.standard_normal((90, 4)), np.zeros((9, 4)), -np.zeros((9, 4))))
    ids = r.permutation(len(x))
    q, own = (x, ids) if same else (x[::5] + 0.001, np.arange(1000, 1000 + len(x[::5])))
    for k in (1, 3, 20):
        pick, col, d = N.k_nearest(q, own, x, ids, k, same, N.gap)
        want = set()
        for i, v in enumerate(q):
            far = np.round(np.sqrt(((x - v) ** 2).sum(1)), 9)
            want |= {(i, j) for _, _, j in sorted((far[j], ids[j], j) for j in range(len(x)) if not (same and own[i] == ids[j]))[:k]}
        assert set(zip(pick.tolist(), col.tolist(), strict=True)) == want and len(d) == len(want)


def test_one_search_serves_smaller_k_and_other_classes(spark):
    r = np.random.default_rng(8)
    x = np.round(r.standard_normal((80, 3)))
    df = spark.createDataFrame([(i, int(i % 2), int(i % 3), v.tolist()) for i, v in enumerate(x)], "row_id bigint, a int, b int, features array<double>").persist()
    train, test = df.filter("row_id >= 20"), df.filter("row_id < 20")
    near = D.train_neighbours(train, test, 9, labels=("a", "b")).persist()
    for label in ("a", "b"):
        for k, few in ((4, D.nearer(near, 4)), (9, near)):
            want = D.knn_predict(train.withColumn("label", F.col(label)), test.withColumn("label", F.col(label)), k).collect()
            assert sorted(D.knn_vote(few, test, label).collect()) == sorted(want)
    near.unpersist()
    df.unpersist()
