"""Ranks, quantiles and resampling without a group in one task, against NumPy."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gramlake.operators import statistics as ST


def table(spark, seed=0, n=3000, groups=3):
    r = np.random.default_rng(seed)
    g = np.where(r.random(n) < 0.6, 0, r.integers(0, groups, n))
    x = np.where(r.random(n) < 0.3, 7.0, np.round(r.standard_normal(n) * 40))
    return pd.DataFrame({"g": [None if k == 2 else f"g{k}" for k in g], "x": x, "y": np.round(x / 3 + r.standard_normal(n) * 9)})


@pytest.mark.parametrize("many", [False, True])
def test_spearman(spark, monkeypatch, many):
    """Ties, a null group, and groups cut into many ranges."""
    if many:
        monkeypatch.setattr(ST, "RANGE", 5)
        monkeypatch.setattr(ST, "RANGES", 16)
    pdf = table(spark)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.rand(1) > 0.01, F.col("x"))).persist()
    known = df.toPandas().dropna(subset=["x"])
    got = {r["g"]: (r["n"], r["rho"]) for r in ST.spearman(df, "x", "y", ("g",)).collect()}
    for g, part in known.groupby(known["g"].fillna("none")):
        want = np.corrcoef(part["x"].rank(), part["y"].rank())[0, 1]
        n, rho = got[None if g == "none" else g]
        assert n == len(part) and abs(rho - want) < 1e-9
    (whole,) = ST.spearman(df, "x", "y").collect()
    assert whole["n"] == len(known) and abs(whole["rho"] - np.corrcoef(known["x"].rank(), known["y"].rank())[0, 1]) < 1e-9
    (none,) = ST.spearman(df.filter("false"), "x", "y").collect()
    assert none["n"] == 0 and none["rho"] is None
    assert ST.spearman(df.withColumn("x", F.lit(1.0)), "x", "y").first()["rho"] is None
    df.unpersist()


def test_spearman_of_many_rows(spark):
    """n cubed is beyond a long: 2 * 3,000,000 rows of four pairs of values, against the same ranks in NumPy."""
    share = {(0, 0): 1_900_000, (0, 1): 1_100_000, (1, 0): 400_000, (1, 1): 2_600_000}
    counts = spark.createDataFrame([(x, y, c) for (x, y), c in share.items()], "x int, y int, c int")
    df = counts.select("x", "y", F.explode(F.sequence(F.lit(1), F.col("c")))).select("x", "y")
    n, ones_x, ones_y = 6_000_000, 3_000_000, 3_700_000
    want = (2_600_000 / n - ones_x * ones_y / n**2) / np.sqrt(ones_x * (n - ones_x) * ones_y * (n - ones_y) / n**4)
    (got,) = ST.spearman(df, "x", "y").collect()
    assert got["n"] == n and abs(got["rho"] - want) < 1e-12


def test_no_window_over_a_group(spark):
    """Orders are within ranges; a group's own window is over its ranges, RANGES at most."""
    plan = ST.spearman(spark.createDataFrame(table(spark)), "x", "y", ("g",))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and all("__range" in line for line in windows)
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("ordered, bins", [(10_000, 1024), (5, 4)])
def test_quantiles(spark, monkeypatch, ordered, bins):
    monkeypatch.setattr(ST, "ORDERED", ordered)
    monkeypatch.setattr(ST, "BINS", bins)
    r = np.random.default_rng(3)
    pdf = pd.concat([table(spark, 4, 400), pd.DataFrame({"g": "one", "x": [5.0], "y": [0.0]}), pd.DataFrame({"g": "wide", "x": np.concatenate((r.standard_normal(60), [1e300, -1e300, 1e-300])), "y": 0.0})])
    df = spark.createDataFrame(pdf).repartition(3)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in ST.quantiles(df, "x", shares, ("g",)).collect()}
    for g, part in pdf.groupby(pdf["g"].fillna("none")):
        row = got[None if g == "none" else g]
        assert row["n"] == len(part) and np.allclose([row[f"q{i}"] for i in range(5)], np.quantile(part["x"], shares), rtol=1e-12)
    (whole,) = ST.quantiles(df, "x", [0.5]).collect()
    assert whole["q0"] == np.median(pdf["x"])
    assert ST.quantiles(df.filter("false"), "x", [0.5], ("g",)).count() == 0
    assert "percentile(" not in ST.medians(df, "x", ("g",))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("moment_bytes, picks", [(64 << 20, 1 << 20), (8 * 7 * 9, 50)])
def test_bootstrap(spark, monkeypatch, moment_bytes, picks):
    """Draws against indexing row by row; moments in one part and in several."""
    monkeypatch.setattr(ST, "MOMENT_BYTES", moment_bytes)
    monkeypatch.setattr(ST, "PICKS", picks)
    r = np.random.default_rng(6)
    x, y = r.standard_normal(31), r.standard_normal(31)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(99, None, 1.0)], "k int, x double, y double").repartition(3)
    stats = {"r": ST.pearson_statistic("x", "y"), "mean": ST.mean_statistic("x"), "rmse": ST.error_statistic("x", "y")}
    got = {q["metric"]: q for q in ST.bootstrap(df, "k", stats, 200, 7, 90.0).collect()}
    picked = np.array([[int(hashlib.md5(f"7:{b}:{j}".encode()).hexdigest()[:8], 16) % 31 for j in range(31)] for b in range(200)])
    plain = {"r": lambda a, b: np.corrcoef(a, b)[0, 1], "mean": lambda a, b: a.mean(), "rmse": lambda a, b: np.sqrt(np.mean((a - b) ** 2))}
    for name, fn in plain.items():
        values = [fn(x[p], y[p]) for p in picked]
        want = (fn(x, y), np.quantile(values, 0.05), np.quantile(values, 0.95), np.std(values))
        assert np.allclose([got[name][c] for c in ("point", "ci_lo", "ci_hi", "se")], want)
    assert ST.bootstrap(df.filter("false"), "k", stats, 10).count() == 0


def test_p_values_of_evaluators(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal(40)
    df = spark.createDataFrame([("a", float(v), float(v + r.standard_normal()), float(r.standard_normal())) for v in x], "dataset string, lp double, knn double, r_eff double")
    got = {(q["scope"], q["x"], q["y"]): q for q in ST.evaluator_correlations(df, ["lp", "knn", "r_eff"]).collect()}
    assert all(abs(q["p_r"] - ST.correlation_p(q["r"], q["n"])) < 1e-12 and abs(q["p_rho"] - ST.correlation_p(q["rho"], q["n"])) < 1e-12 for q in got.values())
    assert got["a", "lp", "knn"]["p_r"] < 1e-3 and len(got) == 6
