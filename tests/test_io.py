"""Sources, sinks and the runner."""

import numpy as np
from pyspark.sql import functions as F

from gramlake import runner
from gramlake.sources import features as SRC
from gramlake.sources import sinks


def rows(spark):
    data = [("e", p, "train", i, i % 2, [float(i + 1), 2.0]) for p in ("a", "b") for i in range(6)]
    return spark.createDataFrame(data, SRC.SCHEMA)


def test_features_round_trip(spark, tmp_path):
    sinks.write_features(rows(spark), str(tmp_path / "f"))
    f = SRC.load_features(spark, str(tmp_path / "f"), probe="e", pools=["a"], most=4)
    assert f.count() == 4 and {r["pool_id"] for r in f.collect()} == {"a"}
    assert np.allclose([np.linalg.norm(r["features"]) for r in f.collect()], 1)
    assert SRC.discover(spark, str(tmp_path / "f")).count() == 2
    assert SRC.dimension_check(rows(spark)).count() == 0


def test_pruning_reaches_the_scan(spark, tmp_path):
    sinks.write_features(rows(spark), str(tmp_path / "f"))
    plan = SRC.load_features(spark, str(tmp_path / "f"), probe="e", most=None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(probe" in plan


def test_flat_names(spark):
    names = ["feat_rn_cifar_train.npz", "feat_rn_cifar_test.npz", "feat_rn_cifar_wl.npz", "feat_rn_svhn.npz", "other.npz"]
    got = {(r["probe"], r["pool_id"], r["split"]) for r in SRC.parse_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {("rn", "cifar", "train"), ("rn", "cifar", "test"), ("rn", "svhn", "train")}


def test_csv_json_text(spark, tmp_path):
    df = spark.createDataFrame([("x", ["a", "b"], 1.5)], "k string, sel array<string>, v double")
    sinks.write_csv(df, str(tmp_path / "c"))
    back = SRC.read_results(spark, str(tmp_path / "c"), "k string, sel string, v double").first()
    assert back["sel"] == "a|b" and back["v"] == 1.5
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["sel"] == ["a", "b"]
    sinks.write_text(df.select("k", "v"), str(tmp_path / "t"), "%s=%.1f")
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "x=1.5"


def test_cache_first(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert SRC.load_or_compute(spark, str(tmp_path / "x"), compute).count() == 3
    assert len(calls) == 1
    sinks.skip_existing(spark.range(9), str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 3


def test_text_features(spark):
    f = SRC.text_features(spark.createDataFrame([(1, "A b b", "s")], "doc_id bigint, text string, source string"), 16).first()["features"]
    assert sum(f) == 3 and len(f) == 16


def test_runner_codes(spark, sf, tmp_path):
    assert runner.main(["--only", "value_counts", "--data", sf, "--out", str(tmp_path / "o")]) == 0
    assert runner.main(["--only", "no_such_query", "--data", sf]) == 1
    assert runner.main(["--only", "value_counts"]) == 2
    assert runner.main(["--dry-run", "--only", "value_counts"]) == 0
    assert runner.choose(["a", "b", "c"], runner.Config(disabled=["a"], skip=["b"])) == ["c"]


def test_config_file(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("data: /d\nonly: [x]\nother: 1\n")
    assert runner.Config.load(str(p)) == runner.Config(data="/d", only=["x"])


def test_normalise_keeps_zero_rows(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "features array<double>")
    assert SRC.normalise(df).first()["features"] == [0.0, 0.0]
    assert SRC.normalise(df).filter(F.exists("features", lambda x: F.isnan(x))).count() == 0
