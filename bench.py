"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Each reference experiment's core, at full width, and the widest statistics.
HEADLINE = [
    "pair_analysis_d64", "multiscale_sa", "uid_twonn", "merge_greedy", "vendi_greedy", "hybrid_cen_col", "strategy_grid", "exhaustive_k2_d2", "knn5_accuracy",
    "linear_probe", "fair_lp", "transfer_bundle", "synthetic_grid", "bootstrap_ci", "spearman_by_group", "parc_pairs", "cka_pairs", "gram_entries_d8", "text_features", "stream_gram_d2",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from gramlake.plans import QUERIES

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["pair_analysis_d64"](spark, sf).collect()  # warm-up
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total wall-clock of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
