"""Queries over result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramlake.functions import closed_form as CF
from gramlake.operators import downstream as D
from gramlake.operators import pairs as P
from gramlake.operators import statistics as ST
from gramlake.plans.fixtures import sql_pairs, sql_pools, sql_predict, summaries, table
from gramlake.plans.registry import query
from gramlake.plans.unary import R

#: A result table of 25 rows: order values by nation, read as truth and prediction.
_NATION = """nat AS (SELECT n_nationkey AS nation, n_regionkey AS region, avg(o_totalprice) AS truth, median(o_totalprice) * 1.1 AS pred, avg(c_acctbal) AS bal, CAST(count(*) AS DOUBLE) AS n
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def nations(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")).agg(F.avg("o_totalprice").alias("truth"), (F.median("o_totalprice") * 1.1).alias("pred"), F.avg("c_acctbal").alias("bal"), F.count("*").cast("double").alias("n"))


@query("calibration_constant", f"WITH {_NATION} SELECT region, round(exp(-avg(ln(pred / truth))), 6) AS c FROM nat GROUP BY region")
def calibration_constant(spark, sf):
    return nations(spark, sf).groupBy("region").agg(F.round(CF.calibration("pred", "truth"), 6).alias("c"))


@query("calibrated_rows", f"WITH {_NATION}, c AS (SELECT region, exp(-avg(ln(pred / truth))) AS c FROM nat GROUP BY region) SELECT nation, round(c * pred, 4) AS r_cal FROM nat JOIN c USING (region)")
def calibrated_rows(spark, sf):
    return ST.calibrated(nations(spark, sf), "pred", "truth", "region").select("nation", F.round("r_cal", 4).alias("r_cal"))


@query("probe_constant_lookup", "SELECT event_type, round(CASE event_type WHEN 'click' THEN 0.776 WHEN 'view' THEN 0.647 ELSE 1.0 END * avg(value), 6) AS v FROM events GROUP BY event_type")
def probe_constant_lookup(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("v"))
    return e.select("event_type", R("v", CF.probe_constant("event_type", {"click": 0.776, "view": 0.647}) * F.col("v")))


@query("pearson_by_group", "SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def pearson_by_group(spark, sf):
    return ST.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ("l_returnflag",)).select("l_returnflag", "n", R("r"))


@query("spearman_by_group", """WITH k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS y FROM lineitem) SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS rho FROM k GROUP BY 1""")
def spearman_by_group(spark, sf):
    return ST.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_discount", ("l_returnflag",)).select("l_returnflag", "n", R("rho"))


@query("r2_rmse_mae_groups", f"WITH {_NATION} SELECT region, round(1 - sum((truth - pred) * (truth - pred)) / (var_pop(truth) * count(*) + 1e-12), 4) AS r2, round(sqrt(avg((pred - truth) * (pred - truth))), 4) AS rmse, round(avg(abs(pred - truth)), 4) AS mae, round(max(abs(pred - truth)), 4) AS max_err FROM nat GROUP BY region")
def r2_rmse_mae_groups(spark, sf):
    out = ST.grouped(nations(spark, sf), ("region",), [ST.r_squared("truth", "pred").alias("r2"), *ST.errors("truth", "pred")])
    return out.select("region", *(F.round(c, 4).alias(c) for c in ("r2", "rmse", "mae", "max_err")))


@query("boolean_rates", "SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS done FROM orders GROUP BY 1")
def boolean_rates(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(ST.rate(F.col("o_orderstatus") == "F"), 6).alias("done"))


@query("bootstrap_ci", f"""WITH {_NATION}, num AS (SELECT *, row_number() OVER (ORDER BY nation) - 1 AS i FROM nat), m AS (SELECT count(*) AS m FROM nat),
picks AS (SELECT b, CAST('0x' || substr(md5('42:' || b || ':' || j), 1, 8) AS BIGINT) % m AS i FROM (SELECT unnest(range(10000)) AS b), m, (SELECT unnest(range((SELECT m FROM m))) AS j)),
s AS (SELECT b, corr(truth, pred) AS v FROM picks JOIN num USING (i) GROUP BY b)
SELECT 'pearson' AS metric, round((SELECT corr(truth, pred) FROM nat), 6) AS point, round(quantile_cont(v, 0.025), 6) AS ci_lo, round(quantile_cont(v, 0.975), 6) AS ci_hi, round(stddev_pop(v), 6) AS se FROM s""")
def bootstrap_ci(spark, sf):
    return ST.bootstrap(nations(spark, sf), "nation", {"pearson": ST.pearson_statistic("truth", "pred")}).select("metric", R("point"), R("ci_lo"), R("ci_hi"), R("se"))


@query("overlapping_group_summary", "SELECT g AS \"group\", count(*) AS n, round(avg(l_extendedprice), 4) AS v FROM (SELECT *, unnest(list_filter([CASE WHEN true THEN 'all' END, CASE WHEN l_discount > 0.05 THEN 'discounted' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL)) AS g FROM lineitem) GROUP BY 1")
def overlapping_group_summary(spark, sf):
    groups = {"all": F.lit(True), "discounted": F.col("l_discount") > 0.05, "returned": F.col("l_returnflag") == "R"}
    return ST.overlapping_groups(table(spark, sf, "lineitem"), groups, [F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("v")])


@query("pivot_mean_grid", "SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS F, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS O, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS P FROM orders GROUP BY 1")
def pivot_mean_grid(spark, sf):
    g = ST.plot_grid(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O", "P"])
    return g.select("o_orderpriority", *(F.round(c, 4).alias(c) for c in ("F", "O", "P")))


@query("quartile_buckets", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer), b AS (SELECT CASE WHEN c_acctbal <= q1 THEN 'low' WHEN c_acctbal >= q3 THEN 'high' END AS bucket, c_acctbal FROM customer, q) SELECT bucket, count(*) AS n, round(avg(c_acctbal), 4) AS v FROM b WHERE bucket IS NOT NULL GROUP BY 1")
def quartile_buckets(spark, sf):
    return ST.quartile_buckets(table(spark, sf, "customer"), "c_acctbal", [F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("v")])


@query("medians", "SELECT p_brand, round(median(p_retailprice), 6) AS m FROM part GROUP BY 1")
def medians(spark, sf):
    return ST.medians(table(spark, sf, "part"), "p_retailprice", ("p_brand",)).select("p_brand", F.round("median", 6).alias("m"))


@query("value_counts", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def value_counts(spark, sf):
    return ST.value_counts(table(spark, sf, "customer"), "c_mktsegment")


@query("channel_independence", f"""WITH {_NATION}, k AS (SELECT rank() OVER (ORDER BY truth) AS t, rank() OVER (ORDER BY pred) AS p, rank() OVER (ORDER BY bal) AS b, truth, pred, bal FROM nat)
SELECT x, y, n, round(rho, 6) AS rho, round(r, 6) AS r FROM (SELECT 'truth' AS x, 'pred' AS y, count(*) AS n, corr(t, p) AS rho, corr(truth, pred) AS r FROM k UNION ALL SELECT 'truth', 'bal', count(*), corr(t, b), corr(truth, bal) FROM k UNION ALL SELECT 'pred', 'bal', count(*), corr(p, b), corr(pred, bal) FROM k)""")
def channel_independence(spark, sf):
    return ST.channel_independence(nations(spark, sf), ["truth", "pred", "bal"]).select("x", "y", "n", R("rho"), R("r"))


@query("correlation_p_values")
def correlation_p_values(spark, sf):
    return ST.channel_independence(nations(spark, sf), ["truth", "pred", "bal"]).select("x", "y", "p_rho", "p_r", "independent")


_PRED = sql_predict("r_a", "r_b", "gamma_c", "sa")


@query("ablation_spearman_d2", f"""WITH {sql_pools()}, {sql_pairs()}, l AS (SELECT r_merged AS y, unnest([{_PRED}, r_a + r_b, greatest(r_a, r_b), 1 - sa, gamma_c]) AS v, unnest(['model', 'sum', 'larger', 'gain', 'gamma']) AS predictor FROM pr),
k AS (SELECT predictor, rank() OVER (PARTITION BY predictor ORDER BY round(v, 9)) + (count(*) OVER (PARTITION BY predictor, round(v, 9)) - 1) / 2.0 AS x, rank() OVER (PARTITION BY predictor ORDER BY round(y, 9)) + (count(*) OVER (PARTITION BY predictor, round(y, 9)) - 1) / 2.0 AS z FROM l)
SELECT 'all' AS "group", predictor, count(*) AS n, round(corr(x, z), 6) AS rho FROM k GROUP BY predictor""")
def ablation_spearman_d2(spark, sf):
    p = P.analyse(summaries(spark, sf, dims=2), k=1)
    p = p.select(F.round("r_merged", 9).alias("y"), F.round("r_pred_library", 9).alias("model"), F.round(F.col("r_a") + F.col("r_b"), 9).alias("sum"), F.round(F.greatest("r_a", "r_b"), 9).alias("larger"), F.round(1 - F.col("sa_k"), 9).alias("gain"), F.round("gamma_c", 9).alias("gamma"))
    return ST.ranking_ablation(p, "y", ["model", "sum", "larger", "gain", "gamma"], {"all": F.lit(True)}).select("group", "predictor", "n", R("rho"))


@query("gain_consistency_d2", f"WITH {sql_pools()}, {sql_pairs()} SELECT count(*) AS n, round(corr(round(sa, 4), round(r_merged - greatest(r_a, r_b), 6)), 4) AS r FROM pr")
def gain_consistency_d2(spark, sf):
    p = P.analyse(summaries(spark, sf, dims=2), k=1).select(F.round("sa_k", 4).alias("x"), F.round("delta_r", 6).alias("y"))
    return ST.pearson(p, "x", "y").select("n", F.round("r", 4).alias("r"))


@query("loo_calibration_d2", f"WITH {sql_pools()}, {sql_pairs()}, l AS (SELECT ds_a, ds_b, ln({_PRED} / r_merged) AS v FROM pr) SELECT ds_a, ds_b, round(exp(-(sum(v) OVER () - v) / (count(*) OVER () - 1)), 6) AS c_loo FROM l")
def loo_calibration_d2(spark, sf):
    return ST.leave_one_out(P.analyse(summaries(spark, sf, dims=2), k=1), "r_pred_library", "r_merged", "probe").select("ds_a", "ds_b", R("c_loo"))


@query("grid_summary_d2", f"WITH {sql_pools()}, {sql_pairs()} SELECT count(*) AS n, round(max(abs({_PRED} - r_merged)), 6) AS max_err, round(avg(CASE WHEN r_merged > greatest(r_a, r_b) THEN 1.0 ELSE 0.0 END), 6) AS superadditive FROM pr")
def grid_summary_d2(spark, sf):
    return ST.grid_summary(P.analyse(summaries(spark, sf, dims=2), k=1), "r_merged", "r_pred_library", "is_superadditive").select("n", R("max_err"), R("superadditive"))


_JOINT = """WITH p AS (SELECT a.n_name AS ds_a, b.n_name AS ds_b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name),
s AS (SELECT n_name AS pool_id, s_acctbal AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) = 1)
SELECT ds_a, ds_b, round(coalesce(y.score, x.score), 6) AS score FROM p LEFT JOIN s x ON x.pool_id = ds_a LEFT JOIN s y ON y.pool_id = ds_b"""


@query("joint_matrix_lookup", _JOINT)
def joint_matrix_lookup(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    a = n.select(F.col("n_name").alias("ds_a"), "n_regionkey")
    pairs = a.join(n.select(F.col("n_name").alias("ds_b"), "n_regionkey"), "n_regionkey").filter("ds_a < ds_b").select("ds_a", "ds_b")
    scores = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("pool_id"), F.col("s_acctbal").alias("score"), F.col("s_suppkey").alias("seq"))
    return ST.joint_lookup(pairs, scores).select("ds_a", "ds_b", R("score"))


@query("joint_matrix_lookup_all", _JOINT)
def joint_matrix_lookup_all(spark, sf):
    return joint_matrix_lookup(spark, sf)


@query("dedup_keep_first", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) = 1")
def dedup_keep_first(spark, sf):
    return ST.keep_first(table(spark, sf, "orders"), ["o_custkey"], ["o_orderpriority", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("claims_passfail", f"WITH {_NATION}, o AS (SELECT 'n' AS metric, CAST(count(*) AS DOUBLE) AS v FROM nat UNION ALL SELECT 'r', corr(truth, pred) FROM nat), x AS (SELECT * FROM (VALUES ('n', 25.0, 0.5), ('r', -2.0, 0.01), ('absent', 1.0, 0.1)) t(metric, expected, tol)) SELECT metric, CAST(expected AS DOUBLE) AS expected, round(v, 6) AS observed, CASE WHEN v IS NULL THEN 'CHECK' WHEN abs(v - expected) < tol THEN 'PASS' ELSE 'FAIL' END AS status FROM x LEFT JOIN o USING (metric)")
def claims_passfail(spark, sf):
    n = nations(spark, sf).agg(F.count("*").cast("double").alias("n"), F.corr("truth", "pred").alias("r")).unpivot([], ["n", "r"], "metric", "value")
    x = spark.createDataFrame([("n", 25.0, 0.5), ("r", -2.0, 0.01), ("absent", 1.0, 0.1)], "metric string, expected double, tol double")
    return ST.verify_claims(n, x).withColumn("observed", F.round("observed", 6))


@query("trend_fit", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, count(*) AS n FROM lineitem GROUP BY 1")
def trend_fit(spark, sf):
    return D.trend(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ("l_returnflag",)).select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query("random_baseline_ci", "SELECT event_type, round(avg(value), 6) AS mean, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS lo, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS hi, count(value) AS n FROM events GROUP BY 1")
def random_baseline_ci(spark, sf):
    return D.random_baseline(table(spark, sf, "events"), "value", ("event_type",)).select("event_type", R("mean"), R("lo"), R("hi"), "n")


@query("predictor_comparison", f"WITH {_NATION}, l AS (SELECT truth, unnest(['pred', 'bal']) AS predictor, unnest([pred, CASE WHEN region = 0 THEN NULL ELSE bal END]) AS v FROM nat) SELECT predictor, count(*) AS n, round(corr(v, truth), 6) AS r FROM l WHERE v IS NOT NULL GROUP BY 1")
def predictor_comparison(spark, sf):
    long = nations(spark, sf).withColumn("bal", F.when(F.col("region") != 0, F.col("bal"))).unpivot(["truth"], ["pred", "bal"], "predictor", "v")
    return ST.pearson(long, "v", "truth", ("predictor",)).select("predictor", "n", R("r"))
