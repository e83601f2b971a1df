"""Queries over pairs of pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramlake.functions import closed_form as CF
from gramlake.functions import vectors as V
from gramlake.operators import gram as G
from gramlake.operators import pairs as P
from gramlake.operators import spectral as SP
from gramlake.plans.fixtures import pools, sql_pairs, sql_pools, sql_predict, sql_rho, sql_share, summaries, table
from gramlake.plans.registry import ORACLES, query
from gramlake.plans.unary import R

_BASE = f"WITH {sql_pools()}, {sql_pairs()}"
_W1 = "abs(s1a / (s1a + s2a) - s1b / (s1b + s2b))"


def angled(spark, sf, k: int = 1, **kw):
    """Pairs with cosines; folded to two dimensions, the leading direction alone."""
    return P.with_angles(P.pool_pairs(summaries(spark, sf, dims=2, **kw)), k)


def _pair(name: str, column: str, sql: str, col):
    @query(f"{name}_d2", f"{_BASE} SELECT ds_a, ds_b, round({sql}, 6) AS {column} FROM pr")
    def run(spark, sf):
        p = angled(spark, sf).withColumn("sa", P.alignment())
        return p.select(F.col("pool_id_a").alias("ds_a"), F.col("pool_id_b").alias("ds_b"), R(column, col()))

    @query(f"{name}_d64")
    def wide(spark, sf):
        """At full width over 20 directions, which SQL can't express."""
        p = P.with_angles(P.pool_pairs(summaries(spark, sf)), 20).withColumn("sa", P.alignment())
        return p.select(F.col("pool_id_a").alias("ds_a"), F.col("pool_id_b").alias("ds_b"), R(column, col()))

    return run


_pair("sa1", "sa_k", "sa", lambda: F.col("sa"))
_pair("grassmann", "distance", "acos(least(1, co))", P.grassmann)
_pair("w1_padded", "w1", _W1, P.spectral_w1)
_pair("stg_truncated", "stg", _W1, P.truncated_w1)
_pair("repr_distance", "d_repr", f"sqrt({_W1} * {_W1} + acos(least(1, co)) * acos(least(1, co)))", lambda: P.representation_distance(P.spectral_w1(), P.grassmann()))
_pair("dual_channel", "d_dual", f"{_W1} + 1 - sa", lambda: P.dual_channel(P.truncated_w1(), F.col("sa")))
_pair("direction_gain", "gain", "1 - sa", lambda: P.direction_gain(F.col("sa")))
_pair("svcca", "svcca", "co", P.svcca)
_pair("pwcca", "pwcca", "s1a * s1a * co / (s1a * s1a + 1e-12)", P.pwcca)
_pair("joint_score", "score", "sqrt(r_a) * sa", lambda: P.joint_score(F.col("r_eff_a"), F.col("sa")))
_pair("energy_alignment", "alpha_e", "s1a * co * co / (s1a + 1e-12)", lambda: CF.energy_weighted_alignment(F.col("sigma_a"), F.transform("cosines", lambda c: c * c)))


@query("grassmann_loss_d2", f"{_BASE} SELECT round(sum(pow(acos(least(1, co)), 2)), 6) AS loss FROM pr")
def grassmann_loss_d2(spark, sf):
    return P.grassmann_loss(angled(spark, sf)).select(R("loss"))


def _closed(name: str, sql: str, columns):
    """A closed form (CF5, CF13-CF16, OR6) over the measured pairs of pools."""

    @query(f"pair_{name}_d2", f"{_BASE} SELECT ds_a, ds_b, {sql} FROM pr")
    def run(spark, sf):
        p = angled(spark, sf).withColumn("sa", P.alignment()).withColumn("gamma", F.col("nuclear_b") / (F.col("nuclear_a") + 1e-8))
        return p.select(F.col("pool_id_a").alias("ds_a"), F.col("pool_id_b").alias("ds_b"), *columns())

    return run


_KAPPA = "greatest(s1a / s2a, s1b / s2b)"
_closed("bounds", "round(least(r_a, r_b), 6) AS lower, round(r_a + r_b, 6) AS upper, round(greatest(r_a, r_b), 6) AS larger", lambda: [R(n, c) for n, c in zip(("lower", "upper", "larger"), CF.bounds("r_eff_a", "r_eff_b"), strict=True)])
_closed("universal_c", "round(0.946 - 0.175 * ln(mn / (r_a + r_b)), 6) AS c", lambda: [R("c", CF.universal_constant(F.col("n_a") + F.col("n_b"), F.col("r_eff_a") + F.col("r_eff_b")))])
_closed(
    "error_bounds", f"round(4 * gamma * gamma / greatest((1 - gamma * gamma) * (1 - gamma * gamma) + 4 * gamma * gamma * sa, 1e-12) * sa * (1 - sa) * ln({_KAPPA}), 5) AS bound_tight, round(ln({_KAPPA}), 6) AS bound_worst",
    lambda: [F.round(CF.error_bounds("gamma", "sa", F.col("sa") * (1 - F.col("sa")), F.greatest("kappa_a", "kappa_b"))[0], 5).alias("bound_tight"), R("bound_worst", CF.error_bounds("gamma", "sa", F.lit(0.0), F.greatest("kappa_a", "kappa_b"))[1])],
)
_closed("transfer_bound", f"round(0.1 + 2 * {_W1} + (1 - sa) + 0.5 * abs(r_a - r_b), 6) AS bound", lambda: [R("bound", CF.transfer_bound(F.lit(0.1), P.spectral_w1(), P.direction_gain(F.col("sa")), F.abs(F.col("r_eff_a") - F.col("r_eff_b")), 2.0, 1.0, 0.5))])
_closed("naive_gain", "round(sqrt(1 + sa * gamma * gamma), 6) AS gain", lambda: [R("gain", CF.naive_gain("gamma", "sa"))])


@query("pair_sql_functions_d2", f"{_BASE} SELECT ds_a, ds_b, round({sql_predict('r_a', 'r_b', 'gamma', 'sa')}, 6) AS lib, round({sql_predict('r_a', 'r_b', 'gamma', 'sa', 'selection')}, 5) AS sel, round(-sa * ln(sa) - (1 - sa) * ln(1 - sa), 6) AS h FROM (SELECT * REPLACE (greatest(1e-10, least(1 - 1e-10, sa)) AS sa) FROM pr)")
def pair_sql_functions_d2(spark, sf):
    """OR6: the predictors as SQL functions, over the measured pairs."""
    CF.register_sql(spark)
    clipped = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), P.alignment()))
    angled(spark, sf).withColumn("sa", clipped).withColumn("gamma", F.col("nuclear_b") / (F.col("nuclear_a") + 1e-8)).createOrReplaceTempView("measured_pairs")
    return spark.sql("SELECT pool_id_a AS ds_a, pool_id_b AS ds_b, round(predict_library(r_eff_a, r_eff_b, gamma, sa), 6) AS lib, round(predict_selection(r_eff_a, r_eff_b, gamma, sa), 5) AS sel, round(binary_entropy(sa), 6) AS h FROM measured_pairs")


_DELTA = "(r_merged - greatest(r_a, r_b))"
_PAIR_SQL = f"""{_BASE} SELECT ds_a, ds_b, round(r_a, 6) AS r_a, round(r_b, 6) AS r_b, round(r_merged, 6) AS r_merged, round(r_a + r_b, 6) AS r_ideal,
  round(greatest(0, (r_a + r_b - r_merged) / (r_a + r_b)), 6) AS collapse_ratio, round(sa, 6) AS sa_k, round(gamma, 6) AS gamma, round(na / (na + nb + 1e-8), 6) AS r_star_energy,
  round({sql_share('gamma_c', 'sa')}, 6) AS r_star, round({sql_predict('r_a', 'r_b', 'gamma_c', 'sa')}, 6) AS r_pred_library, round({sql_predict('r_a', 'r_b', 'gamma_d', 'sa', 'selection')}, 6) AS r_pred_selection,
  CASE WHEN sa > 0.5 AND (gamma > 3 OR gamma < 0.33) THEN 'both' WHEN sa > 0.5 THEN 'direction' WHEN gamma > 3 OR gamma < 0.33 THEN 'energy' WHEN {_DELTA} > 0 THEN 'superadditive' ELSE 'none' END AS dominant_cause,
  CASE WHEN sa < 0.2 AND gamma >= 0.5 AND gamma <= 2 THEN 'superadditive' WHEN sa > 0.5 THEN 'direction_collapse' WHEN gamma > 3 OR gamma < 0.33 THEN 'energy_collapse' ELSE 'transition' END AS expected_regime
FROM pr"""


@query("pair_analysis_d2", _PAIR_SQL)
def pair_analysis_d2(spark, sf):
    p = P.analyse(summaries(spark, sf, dims=2), k=1)
    return p.select("ds_a", "ds_b", *(R(c) for c in ("r_a", "r_b", "r_merged", "r_ideal", "collapse_ratio", "sa_k", "gamma", "r_star_energy", "r_star", "r_pred_library", "r_pred_selection")), "dominant_cause", "expected_regime")


@query("pair_critical_d2", f"{_BASE} SELECT ds_a, ds_b, round(greatest(r_a, r_b) / least(r_a, r_b), 6) AS ratio, round(ln({sql_rho('gamma_c', 'sa')}), 4) AS ln_rho, round({sql_predict('r_a', 'r_b', 'gamma_c', 'sa')} - r_merged, 6) AS pred_error FROM pr WHERE sa < 0.99")
def pair_critical_d2(spark, sf):
    p = P.analyse(summaries(spark, sf, dims=2), k=1).filter("sa_k < 0.99")
    return p.select("ds_a", "ds_b", R("ratio"), F.round(F.log("rho_c"), 4).alias("ln_rho"), R("pred_error"))


@query("pair_e1d_columns_d2", f"{_BASE} SELECT ds_a, ds_b, round(gamma_d, 6) AS gamma_d, round(r_merged - CASE WHEN gamma_d <= 1 THEN r_a ELSE r_b END, 6) AS delta_r_dom, r_merged > CASE WHEN gamma_d <= 1 THEN r_a ELSE r_b END AS is_superadditive_dom, CAST(0 AS DOUBLE) AS v_alpha FROM pr")
def pair_e1d_columns_d2(spark, sf):
    p = P.analyse(summaries(spark, sf, dims=2), k=1)
    return p.select("ds_a", "ds_b", R("gamma_d"), R("delta_r_dom"), "is_superadditive_dom", R("v_alpha"))


@query("domain_matrix_d2", f"{_BASE}, up AS (SELECT ds_a, ds_b, sa, acos(least(1, co)) AS gd FROM pr), m AS (SELECT ds_a AS ds_i, ds_b AS ds_j, sa, gd FROM up UNION ALL SELECT ds_b, ds_a, sa, gd FROM up UNION ALL SELECT pool, pool, 1.0, 0.0 FROM e) SELECT ds_i, ds_j, round(sa, 6) AS sa, round(gd, 6) AS gd FROM m")
def domain_matrix_d2(spark, sf):
    s = summaries(spark, sf, dims=2)
    p = P.analyse(s, k=1)
    sa, gd = P.symmetric(p, F.col("sa_k"), 1.0, "sa", s), P.symmetric(p, F.col("grassmann"), 0.0, "gd", s)
    return sa.join(gd, ["probe", "ds_i", "ds_j"]).select("ds_i", "ds_j", R("sa"), R("gd"))


@query("merged_gram_d2", f"WITH {sql_pools()} SELECT x.pool AS ds_a, y.pool AS ds_b, x.n + y.n AS n, round(x.a + y.a, 6) AS g11, round(x.b + y.b, 6) AS g12, round(x.c + y.c, 6) AS g22 FROM g x JOIN g y ON x.pool < y.pool")
def merged_gram_d2(spark, sf):
    p = P.pool_pairs(G.pool_grams(pools(spark, sf, dims=2)))
    p = p.withColumn("g", G.add_columns("gram_a", "gram_b"))
    return p.select(F.col("pool_id_a").alias("ds_a"), F.col("pool_id_b").alias("ds_b"), (F.col("n_a") + F.col("n_b")).alias("n"), *(R(f"g{c}", F.element_at("g", i)) for c, i in (("11", 1), ("12", 2), ("22", 4))))


@query("parc_pairs", """
WITH r AS (SELECT 'p' || label AS p, vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
n AS (SELECT p, greatest(sqrt(list_sum([x * x FOR x IN v])), 1e-10) AS len, unnest(v) AS x, unnest(range(64)) AS i FROM r),
m AS (SELECT p, i, avg(x / len * x / len) AS v FROM n GROUP BY ALL)
SELECT a.p AS ds_a, b.p AS ds_b, round(corr(a.v, b.v), 6) AS parc FROM m a JOIN m b ON a.i = b.i AND a.p < b.p GROUP BY ALL""")
def parc_pairs(spark, sf):
    return P.parc(G.mean_squares(G.pool_grams(pools(spark, sf)))).select("ds_a", "ds_b", R("parc"))


@query("cka_pairs", """
WITH r AS (SELECT 'p' || label AS p, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
n AS (SELECT p, pos, [x / greatest(sqrt(list_sum([y * y FOR y IN v])), 1e-10) FOR x IN v] AS v FROM r),
q AS (SELECT p, count(*) AS n FROM n GROUP BY p), w AS (SELECT a.p AS ds_a, b.p AS ds_b, least(a.n, b.n) AS m FROM q a JOIN q b ON a.p < b.p),
k AS (SELECT x.p, x.pos AS i, y.pos AS j, list_dot_product(x.v, y.v) AS k FROM n x JOIN n y ON x.p = y.p),
c AS (SELECT p, m, i, j, k - avg(k) OVER (PARTITION BY p, m, i) - avg(k) OVER (PARTITION BY p, m, j) + avg(k) OVER (PARTITION BY p, m) AS k FROM k JOIN (SELECT DISTINCT unnest([ds_a, ds_b]) AS p, unnest([m, m]) AS m FROM w) z USING (p) WHERE i <= m AND j <= m),
h AS (SELECT p, m, sum(k * k) AS h FROM c GROUP BY ALL),
x AS (SELECT ds_a, ds_b, w.m, sum(a.k * b.k) AS h FROM w JOIN c a ON a.p = ds_a AND a.m = w.m JOIN c b ON b.p = ds_b AND b.m = w.m AND b.i = a.i AND b.j = a.j GROUP BY ALL)
SELECT ds_a, ds_b, round(x.h / (sqrt(a.h * b.h) + 1e-12), 6) AS cka FROM x JOIN h a ON a.p = ds_a AND a.m = x.m JOIN h b ON b.p = ds_b AND b.m = x.m""")
def cka_pairs(spark, sf):
    """All rows up to each pair's smaller pool, at full width."""
    return P.linear_cka(pools(spark, sf)).select("ds_a", "ds_b", R("cka"))


@query("centroid_distances", f"WITH {sql_pools()}, c AS (SELECT pool, sx / sqrt(sx * sx + sy * sy) AS x, sy / sqrt(sx * sx + sy * sy) AS y FROM g) SELECT a.pool AS ds_a, b.pool AS ds_b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS d FROM c a JOIN c b ON a.pool < b.pool")
def centroid_distances(spark, sf):
    c = G.pool_grams(pools(spark, sf, dims=2)).select("probe", "pool_id", G.centroid().alias("c"))
    return P.pool_pairs(c).select(F.col("pool_id_a").alias("ds_a"), F.col("pool_id_b").alias("ds_b"), R("d", V.distance("c_a", "c_b")))


_UID = ORACLES["uid_twonn"].replace("round(1 / (ln(2)", "1 / (ln(2)").replace("END)), 6) AS uid", "END)) AS uid")


@query("ssr_pairs_d2", f"{_BASE}, uq AS ({_UID}) SELECT ds_a, ds_b, CASE WHEN uid >= 1e-6 AND sa >= 1e-6 THEN round(r_b / (sa * uid * ln(3)), 4) END AS ssr FROM pr JOIN uq ON uq.pool_id = ds_b")
def ssr_pairs_d2(spark, sf):
    uid = SP.two_nn(pools(spark, sf)).select(F.col("pool_id").alias("pool_id_b"), "uid")
    p = angled(spark, sf).withColumn("sa", P.alignment()).join(uid, "pool_id_b")
    return p.select(F.col("pool_id_a").alias("ds_a"), F.col("pool_id_b").alias("ds_b"), F.round(P.ssr(F.col("r_eff_b"), F.col("sa"), F.col("uid"), F.lit(3)), 4).alias("ssr"))


@query("pair_analysis_d64")
def pair_analysis_d64(spark, sf):
    """The flagship: every pair of pools at full width, measured and predicted."""
    return P.analyse(summaries(spark, sf), k=20)


@query("multiscale_sa")
def multiscale_sa(spark, sf):
    return P.multiscale(P.pool_pairs(summaries(spark, sf, k=50)))


@query("karcher_mean")
def karcher_mean(spark, sf):
    return P.karcher_mean(summaries(spark, sf, k=10))


@query("cross_probe_d2", f"""WITH {sql_pools()}, {sql_pairs()}, a AS (SELECT ds_a, ds_b, sa FROM pr),
b AS (WITH {sql_pools(True)}, {sql_pairs()} SELECT ds_a, ds_b, sa FROM pr)
SELECT count(*) AS n, round(corr(a.sa, b.sa), 6) AS r FROM a JOIN b USING (ds_a, ds_b)""")
def cross_probe_d2(spark, sf):
    from gramlake.operators import statistics as ST

    one = [P.symmetric(P.analyse(s, k=1), F.col("sa_k"), 1.0, "sa", s) for s in (summaries(spark, sf, dims=2), summaries(spark, sf, dims=2, strides=True))]
    return ST.matrix_consistency(*one, "sa").select("n", R("r"))


@query("numeric_pools", """
WITH r AS (SELECT l_returnflag || l_linestatus AS pool, l_quantity AS q, l_extendedprice AS p, l_discount AS d, greatest(sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_discount * l_discount), 1e-10) AS len FROM lineitem)
SELECT pool AS pool_id, count(*) AS n, round(sum(q / len * q / len), 6) AS g11, round(sum(q / len * p / len), 6) AS g12, round(sum(p / len * p / len), 4) AS g22 FROM r GROUP BY pool""")
def numeric_pools(spark, sf):
    from gramlake.sources.features import normalise

    li = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("pool_id"), F.array("l_quantity", "l_extendedprice", "l_discount").alias("features"))
    g = G.pool_grams(normalise(li), ["pool_id"])
    return g.select("pool_id", "n", R("g11", F.element_at("gram", 1)), R("g12", F.element_at("gram", 2)), F.round(F.element_at("gram", 5), 4).alias("g22"))
