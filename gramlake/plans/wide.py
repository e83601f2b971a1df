"""Queries at full width: all 64 dimensions, which the narrow ones fold to two so that SQL can solve for
eigenvalues. Entries, centroids and distances have SQL here too."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramlake.functions import vectors as V
from gramlake.operators import gram as G
from gramlake.operators import pairs as P
from gramlake.operators import select as S
from gramlake.operators import spectral as SP
from gramlake.plans.fixtures import domains, pools, summaries
from gramlake.plans.registry import query
from gramlake.plans.unary import R

_ROWS = """r AS (SELECT 'p' || label AS pool, vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
n AS (SELECT pool, vec_id, v, greatest(sqrt(list_sum([x * x FOR x IN v])), 1e-10) AS len FROM r),
p AS (SELECT pool, vec_id, unnest([x / len FOR x IN v]) AS x, unnest(range(64)) AS i FROM n)"""
_GRAM = f"{_ROWS}, g AS (SELECT p.pool, p.i, q.i AS j, sum(p.x * q.x) AS g FROM p JOIN p q ON p.vec_id = q.vec_id GROUP BY ALL)"
_CENTROIDS = f"""{_ROWS}, m AS (SELECT pool, i, avg(x) AS x FROM p GROUP BY ALL), l AS (SELECT pool, sqrt(sum(x * x)) AS len FROM m GROUP BY 1),
c AS (SELECT pool, list(x / len ORDER BY i) AS c FROM m JOIN l USING (pool) GROUP BY 1)"""


@query("gram_entries_d64", f"WITH {_GRAM} SELECT pool AS pool_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(g, 6) AS g FROM g")
def gram_entries_d64(spark, sf):
    return G.gram_entries(G.pool_grams(pools(spark, sf))).select("pool_id", "i", "j", R("g"))


@query("merged_gram_d64", f"WITH {_GRAM} SELECT a.pool AS ds_a, b.pool AS ds_b, CAST(a.i AS INTEGER) AS i, CAST(a.j AS INTEGER) AS j, round(a.g + b.g, 6) AS g FROM g a JOIN g b ON a.pool < b.pool AND a.i = b.i AND a.j = b.j")
def merged_gram_d64(spark, sf):
    p = P.pool_pairs(G.pool_grams(pools(spark, sf))).withColumn("g", G.add_columns("gram_a", "gram_b"))
    long = p.select(F.col("pool_id_a").alias("ds_a"), F.col("pool_id_b").alias("ds_b"), F.col("d_a").alias("d"), F.posexplode("g").alias("at", "g"))
    return long.select("ds_a", "ds_b", F.floor(F.col("at") / F.col("d")).cast("int").alias("i"), (F.col("at") % F.col("d")).cast("int").alias("j"), R("g"))


@query("row_centroids_d64", f"WITH {_CENTROIDS} SELECT pool AS pool_id, CAST(unnest(range(64)) AS INTEGER) AS i, round(unnest(c), 6) AS c FROM c")
def row_centroids_d64(spark, sf):
    return G.pool_grams(pools(spark, sf)).select("pool_id", F.posexplode(G.centroid()).alias("i", "c")).select("pool_id", "i", R("c"))


@query("meansq_profile_d64", f"WITH {_ROWS} SELECT pool AS pool_id, CAST(i AS INTEGER) AS i, round(avg(x * x), 6) AS p FROM p GROUP BY ALL")
def meansq_profile_d64(spark, sf):
    return G.mean_squares(G.pool_grams(pools(spark, sf))).select("pool_id", F.posexplode("profile").alias("i", "p")).select("pool_id", "i", R("p"))


@query("centroid_distances_d64", f"WITH {_CENTROIDS} SELECT a.pool AS ds_a, b.pool AS ds_b, round(list_distance(a.c, b.c), 6) AS d FROM c a JOIN c b ON a.pool < b.pool")
def centroid_distances_d64(spark, sf):
    c = G.pool_grams(pools(spark, sf)).select("probe", "pool_id", G.centroid().alias("c"))
    return P.pool_pairs(c).select(F.col("pool_id_a").alias("ds_a"), F.col("pool_id_b").alias("ds_b"), R("d", V.distance("c_a", "c_b")))


@query("centroid_ff_k3_d64", f"""WITH {_CENTROIDS}, w AS (SELECT i, avg(x) AS x FROM (SELECT unnest(c) AS x, unnest(range(64)) AS i FROM c) GROUP BY i),
o AS (SELECT list(x / len ORDER BY i) AS m FROM w, (SELECT sqrt(sum(x * x)) AS len FROM w) z),
a AS (SELECT c.* FROM c, o ORDER BY round(list_distance(c.c, o.m), 9) DESC, pool LIMIT 1),
b AS (SELECT c.* FROM c, a WHERE c.pool <> a.pool ORDER BY round(list_distance(c.c, a.c), 9) DESC, c.pool LIMIT 1),
d AS (SELECT c.pool FROM c, a, b WHERE c.pool NOT IN (a.pool, b.pool) ORDER BY round(least(list_distance(c.c, a.c), list_distance(c.c, b.c)), 9) DESC, c.pool LIMIT 1)
SELECT 1 AS round, pool AS pool_id FROM a UNION ALL SELECT 2, pool FROM b UNION ALL SELECT 3, pool FROM d""")
def centroid_ff_k3_d64(spark, sf):
    names = S.farthest_first(G.pool_grams(pools(spark, sf)).select("pool_id", G.centroid().alias("centroid")), 3)
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "round int, pool_id string")


@query("spectral_cdf_d64")
def spectral_cdf_d64(spark, sf):
    return summaries(spark, sf).select("pool_id", F.posexplode(SP.spectral_cdf()).alias("i", "c")).select("pool_id", "i", R("c"))


@query("domain_matrix_d64")
def domain_matrix_d64(spark, sf):
    s = summaries(spark, sf)
    p = P.analyse(s, k=20)
    sa, gd = P.symmetric(p, F.col("sa_k"), 1.0, "sa", s), P.symmetric(p, F.col("grassmann"), 0.0, "gd", s)
    return sa.join(gd, ["probe", "ds_i", "ds_j"]).select("ds_i", "ds_j", R("sa"), R("gd"))


@query("ssr_pairs_d64")
def ssr_pairs_d64(spark, sf):
    uid = SP.two_nn(pools(spark, sf)).select(F.col("pool_id").alias("pool_id_b"), "uid")
    p = P.with_angles(P.pool_pairs(summaries(spark, sf)), 20).withColumn("sa", P.alignment()).join(uid, "pool_id_b")
    return p.select(F.col("pool_id_a").alias("ds_a"), F.col("pool_id_b").alias("ds_b"), R("ssr", P.ssr(F.col("r_eff_b"), F.col("sa"), F.col("uid"), F.lit(3))))


@query("grassmann_loss_d64")
def grassmann_loss_d64(spark, sf):
    return P.grassmann_loss(P.with_angles(P.pool_pairs(summaries(spark, sf)), 20)).select(R("loss"))


@query("grassmann_gradient_d64")
def grassmann_gradient_d64(spark, sf):
    g = P.loss_gradient(P.pool_pairs(summaries(spark, sf)), 20)
    return g.select("pool_id", "d", "k", R("norm", V.norm("gradient")), "gradient")


@query("exhaustive_k2_d64")
def exhaustive_k2_d64(spark, sf):
    return S.exhaustive(G.pool_grams(pools(spark, sf)), 2).select(F.concat_ws(",", "subset").alias("subset"), R("r_eff"))


@query("max_reff_topk_d64")
def max_reff_topk_d64(spark, sf):
    return S.top_pools(summaries(spark, sf), 4).select("pool_id", "round", R("r_eff"))


@query("domain_diverse_d64")
def domain_diverse_d64(spark, sf):
    return S.domain_diverse(summaries(spark, sf), domains(spark, sf), 5).select("round", "pool_id", "domain", R("r_eff"))


@query("retention_d64")
def retention_d64(spark, sf):
    return spark.createDataFrame([(round(S.retention(S.Pools(summaries(spark, sf)), ["p0", "p1", "p2"]), 4),)], "retention_pct double")
