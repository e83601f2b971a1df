"""Queries over sources, closed forms and single pools."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gramlake.functions import closed_form as CF
from gramlake.functions import vectors as V
from gramlake.operators import gram as G
from gramlake.operators import select as S
from gramlake.operators import spectral as SP
from gramlake.plans.fixtures import domains, pools, split_hash, sql_folded, sql_pools, sql_predict, sql_rank, sql_rho, sql_share, summaries, table
from gramlake.plans.registry import query
from gramlake.sources import features as SRC


def R(name, col=None):
    """Rounded to six places under a name."""
    return F.round(F.col(name) if col is None else col, 6).alias(name)


@query("l2_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
def l2_norms(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", R("norm", V.norm(F.transform("embedding", lambda x: x.cast("double")))))


@query("deterministic_sample", "SELECT pool_id, row_id FROM (SELECT 'p' || label AS pool_id, vec_id AS row_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS rn FROM embeddings) WHERE rn <= 20")
def deterministic_sample(spark, sf):
    return SRC.cap(pools(spark, sf, dims=2), 20).select("pool_id", "row_id")


@query("pool_catalog", "SELECT 'emb' AS probe, string_agg(p, ',' ORDER BY p) AS pools FROM (SELECT DISTINCT 'p' || label AS p FROM embeddings)")
def pool_catalog(spark, sf):
    return SRC.catalog(pools(spark, sf, dims=2)).select("probe", F.concat_ws(",", "pools").alias("pools"))


@query("pool_splits", "SELECT 'p' || label AS pool_id, CASE WHEN substr(md5(CAST(vec_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM embeddings GROUP BY ALL")
def pool_splits(spark, sf):
    return pools(spark, sf, dims=2).groupBy("pool_id", "split").agg(F.count("*").alias("n"))


@query("class_remap", "SELECT p_partkey, p_brand, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS INTEGER) AS label FROM part")
def class_remap(spark, sf):
    return SRC.remap_classes(table(spark, sf, "part"), "p_brand", "p_type").select("p_partkey", "p_brand", "label")


_WORDS = r"""w AS (SELECT doc_id, source, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda t: t <> '')) AS t FROM documents),
b AS (SELECT doc_id, source, CAST(('0x' || substr(md5(t), 1, 2)) AS INTEGER) % 16 AS b, count(*) AS c FROM w GROUP BY ALL)"""


@query("text_features", f"WITH {_WORDS} SELECT source AS pool_id, doc_id AS row_id, b AS bucket, CAST(c AS DOUBLE) AS n FROM b")
def text_features(spark, sf):
    f = SRC.text_features(table(spark, sf, "documents"), 16)
    return f.select("pool_id", "row_id", F.posexplode("features").alias("bucket", "n")).filter("n > 0")


@query("gram_entries_d8", f"""
WITH r AS (SELECT 'p' || label AS pool_id, vec_id, [{', '.join(sql_folded(j, 8) for j in range(8))}] AS v FROM embeddings),
n AS (SELECT pool_id, vec_id, v, greatest(sqrt(list_sum([x * x FOR x IN v])), 1e-10) AS len FROM r),
p AS (SELECT pool_id, vec_id, len, unnest(v) AS x, unnest(range(8)) AS i FROM n)
SELECT p.pool_id, CAST(p.i AS INTEGER) AS i, CAST(q.i AS INTEGER) AS j, round(sum(p.x / p.len * q.x / q.len), 6) AS g FROM p JOIN p q ON p.vec_id = q.vec_id GROUP BY ALL""")
def gram_entries_d8(spark, sf):
    return G.gram_entries(G.pool_grams(pools(spark, sf, dims=8))).select("pool_id", "i", "j", R("g"))


@query("row_centroids", f"WITH {sql_pools()} SELECT pool AS pool_id, round(sx / greatest(sqrt(sx * sx + sy * sy), 1e-10 * n), 6) AS cx, round(sy / greatest(sqrt(sx * sx + sy * sy), 1e-10 * n), 6) AS cy FROM g")
def row_centroids(spark, sf):
    c = G.pool_grams(pools(spark, sf, dims=2)).select("pool_id", G.centroid().alias("c"))
    return c.select("pool_id", R("cx", F.element_at("c", 1)), R("cy", F.element_at("c", 2)))


@query("meansq_profile", f"WITH {sql_pools()} SELECT pool AS pool_id, round(a / n, 6) AS px, round(c / n, 6) AS py FROM g")
def meansq_profile(spark, sf):
    m = G.mean_squares(G.pool_grams(pools(spark, sf, dims=2)))
    return m.select("pool_id", R("px", F.element_at("profile", 1)), R("py", F.element_at("profile", 2)))


@query("uid_twonn", """
WITH r AS (SELECT 'p' || label AS pool_id, vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
m AS (SELECT pool_id, vec_id, v, sqrt(list_sum([x * x FOR x IN v])) AS len FROM r),
d AS (SELECT a.pool_id, a.vec_id, sqrt(greatest(0, 2 - 2 * greatest(-1, least(1, list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)]) / (a.len * b.len))))) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(greatest(0, 2 - 2 * greatest(-1, least(1, list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)]) / (a.len * b.len))))), b.vec_id) AS rn FROM m a JOIN m b ON a.pool_id = b.pool_id AND a.vec_id <> b.vec_id),
t AS (SELECT pool_id, vec_id, min(d) AS m1, max(d) AS m2 FROM d WHERE rn <= 2 GROUP BY ALL)
SELECT pool_id, CAST(count(*) AS BIGINT) AS n, round(1 / (ln(2) * avg(CASE WHEN m1 > 1e-10 AND m2 > 1e-10 THEN ln(m2 / m1) END)), 6) AS uid FROM t GROUP BY pool_id""")
def uid_twonn(spark, sf):
    return SP.two_nn(pools(spark, sf)).select("pool_id", "n", R("uid"))


def _unary(name: str, column: str, sql: str):
    @query(f"{name}_d2", f"WITH {sql_pools()} SELECT pool AS pool_id, round({sql}, 6) AS {column} FROM e")
    def run(spark, sf):
        return summaries(spark, sf, dims=2).select("pool_id", R(column))

    @query(f"{name}_d64")
    def wide(spark, sf):
        """At full width, which SQL can't express."""
        if name == "reff_sigma":
            return SP.sigma_ranks(pools(spark, sf)).select("pool_id", R(column))
        return summaries(spark, sf).select("pool_id", R(column))

    return run


_unary("reff", "r_eff", "r_eff")
_unary("nuclear", "nuclear", "nuclear")
_unary("vendi", "vendi", "vendi")
_unary("reff_sigma", "r_eff_sigma", sql_rank("s1", "s2"))
_unary("reff_normalised", "r_norm", "r_eff / least(n, 2)")
_unary("condition", "kappa", "s1 / s2")


@query("reff_sides_d64")
def reff_sides_d64(spark, sf):
    """SP2 of small pools (a pool for each tenth id and label) and of the labels' pools, each from its smaller side."""
    some = pools(spark, sf, probe="tenths", pool=F.concat(F.lit("t"), F.floor(F.col("vec_id") / 10).cast("string")))
    found = SP.side_ranks(pools(spark, sf).unionByName(some))
    return found.select("probe", "pool_id", "side", "n", R("r_eff"), R("vendi"))


@query("spectral_cdf_d2", f"WITH {sql_pools()} SELECT pool AS pool_id, round(s1 / (s1 + s2), 6) AS c1, round(1.0, 6) AS c2 FROM e")
def spectral_cdf_d2(spark, sf):
    c = summaries(spark, sf, dims=2).select("pool_id", SP.spectral_cdf().alias("c"))
    return c.select("pool_id", R("c1", F.element_at("c", 1)), R("c2", F.element_at("c", 2)))


@query("spectral_invariants_d64", """
WITH r AS (SELECT 'p' || label AS pool_id, vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
n AS (SELECT pool_id, vec_id, v, greatest(sqrt(list_sum([x * x FOR x IN v])), 1e-10) AS len FROM r),
t AS (SELECT a.pool_id, sum(pow(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)]) / (a.len * b.len), 2)) AS frob FROM n a JOIN n b ON a.pool_id = b.pool_id GROUP BY 1)
SELECT t.pool_id, round(c.trace, 6) AS trace, round(t.frob, 6) AS frob FROM t JOIN (SELECT pool_id, sum(list_sum([x * x FOR x IN v]) / (len * len)) AS trace FROM n GROUP BY 1) c USING (pool_id)""")
def spectral_invariants_d64(spark, sf):
    sq = F.transform("sigma", lambda x: x * x)
    return summaries(spark, sf).select("pool_id", R("trace", V.total(sq)), R("frob", V.total(F.transform(sq, lambda x: x * x))))


# ---- closed forms over line items ---------------------------------------------------------------

#: A row's discount, quantity, number and tax as alignment (0 to 1), ratio of energies (0.1 to 5) and two ranks.
_GRID_SQL = """grid AS (SELECT DISTINCT round(CAST(l_discount AS DOUBLE) * 10, 2) AS alpha, round(CAST(l_quantity AS DOUBLE) / 10, 2) AS gamma,
  CAST(10 * l_linenumber AS DOUBLE) AS r_a, round(5 + 500 * CAST(l_tax AS DOUBLE), 2) AS r_b FROM lineitem)"""


def _grid(spark, sf):
    li = table(spark, sf, "lineitem")
    one = [F.round(F.col("l_discount").cast("double") * 10, 2).alias("alpha"), F.round(F.col("l_quantity").cast("double") / 10, 2).alias("gamma")]
    return li.select(*one, (F.col("l_linenumber") * 10).cast("double").alias("r_a"), F.round(5 + 500 * F.col("l_tax").cast("double"), 2).alias("r_b")).distinct()


def _grid_query(name: str, column: str, sql: str, col):
    @query(name, f"WITH {_GRID_SQL} SELECT alpha, gamma, r_a, r_b, {sql} AS {column} FROM grid")
    def run(spark, sf):
        return _grid(spark, sf).select("alpha", "gamma", "r_a", "r_b", col().alias(column))

    return run


_grid_query("predict_L_grid", "r_pred", f"round({sql_predict('r_a', 'r_b', 'gamma', 'alpha')}, 6)", lambda: F.round(CF.merged_rank("r_a", "r_b", "gamma", "alpha", CF.LIBRARY), 6))
_grid_query("predict_S_grid", "r_pred", f"round({sql_predict('r_a', 'r_b', 'gamma', 'alpha', 'selection')}, 5)", lambda: F.round(CF.merged_rank("r_a", "r_b", "gamma", "alpha", CF.SELECTION), 5))
_grid_query("r_star_grid", "r_star", f"round({sql_share('gamma', 'alpha')}, 6)", lambda: F.round(CF.dominant_share("gamma", "alpha"), 6))
_grid_query("rho_c_grid", "ln_rho", f"round(ln({sql_rho('gamma', 'least(alpha, 0.9)')}), 6)", lambda: F.round(F.log(CF.critical_ratio("gamma", F.least("alpha", F.lit(0.9)))), 6))
_grid_query("naive_grid", "gain", "round(sqrt(1 + alpha * gamma * gamma), 6)", lambda: F.round(CF.naive_gain("gamma", "alpha"), 6))
_grid_query("dominant_cause_grid", "cause", "CASE WHEN alpha > 0.5 AND (gamma > 3 OR gamma < 0.33) THEN 'both' WHEN alpha > 0.5 THEN 'direction' WHEN gamma > 3 OR gamma < 0.33 THEN 'energy' WHEN r_a - r_b > 0 THEN 'superadditive' ELSE 'none' END", lambda: CF.dominant_cause("alpha", "gamma", F.col("r_a") - F.col("r_b")))
_grid_query("expected_regime_grid", "regime", "CASE WHEN alpha < 0.2 AND gamma >= 0.5 AND gamma <= 2 THEN 'superadditive' WHEN alpha > 0.5 THEN 'direction_collapse' WHEN gamma > 3 OR gamma < 0.33 THEN 'energy_collapse' ELSE 'transition' END", lambda: CF.expected_regime("alpha", "gamma"))
_grid_query("universal_c_grid", "c", "round(0.946 - 0.175 * ln(r_b / r_a), 6)", lambda: F.round(CF.universal_constant("r_b", "r_a"), 6))


@query("bounds_grid", f"WITH {_GRID_SQL} SELECT alpha, gamma, r_a, r_b, least(r_a, r_b) AS lower, r_a + r_b AS upper, greatest(r_a, r_b) AS larger FROM grid")
def bounds_grid(spark, sf):
    return _grid(spark, sf).select("alpha", "gamma", "r_a", "r_b", *CF.bounds("r_a", "r_b"))


@query("error_bounds_grid", f"WITH {_GRID_SQL} SELECT alpha, gamma, r_a, r_b, round(4 * gamma * gamma / greatest((1 - gamma * gamma) * (1 - gamma * gamma) + 4 * gamma * gamma * alpha, 1e-12) * 0.05 * ln(greatest(r_a, r_b)), 2) AS bound_tight, round(ln(greatest(r_a, r_b)), 6) AS bound_worst FROM grid WHERE alpha > 0")
def error_bounds_grid(spark, sf):
    tight, worst = CF.error_bounds("gamma", "alpha", F.lit(0.05), F.greatest("r_a", "r_b"))
    return _grid(spark, sf).filter("alpha > 0").select("alpha", "gamma", "r_a", "r_b", F.round(tight, 2).alias("bound_tight"), F.round(worst, 6).alias("bound_worst"))


@query("transfer_bound_grid", f"WITH {_GRID_SQL} SELECT alpha, gamma, r_a, r_b, round(0.1 + 2 * abs(1 - gamma) + (1 - alpha) + 0.5 * abs(r_a - r_b), 6) AS bound FROM grid")
def transfer_bound_grid(spark, sf):
    """CF15 with weights 2, 1 and 0.5."""
    bound = CF.transfer_bound(F.lit(0.1), F.abs(1 - F.col("gamma")), 1 - F.col("alpha"), F.abs(F.col("r_a") - F.col("r_b")), 2.0, 1.0, 0.5)
    return _grid(spark, sf).select("alpha", "gamma", "r_a", "r_b", R("bound", bound))


@query("binary_entropy_grid", "SELECT l_linenumber, l_orderkey, round(-p * ln(p) - (1 - p) * ln(1 - p), 6) AS h FROM (SELECT l_linenumber, l_orderkey, greatest(1e-10, least(1 - 1e-10, l_discount * 10)) AS p FROM lineitem)")
def binary_entropy_grid(spark, sf):
    return table(spark, sf, "lineitem").select("l_linenumber", "l_orderkey", R("h", CF.binary_entropy(F.col("l_discount") * 10)))


@query("sql_functions_grid", f"WITH {_GRID_SQL} SELECT alpha, gamma, r_a, r_b, round({sql_predict('r_a', 'r_b', 'gamma', 'alpha')}, 6) AS lib, round({sql_predict('r_a', 'r_b', 'gamma', 'alpha', 'selection')}, 5) AS sel FROM grid")
def sql_functions_grid(spark, sf):
    CF.register_sql(spark)
    _grid(spark, sf).createOrReplaceTempView("closed_form_grid")
    return spark.sql("SELECT alpha, gamma, r_a, r_b, round(predict_library(r_a, r_b, gamma, alpha), 6) AS lib, round(predict_selection(r_a, r_b, gamma, alpha), 5) AS sel FROM closed_form_grid")


# ---- selection by order ----------------------------------------------------------------------


@query("max_reff_topk", f"WITH {sql_pools()} SELECT pool AS pool_id, round(r_eff, 6) AS r_eff, CAST(row_number() OVER (ORDER BY round(r_eff, 9) DESC, pool) AS INTEGER) AS round FROM e ORDER BY round(r_eff, 9) DESC, pool LIMIT 4")
def max_reff_topk(spark, sf):
    return S.top_pools(summaries(spark, sf, dims=2), 4).select("pool_id", R("r_eff"), "round")


@query("random_select_seeds", "SELECT seed, round, pool_id FROM (SELECT CAST(seed AS INTEGER) AS seed, CAST(row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || p), p) AS INTEGER) AS round, p AS pool_id FROM (SELECT DISTINCT 'p' || label AS p FROM embeddings), (SELECT unnest(range(1, 11)) AS seed)) WHERE round <= 3")
def random_select_seeds(spark, sf):
    return S.random_pools(pools(spark, sf, dims=2), 3, list(range(1, 11)))


_DOMAIN = "CASE WHEN pool = 'p9' THEN 'unknown' ELSE 'd' || (CAST(substr(pool, 2) AS INTEGER) % 3) END"


@query("domain_diverse", f"WITH {sql_pools()}, n AS (SELECT pool, r_eff, {_DOMAIN} AS domain, row_number() OVER (PARTITION BY {_DOMAIN} ORDER BY round(r_eff, 9) DESC, pool) AS nth FROM e) SELECT pool AS pool_id, domain, round(r_eff, 6) AS r_eff, CAST(row_number() OVER (ORDER BY nth, round(r_eff, 9) DESC, pool) AS INTEGER) AS round FROM n ORDER BY nth, round(r_eff, 9) DESC, pool LIMIT 6")
def domain_diverse(spark, sf):
    return S.domain_diverse(summaries(spark, sf, dims=2), domains(spark, sf), 6).select("pool_id", "domain", R("r_eff"), "round")


@query("rank_order_rounds", f"WITH {sql_pools()} SELECT pool AS pool_id, CAST(row_number() OVER (ORDER BY round(r_eff, 9) DESC, pool) AS INTEGER) AS round FROM e ORDER BY round(r_eff, 9) DESC, pool LIMIT 3")
def rank_order_rounds(spark, sf):
    return S.rank_order(summaries(spark, sf, dims=2), 3).select("pool_id", "round")


@query("test_rows", "SELECT vec_id FROM embeddings WHERE substr(md5(CAST(vec_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3')")
def test_rows(spark, sf):
    return table(spark, sf, "embeddings").filter(split_hash("vec_id") == "test").select("vec_id")


@query("pool_sizes_running", "SELECT pool_id, n, CAST(sum(n) OVER (ORDER BY pool_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM (SELECT 'p' || label AS pool_id, count(*) AS n FROM embeddings GROUP BY 1)")
def pool_sizes_running(spark, sf):
    n = G.pool_grams(pools(spark, sf, dims=2)).select("pool_id", "n")
    return n.withColumn("upto", F.sum("n").over(Window.orderBy("pool_id").rowsBetween(Window.unboundedPreceding, 0)))
