"""Input frames of the registered queries, and the same frames as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.operators.gram import pool_grams
from gramlake.operators.spectral import summarise
from gramlake.sources.features import normalise


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def split_hash(column="row_id"):
    """A quarter of the rows is test: the first md5 digit of the id is under 4."""
    return F.when(F.substring(F.md5(F.col(column).cast("string")), 1, 1).isin("0", "1", "2", "3"), "test").otherwise("train")


def folded(dims: int, strides: bool = False):
    """All components of the embedding as dims sums: of runs of neighbours, or of every dims-th component."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    width = 64 // dims
    part = lambda j: F.filter(x, lambda _, i: i % dims == j) if strides else F.slice(x, j * width + 1, width)
    return F.array(*(F.aggregate(part(j), F.lit(0.0), lambda a, v: a + v) for j in range(dims)))


def sql_folded(j: int, dims: int = 2, strides: bool = False) -> str:
    width = 64 // dims
    part = f"{j + 1}:64:{dims}" if strides else f"{j * width + 1}:{(j + 1) * width}"
    return f"list_sum([CAST(v AS DOUBLE) FOR v IN embedding[{part}]])"


def pools(spark: SparkSession, sf: str, dims: int = 64, strides: bool = False, probe: str = "emb", pool=None, label=None) -> DataFrame:
    """embeddings as feature rows, whole or folded to fewer dimensions; pools are the labels by default."""
    df = table(spark, sf, "embeddings")
    pool = F.concat(F.lit("p"), F.col("label").cast("string")) if pool is None else pool
    label = (F.col("vec_id") % 3).cast("int") if label is None else label
    rows = df.select(
        F.lit(probe).alias("probe"), pool.alias("pool_id"), split_hash("vec_id").alias("split"), F.col("vec_id").alias("row_id"), label.alias("label"), (F.col("embedding") if dims == 64 else folded(dims, strides)).alias("features")
    )
    return normalise(rows)


def summaries(spark: SparkSession, sf: str, k: int = 20, **kw) -> DataFrame:
    return summarise(pool_grams(pools(spark, sf, **kw)), k)


def domains(spark: SparkSession, sf: str) -> DataFrame:
    """A domain for each pool but p9: the pool number's remainder by three."""
    return pools(spark, sf, dims=2).select("pool_id").distinct().filter("pool_id <> 'p9'").withColumn("domain", F.concat(F.lit("d"), (F.substring("pool_id", 2, 9).cast("int") % 3).cast("string")))


#: embeddings, folded to two dimensions as unit rows (u), and pool sums with their eigen-decomposition (e).
def sql_pools(strides: bool = False, pool: str = "'p' || label") -> str:
    return f"""
raw AS (SELECT vec_id, label, {pool} AS pool, {sql_folded(0, 2, strides)} AS x0, {sql_folded(1, 2, strides)} AS y0 FROM embeddings),
u AS (SELECT vec_id, label, pool, x0 / greatest(sqrt(x0 * x0 + y0 * y0), 1e-10) AS x, y0 / greatest(sqrt(x0 * x0 + y0 * y0), 1e-10) AS y FROM raw),
g AS (SELECT pool, count(*) AS n, sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c, sum(x) AS sx, sum(y) AS sy FROM u GROUP BY pool),
e0 AS (SELECT *, sqrt((a - c) * (a - c) + 4 * b * b) AS disc FROM g),
e1 AS (SELECT *, sqrt((a + c + disc) / 2) AS s1, sqrt(greatest((a + c - disc) / 2, 0)) AS s2, 0.5 * atan2(2 * b, a - c) AS th FROM e0),
e AS (SELECT *, s1 + s2 AS nuclear, {sql_rank("s1", "s2")} AS r_eff, {sql_rank("s1 * s1", "s2 * s2")} AS vendi FROM e1)"""


def sql_rank(s: str, t: str) -> str:
    p, q = f"(({s}) / (({s}) + ({t})))", f"(({t}) / (({s}) + ({t})))"
    return f"exp(-({p} * ln({p} + 1e-12) + {q} * ln({q} + 1e-12)))"


def sql_pairs(i: int = 1, name: str = "pr", source: str = "e") -> str:
    """Pairs of pools with alignment at k = 1, energies and the merged pool's rank."""
    return f"""
{name}0 AS (
  SELECT x.pool AS ds_a, y.pool AS ds_b, x.r_eff AS r_a, y.r_eff AS r_b, x.nuclear AS na, y.nuclear AS nb, x.vendi AS v_a, x.s1 AS s1a, x.s2 AS s2a, y.s1 AS s1b, y.s2 AS s2b,
    cos(x.th - y.th) * cos(x.th - y.th) AS sa, abs(cos(x.th - y.th)) AS co, x.a + y.a AS ma, x.b + y.b AS mb, x.c + y.c AS mc, x.n + y.n AS mn
  FROM {source} x JOIN {source} y ON x.pool < y.pool),
{name}1 AS (SELECT *, sqrt((ma - mc) * (ma - mc) + 4 * mb * mb) AS md, nb / (na + 1e-8) AS gamma, nb / greatest(na, 1e-10) AS gamma_c, nb / na AS gamma_d FROM {name}0),
{name}2 AS (SELECT *, sqrt((ma + mc + md) / 2) AS m1, sqrt(greatest((ma + mc - md) / 2, 0)) AS m2 FROM {name}1),
{name} AS (SELECT *, {sql_rank("m1", "m2")} AS r_merged FROM {name}2)"""


def sql_share(g: str, al: str, dialect: str = "library") -> str:
    if dialect == "library":
        al = f"greatest(0, least({al}, 1 - 1e-8))"
        d = f"sqrt(greatest(0, (1 - ({g}) * ({g})) * (1 - ({g}) * ({g})) + 4 * ({g}) * ({g}) * {al}))"
        up, down = f"sqrt((1 + ({g}) * ({g}) + {d}) / 2)", f"sqrt(greatest(0, (1 + ({g}) * ({g}) - {d}) / 2))"
        return f"greatest(1e-6, least(1 - 1e-6, {up} / ({up} + {down} + 1e-12)))"
    d = f"sqrt(greatest(0, (1 - ({g}) * ({g})) * (1 - ({g}) * ({g})) + 4 * ({g}) * ({g}) * ({al})))"
    up, down = f"sqrt((1 + ({g}) * ({g}) + {d}) / 2)", f"sqrt(greatest(1e-30, (1 + ({g}) * ({g}) - {d}) / 2))"
    return f"greatest(1e-15, least(1 - 1e-15, {up} / ({up} + {down})))"


def sql_predict(ra: str, rb: str, g: str, al: str, dialect: str = "library") -> str:
    s = sql_share(g, al, dialect)
    b_leads = f"({g}) >= 1" if dialect == "library" else f"({g}) > 1"
    least = "1e-8" if dialect == "library" else "1e-10"
    lead, trail = f"greatest({least}, CASE WHEN {b_leads} THEN {rb} ELSE {ra} END)", f"greatest({least}, CASE WHEN {b_leads} THEN {ra} ELSE {rb} END)"
    r = f"exp(-({s}) * ln({s}) - (1 - {s}) * ln(1 - {s}) + {s} * ln({lead}) + (1 - {s}) * ln({trail}))"
    return f"greatest(least({ra}, {rb}), least({ra} + {rb}, {r}))" if dialect == "library" else r


def sql_rho(g: str, al: str) -> str:
    s = sql_share(g, al)
    return f"exp((-({s}) * ln({s}) - (1 - {s}) * ln(1 - {s})) / greatest(1 - {s}, 1e-10))"
