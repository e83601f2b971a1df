"""Spectral summaries of pools from their Gram matrices (SP2-SP11).

The eigen-decomposition of a d x d Gram is the only step outside Column expressions; it runs in
Arrow batches over one row for each pool.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.functions import vectors as V
from gramlake.operators.gram import NAMES, pool_grams, r_factors, row_kernels
from gramlake.operators.neighbours import nearest

FLOOR = 1e-10


def eigen(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a symmetric matrix, largest first."""
    w, v = np.linalg.eigh(gram)
    return w[::-1], v[:, ::-1]


def singular_values(w: np.ndarray) -> np.ndarray:
    """Roots of a Gram matrix's eigenvalues, largest first; what rounding can't tell from 0 is 0."""
    unknown = len(w) * np.finfo(float).eps * max(w[0], 0.0) if len(w) else 0.0
    return np.sqrt(np.where(w > unknown, w, 0.0))


def entropy_rank(p: np.ndarray, eps: float) -> float:
    return float(np.exp(-np.sum(p * np.log(p + eps)))) if len(p) else 1.0


def effective_rank(gram: np.ndarray, n: int, squared: bool = False, sigma_floor: bool = False) -> float:
    """SP2 of the rows behind a Gram matrix; squared gives the Vendi score (SP6), sigma_floor SP2b.

    By default eigenvalues of gram / n up to 1e-10 don't count. The sigma_floor dialect takes
    singular values of the rows themselves above 1e-10; from a Gram those are only known to about
    1e-8 of the largest, so it is approximate there. sigma_ranks() is exact.
    """
    w = np.linalg.eigvalsh(gram)[::-1]
    if sigma_floor:
        s = np.sqrt(np.maximum(w, 0))[: min(n, len(w))]
        s = s[s > FLOOR]
        return entropy_rank(s / s.sum(), 1e-30) if len(s) else 1.0
    return spectrum_rank(w, n, squared)


def spectrum_rank(w: np.ndarray, n: int, squared: bool = False) -> float:
    """SP2 or SP6 from the eigenvalues of a Gram matrix of n rows."""
    w = w / max(n, 1)
    w = w[w > FLOOR]
    x = w if squared else np.sqrt(w)
    return entropy_rank(x / x.sum(), 1e-12) if len(x) else 1.0


def summarise(grams: DataFrame, k: int = 20) -> DataFrame:
    """grams plus sigma, spectrum, nuclear, r_eff, r_eff_sigma, r_norm, vendi, kappa, basis and k.

    sigma: the min(n, d) singular values of the rows; spectrum: those that count for r_eff as
    shares; basis: the top k right singular vectors, d x k, row-major (k at most min(n, d)).
    """
    extra = "sigma array<double>, spectrum array<double>, nuclear double, r_eff double, r_eff_sigma double, vendi double, basis array<double>, k int"
    schema = ", ".join(f"`{n}` {t}" for n, t in grams.dtypes) + ", " + extra

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            for n, d, packed in zip(*(batch.column(c).to_pylist() for c in ("n", "d", "gram")), strict=True):
                gram = np.array(packed).reshape(d, d)
                w, v = eigen(gram)
                sigma = singular_values(w)[: min(n, d)]
                counted = np.sqrt(w[w / max(n, 1) > FLOOR] / max(n, 1))
                top = max(1, min(k, n, d))
                row = (sigma, counted / counted.sum() if len(counted) else counted, float(sigma.sum()), effective_rank(gram, n), effective_rank(gram, n, sigma_floor=True), effective_rank(gram, n, squared=True), v[:, :top].ravel(), top)
                for c, x in zip(out, row, strict=True):
                    c.append(x)
            many = pa.list_(pa.float64())
            kinds = [many, many, pa.float64(), pa.float64(), pa.float64(), pa.float64(), many, pa.int32()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=[*batch.schema.names, "sigma", "spectrum", "nuclear", "r_eff", "r_eff_sigma", "vendi", "basis", "k"])

    out = grams.mapInArrow(run, schema)
    out = out.withColumn("r_norm", F.col("r_eff") / F.least("n", "d"))  # SP3
    last = F.greatest(F.element_at("sigma", F.least(F.col("k"), F.size("sigma"))), F.lit(1e-12))
    return out.withColumn("kappa", F.element_at("sigma", 1) / last)  # SP11


def _ranked(frame: DataFrame, columns: list[str], extra: str, of) -> DataFrame:
    """frame's columns plus what of(n, d, numbers) gives for each row, numbers being its last column."""
    *kept, packed = columns
    schema = ", ".join(f"`{n}` {t}" for n, t in frame.select(*kept).dtypes) + ", " + extra

    def run(batches):
        for batch in batches:
            rows = [of(n, d, x.values.to_numpy(zero_copy_only=False)) for n, d, x in zip(batch.column("n").to_pylist(), batch.column("d").to_pylist(), batch.column(packed), strict=True)]
            out = list(zip(*rows, strict=True)) or [[] for _ in extra.split(",")]
            kinds = [pa.list_(pa.float64()) if "array" in e else pa.float64() for e in extra.split(",")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=[*kept, *(e.split()[0] for e in extra.split(","))])

    return frame.select(*columns).mapInArrow(run, schema)


def side_ranks(features: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """SP2, SP4 and SP6 from the smaller side of each pool: (keys, n, d, side, sigma, nuclear, r_eff, vendi).

    Pools with no more rows than dimensions (side "rows") go by the n x n products of their rows, the
    others (side "columns") by the d x d Gram; the ranks are the same, as both have the same
    eigenvalues but for zeros. features also has row_id, which is unique in a pool.
    """
    keys = NAMES if keys is None else keys
    own = [F.col(k).alias(f"__{k}") for k in keys]
    sizes = features.filter(F.col("features").isNotNull()).groupBy(*keys).agg((F.count("*") <= F.max(F.size("features"))).alias("__few"))
    sided = features.join(sizes.select(*own, "__few"), [features[k].eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*(f"__{k}" for k in keys))
    kernels = row_kernels(sided.filter("__few"), keys).withColumn("side", F.lit("rows"))
    grams = pool_grams(sided.filter("not __few"), keys).withColumn("side", F.lit("columns"))

    def of(n, d, packed):
        gram = packed.reshape(min(n, d), -1)
        sigma = singular_values(eigen(gram)[0])[: min(n, d)]
        return sigma, float(sigma.sum()), effective_rank(gram, n), effective_rank(gram, n, squared=True)

    both = kernels.unionByName(grams)
    return _ranked(both, [*keys, "n", "d", "side", "gram"], "sigma array<double>, nuclear double, r_eff double, vendi double", of)


def sigma_ranks(features: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """SP2b: (keys, n, d, sigma, r_eff_sigma), from the rows' own singular values by triangular factors.

    A Gram matrix knows singular values to about 1e-8 of the largest; these are good to about 1e-15
    of it, so that the floor of 1e-10 is met.
    """
    keys = NAMES if keys is None else keys

    def of(n, d, packed):
        sigma = np.linalg.svd(packed.reshape(-1, d), compute_uv=False)
        s = sigma[sigma > FLOOR]
        return sigma, entropy_rank(s / s.sum(), 1e-30) if len(s) else 1.0

    return _ranked(r_factors(features, keys), [*keys, "n", "d", "r"], "sigma array<double>, r_eff_sigma double", of)


def spectral_cdf(spectrum: str = "spectrum") -> Column:
    """SP8."""
    return V.running(spectrum)


def _chord(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of unit rows, from products summed in order of dimension, as a plain loop would."""
    dot = np.zeros(len(q))
    for j in range(x.shape[1] if len(x) else 0):
        dot += q[:, j] * x[:, j]
    return np.sqrt(np.maximum(2 - 2 * np.clip(dot, -1, 1), 0))


def two_nn(features: DataFrame, keys: list[str] | None = None, block: int | None = None) -> DataFrame:
    """SP7: (keys, n, uid), the TwoNN estimate of intrinsic dimension of each pool.

    Null for pools of under 10 rows or with under 5 usable ones. The estimate needs each row's two
    nearest within its pool, which neighbours.nearest() finds by pairs of blocks.
    """
    keys = NAMES if keys is None else keys
    rows = features.select(*keys, "row_id", V.unit("features", 1e-12).alias("x"))
    near = nearest(rows.withColumnRenamed("row_id", "other_id"), rows, 2, keys, same=True, measure=_chord, block=block)
    two = near.groupBy(*keys, "row_id").agg(F.min("d").alias("m1"), F.max("d").alias("m2"))
    ok = (F.col("m1") > 1e-10) & (F.col("m2") > 1e-10)
    fit = two.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("ok"), F.avg(F.when(ok, F.log(F.col("m2") / F.col("m1")))).alias("mean"))
    return fit.select(*keys, "n", F.when((F.col("n") >= 10) & (F.col("ok") >= 5), 1 / (F.log(F.lit(2.0)) * F.col("mean"))).alias("uid"))
