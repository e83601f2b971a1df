"""Pairs of pools with known alignment and energy ratio (GEN1-GEN4), generated in tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.functions import closed_form as CF
from gramlake.operators.pairs import principal_cosines
from gramlake.operators.spectral import effective_rank, eigen

#: The full grid and the small one, as (alphas, gammas, repeats, d, k, n).
FULL = ((0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0), (0.2, 0.33, 0.5, 1.0, 2.0, 3.0, 5.0), 5, 512, 50, 1000)
MINI = ((0.0, 0.25, 0.5, 0.75, 1.0), (0.5, 1.0, 2.0, 4.0), 3, 256, 30, 500)


def _basis(rng, rows: int, cols: int) -> np.ndarray:
    return np.linalg.qr(rng.standard_normal((rows, cols)))[0]


def controlled_pair(d: int, k: int, n: int, alpha: float, gamma: float, seed: int, mode: str = "angles") -> tuple[np.ndarray, np.ndarray]:
    """Two float32 matrices of n rows whose top-k spaces have mean squared cosine alpha, and nuclear
    norms in ratio gamma. mode: "angles" (all principal angles equal), "shared" (a share of the
    directions is common), "spread" (angles vary), "noise" (the second space is a noisy first).
    """
    rng = np.random.default_rng(seed)
    va, fresh = _basis(rng, d, k), _basis(rng, d, k)
    fresh = np.linalg.qr(fresh - va @ (va.T @ fresh))[0]
    if mode == "shared":
        common = np.arange(k) < round(alpha * k)
        vb = np.where(common, va, fresh)
    elif mode == "spread":
        c2 = np.clip(alpha + 0.5 * min(alpha, 1 - alpha) * np.linspace(-1, 1, k), 0, 1)
        vb = va * np.sqrt(c2) + fresh * np.sqrt(1 - c2)
    elif mode == "noise":
        vb = np.linalg.qr(np.sqrt(alpha) * va + np.sqrt(1 - alpha) * rng.standard_normal((d, k)) / np.sqrt(d))[0]
    else:
        vb = np.linalg.qr(np.sqrt(alpha) * va + np.sqrt(1 - alpha) * fresh)[0]
    s = np.exp(-3.0 * np.arange(k) / k)
    s *= np.sqrt(n) / s.sum()
    a, b = (_basis(rng, n, k) * s) @ va.T, (_basis(rng, n, k) * (s * gamma)) @ vb.T
    return tuple((x + rng.standard_normal(x.shape) * 1e-5 * x.std()).astype(np.float32) for x in (a, b))


def grid(spark: SparkSession, alphas, gammas, repeats: int, d: int, k: int, n: int, mode: str = "angles") -> DataFrame:
    """GEN2/GEN3: one row for each configuration with measured and predicted ranks."""
    seed = 42 + 1000 * F.col("repeat") + (F.col("alpha") * 100).cast("int") + (F.col("gamma") * 10).cast("int")
    plan = spark.createDataFrame([(float(a), float(g), r) for a in alphas for g in gammas for r in range(repeats)], "alpha double, gamma double, repeat int").withColumn("seed", seed)
    schema = "alpha double, gamma double, repeat int, alpha_actual double, gamma_actual double, r_a double, r_b double, r_merged double"

    def run(frames):
        for pdf in frames:
            out = []
            for alpha, gamma, repeat, s in pdf.itertuples(index=False):
                a, b = (x.astype(float) for x in controlled_pair(d, k, n, alpha, gamma, int(s), mode))
                ga, gb = a.T @ a, b.T @ b
                (wa, va), (wb, vb) = eigen(ga), eigen(gb)
                cos = principal_cosines(va[:, :k], vb[:, :k])
                na, nb = (np.sqrt(np.maximum(w, 0)).sum() for w in (wa, wb))
                out.append((alpha, gamma, repeat, float(np.mean(cos**2)), nb / na, effective_rank(ga, n), effective_rank(gb, n), effective_rank(ga + gb, 2 * n)))
            yield pd.DataFrame(out, columns=["alpha", "gamma", "repeat", "alpha_actual", "gamma_actual", "r_a", "r_b", "r_merged"])

    rows = plan.repartition("alpha", "gamma", "repeat").mapInPandas(run, schema)
    larger = F.greatest("r_a", "r_b")
    return rows.withColumn("r_pred", CF.merged_rank("r_a", "r_b", "gamma_actual", "alpha_actual")).withColumn("delta_r", F.col("r_merged") - larger).withColumn("is_superadditive", F.col("r_merged") > larger + 1e-6)
