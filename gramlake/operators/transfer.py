"""Supervised transferability scores from per-class Gram summaries (TR1-TR4).

LogME, H-score and TransRate depend on the rows only through counts, sums and Gram matrices of each
class, so all three come from one distributed Gram aggregation by (pool, label).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gramlake.operators.gram import pool_grams

KEYS = ["probe", "pool_id"]


def log_evidence(gram: np.ndarray, proj: np.ndarray, n: int, yy: float, rounds: int = 100, tol: float = 1e-5) -> float:
    """LogME of one target per row count, from H'H, H'y and y'y, by fixed-point rounds.

    In the eigenbasis of H'H, with s2 its eigenvalues and z = V'H'y, the posterior mean is
    beta z / (alpha + beta s2) and the residual y'y - 2 m z + m s2 m.
    """
    d = len(gram)
    s2, v = np.linalg.eigh(gram)
    order = np.argsort(s2)[::-1][: min(n, d)]
    s2, z = np.maximum(s2[order], 0.0), (v.T @ proj)[order]
    alpha = beta = 1.0
    evidence = -np.inf
    for _ in range(rounds):
        m = beta * z / (alpha + beta * s2)
        residual = max(yy - 2 * float(m @ z) + float(m @ (s2 * m)), 0.0)
        mm = float(m @ m)
        now = 0.5 * (d * np.log(alpha) + n * np.log(beta) - beta * residual - alpha * mm - float(np.log(alpha + beta * s2).sum()) - n * np.log(2 * np.pi))
        used = float((beta * s2 / (alpha + beta * s2)).sum())
        alpha, beta = used / (mm + 1e-10), (n - used) / (residual + 1e-10)
        done = abs(now - evidence) < tol * abs(now)
        evidence = now
        if done:
            break
    return evidence / n


def h_score(classes: list[tuple[int, np.ndarray, np.ndarray]], ridge: float = 1e-4) -> float:
    """tr(W^-1 B); classes: (count, column sums, Gram). Classes of one row count in B only."""
    n = sum(c for c, _, _ in classes)
    mean = sum(s for _, s, _ in classes) / n
    within = sum((g - np.outer(s, s) / c for c, s, g in classes if c > 1), np.zeros_like(classes[0][2])) / n + ridge * np.eye(len(mean))
    between = sum(c * np.outer(s / c - mean, s / c - mean) for c, s, _ in classes) / n
    try:
        return float(np.trace(np.linalg.solve(within, between)))
    except np.linalg.LinAlgError:
        return float(np.trace(np.linalg.pinv(within) @ between))


def coding_rate(gram: np.ndarray, n: int, eps: float) -> float:
    s = np.maximum(np.linalg.eigvalsh(gram / n), 0.0)
    return 0.5 * float(np.log1p(len(gram) / eps**2 * s).sum())


def trans_rate(classes: list[tuple[int, np.ndarray, np.ndarray]], eps: float = 0.5) -> float:
    """Coding rate of all rows less the classes' (classes of one row are left out)."""
    n = sum(c for c, _, _ in classes)
    return coding_rate(sum(g for _, _, g in classes), n, eps) - sum(c / n * coding_rate(g, c, eps) for c, _, g in classes if c > 1)


def transferability(features: DataFrame) -> DataFrame:
    """TR4: (probe, pool_id, n, n_classes, logme, hscore, transrate) from rows with a label.

    One row for each class of a pool meets in a task, never rows of features.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["label"])
        d = rows[0]["d"]
        classes = [(r["n"], np.array(r["colsum"]), np.array(r["gram"]).reshape(d, d)) for r in rows]
        gram, n = sum(g for _, _, g in classes), sum(c for c, _, _ in classes)
        logme = float(np.mean([log_evidence(gram, s, n, float(c)) for c, s, _ in classes]))
        return pa.table({"probe": [rows[0]["probe"]], "pool_id": [rows[0]["pool_id"]], "n": pa.array([n], pa.int64()), "n_classes": pa.array([len(rows)], pa.int32()), "logme": [logme], "hscore": [h_score(classes)], "transrate": [trans_rate(classes)]})

    grams = pool_grams(features.filter("label is not null"), [*KEYS, "label"])
    return grams.groupBy(*KEYS).applyInArrow(run, "probe string, pool_id string, n bigint, n_classes int, logme double, hscore double, transrate double")
