"""Closed forms over pool summaries, as Column expressions (CF1-CF17).

Notation: gamma is the ratio of nuclear norms B to A, alpha the subspace alignment. With
D = sqrt((1 - gamma^2)^2 + 4 gamma^2 alpha) the merged Gram has two amplitudes
c+- = sqrt((1 + gamma^2 +- D) / 2), and r* = c+ / (c+ + c-). Two dialects of the prediction exist
and are kept apart: LIBRARY clips and gives ties at gamma = 1 to B, SELECTION gives them to A.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LIBRARY, SELECTION = "library", "selection"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clip(x, low, high) -> Column:
    return F.greatest(_c(low), F.least(_c(high), _c(x)))


def binary_entropy(p, edge: float = 1e-10) -> Column:
    """CF4: entropy in nats of a coin with probability p, clipped to [edge, 1 - edge]."""
    q = clip(p, edge, 1 - edge)
    return -q * F.log(q) - (1 - q) * F.log(1 - q)


def discriminant(gamma, alpha) -> Column:
    g2 = _c(gamma) * _c(gamma)
    return F.sqrt(F.greatest(F.lit(0.0), (1 - g2) * (1 - g2) + 4 * g2 * _c(alpha)))


def dominant_share(gamma, alpha, dialect: str = LIBRARY) -> Column:
    """r*: the dominant amplitude's share."""
    g2 = _c(gamma) * _c(gamma)
    if dialect == LIBRARY:
        d = discriminant(gamma, clip(alpha, 0.0, 1 - 1e-8))
        up, down = F.sqrt((1 + g2 + d) / 2), F.sqrt(F.greatest(F.lit(0.0), (1 + g2 - d) / 2))
        return clip(up / (up + down + 1e-12), 1e-6, 1 - 1e-6)
    d = discriminant(gamma, alpha)
    up, down = F.sqrt((1 + g2 + d) / 2), F.sqrt(F.greatest(F.lit(1e-30), (1 + g2 - d) / 2))
    return clip(up / (up + down), 1e-15, 1 - 1e-15)


def merged_rank(r_a, r_b, gamma, alpha, dialect: str = LIBRARY) -> Column:
    """CF1 (LIBRARY) and CF2 (SELECTION): predicted effective rank of the stacked matrices."""
    a, b, g = _c(r_a), _c(r_b), _c(gamma)
    share = dominant_share(g, alpha, dialect)
    entropy = -share * F.log(share) - (1 - share) * F.log(1 - share)
    b_leads = g >= 1 if dialect == LIBRARY else g > 1
    least = F.lit(1e-8 if dialect == LIBRARY else 1e-10)
    lead, trail = F.greatest(least, F.when(b_leads, b).otherwise(a)), F.greatest(least, F.when(b_leads, a).otherwise(b))
    r = F.exp(entropy + share * F.log(lead) + (1 - share) * F.log(trail))
    return clip(r, F.least(a, b), a + b) if dialect == LIBRARY else r


def critical_ratio(gamma, alpha) -> Column:
    """CF3: rho_c, the size ratio under which merging is superadditive."""
    share = dominant_share(gamma, alpha)
    return F.exp(binary_entropy(share, 1e-12) / F.greatest(1 - share, F.lit(1e-10)))


def bounds(r_a, r_b) -> list[Column]:
    """CF5: lower, upper and larger of the parts' ranks."""
    a, b = _c(r_a), _c(r_b)
    return [F.least(a, b).alias("lower"), (a + b).alias("upper"), F.greatest(a, b).alias("larger")]


def dominant_cause(alpha, gamma, delta_r) -> Column:
    """CF9: why a merge collapses: aligned directions, unequal energies, both, or not at all."""
    aligned, unequal = _c(alpha) > 0.5, (_c(gamma) > 3.0) | (_c(gamma) < 0.33)
    return F.when(aligned & unequal, "both").when(aligned, "direction").when(unequal, "energy").when(_c(delta_r) > 0, "superadditive").otherwise("none")


def expected_regime(alpha, gamma) -> Column:
    """CF10. The order of the tests matters."""
    a, g = _c(alpha), _c(gamma)
    return F.when((a < 0.2) & (g >= 0.5) & (g <= 2.0), "superadditive").when(a > 0.5, "direction_collapse").when((g > 3.0) | (g < 0.33), "energy_collapse").otherwise("transition")


def calibration(pred, true) -> Column:
    """CF11 as an aggregate: exp(-mean ln(pred / true))."""
    return F.exp(-F.avg(F.log(_c(pred) / _c(true))))


def probe_constant(probe, constants: dict[str, float], default: float = 1.0) -> Column:
    """CF12: a fixed constant for each probe."""
    items = [F.lit(x) for kv in constants.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*items), _c(probe)), F.lit(default))


def universal_constant(n, r_eff) -> Column:
    """CF13: 0.946 - 0.175 ln(n / r_eff)."""
    return F.lit(0.946) - F.lit(0.175) * F.log(_c(n) / _c(r_eff))


def error_bounds(gamma, alpha, v_alpha, kappa) -> list[Column]:
    """CF14: the tight bound on the log error (holds for part of the pairs only) and the worst case."""
    g2, d = _c(gamma) * _c(gamma), discriminant(gamma, alpha)
    tight = 4 * g2 / F.greatest(d * d, F.lit(1e-12)) * _c(v_alpha) * F.log(_c(kappa))
    return [tight.alias("bound_tight"), F.log(_c(kappa)).alias("bound_worst")]


def transfer_bound(source_error, spectral_gap, directional_gap, intrinsic_gap, a=1.0, b=1.0, c=1.0) -> Column:
    """CF15: source error plus three weighted gaps."""
    return _c(source_error) + _c(a) * _c(spectral_gap) + _c(b) * _c(directional_gap) + _c(c) * _c(intrinsic_gap)


def naive_gain(gamma, alpha) -> Column:
    """CF16: sqrt(1 + alpha gamma^2)."""
    return F.sqrt(1 + _c(alpha) * _c(gamma) * _c(gamma))


def energy_weighted_alignment(sigma, cos2) -> Column:
    """CF17: cos^2 of the principal angles weighted by the share of singular values."""
    n = F.size(_c(cos2))
    s = F.slice(_c(sigma), F.lit(1), n)
    dot = F.aggregate(F.zip_with(s, _c(cos2), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return dot / F.aggregate(s, F.lit(1e-12), lambda a, x: a + x)


def register_sql(spark: SparkSession) -> None:
    """Make the predictors usable from SQL: predict_library, predict_selection, binary_entropy."""
    share = "sqrt((1 + g*g + sqrt(greatest(0D, (1-g*g)*(1-g*g) + 4*g*g*{a}))) / 2)"
    down = "sqrt(greatest({floor}, (1 + g*g - sqrt(greatest(0D, (1-g*g)*(1-g*g) + 4*g*g*{a}))) / 2))"
    entropy = "(-s*ln(s) - (1-s)*ln(1-s))"
    a1 = "greatest(0D, least(1 - 1e-8D, al))"
    lib = (
        f"(SELECT greatest(least(ra, rb), least(ra + rb, exp({entropy} + s*ln(greatest(1e-8D, if(g >= 1, rb, ra))) + (1-s)*ln(greatest(1e-8D, if(g >= 1, ra, rb))))))"
        f" FROM (SELECT greatest(1e-6D, least(1 - 1e-6D, {share.format(a=a1)} / ({share.format(a=a1)} + {down.format(a=a1, floor='0D')} + 1e-12D))) AS s))"
    )
    sel = (
        f"(SELECT exp({entropy} + s*ln(greatest(1e-10D, if(g > 1, rb, ra))) + (1-s)*ln(greatest(1e-10D, if(g > 1, ra, rb))))"
        f" FROM (SELECT greatest(1e-15D, least(1 - 1e-15D, {share.format(a='al')} / ({share.format(a='al')} + {down.format(a='al', floor='1e-30D')}))) AS s))"
    )
    for name, body in (("predict_library", lib), ("predict_selection", sel)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(ra DOUBLE, rb DOUBLE, g DOUBLE, al DOUBLE) RETURNS DOUBLE RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION binary_entropy(p DOUBLE) RETURNS DOUBLE RETURN -greatest(1e-10D, least(1-1e-10D, p))*ln(greatest(1e-10D, least(1-1e-10D, p))) - (1-greatest(1e-10D, least(1-1e-10D, p)))*ln(1-greatest(1e-10D, least(1-1e-10D, p)))")
