"""Comparing pools pairwise over their summaries (PW1-PW22, CF6-CF8).

Pairs are an equi-join on the probe and blocks of pools, with an order on the pool; a row for each pool, never rows of
features. Angles between bases and spectra of summed Grams run in Arrow batches over pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlake.functions import closed_form as CF
from gramlake.functions import vectors as V
from gramlake.operators.blocks import BLOCK_BYTES
from gramlake.operators.gram import FAN, add_columns, in_levels, levels, sum_grams
from gramlake.operators.spectral import effective_rank


#: Blocks that the pools of a probe are dealt to on each side of the join.
BLOCKS = 8


def pool_pairs(pools: DataFrame, by: str = "probe", name: str = "pool_id", blocks: int = BLOCKS) -> DataFrame:
    """Every pair (a, b) of one probe with a before b; columns get the suffixes _a and _b.

    Pools are dealt to blocks by name and a pair of blocks is a key of the join, so that a probe's
    pairs, each with two Grams, are spread over blocks x blocks tasks instead of one.
    """
    rest = [c for c in pools.columns if c != by]
    own = F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = pools.select(F.col(by), own.alias("__block_a"), every.alias("__block_b"), *(F.col(c).alias(f"{c}_a") for c in rest))
    b = pools.select(F.col(by), every.alias("__block_a"), own.alias("__block_b"), *(F.col(c).alias(f"{c}_b") for c in rest))
    pairs = a.join(b, [by, "__block_a", "__block_b"]).filter(F.col(f"{name}_a") < F.col(f"{name}_b"))
    return pairs.drop("__block_a", "__block_b")


def principal_cosines(basis_a: np.ndarray, basis_b: np.ndarray) -> np.ndarray:
    """PW1/PW2: cosines of the principal angles between two orthonormal bases (their ranks may differ)."""
    if basis_a.shape[0] != basis_b.shape[0]:
        raise ValueError(f"dimensions differ: {basis_a.shape[0]} and {basis_b.shape[0]}")
    return np.clip(np.linalg.svd(basis_a.T @ basis_b, compute_uv=False), 0.0, 1.0)


def with_angles(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """pairs plus cosines ARRAY<DOUBLE> between the top k directions (k_used = the smaller k)."""
    schema = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes) + ", cosines array<double>, k_used int"

    def run(batches):
        for batch in batches:
            out, used = [], []
            for ba, ka, bb, kb in zip(*(batch.column(c).to_pylist() for c in ("basis_a", "k_a", "basis_b", "k_b")), strict=True):
                at = min(x for x in (k, ka, kb) if x is not None)
                out.append(principal_cosines(np.array(ba).reshape(-1, ka)[:, :at], np.array(bb).reshape(-1, kb)[:, :at]))
                used.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64())), pa.array(used, pa.int32())], names=[*batch.schema.names, "cosines", "k_used"])

    return pairs.mapInArrow(run, schema)


def _mean(x: Column) -> Column:
    return V.total(x) / F.greatest(F.size(x), F.lit(1))


def alignment(cosines: str = "cosines") -> Column:
    """PW3: SA_k, the mean squared cosine."""
    return _mean(F.transform(cosines, lambda c: c * c))


def alignment_variance(cosines: str = "cosines") -> Column:
    """PW3b: population variance of the squared cosines."""
    sq = F.transform(F.col(cosines), lambda c: c * c)
    return F.greatest(F.lit(0.0), _mean(F.transform(sq, lambda x: x * x)) - _mean(sq) * _mean(sq))


def grassmann(cosines: str = "cosines") -> Column:
    """PW5: geodesic distance."""
    return V.norm(F.transform(cosines, lambda c: F.acos(c)))


def svcca(cosines: str = "cosines") -> Column:
    """PW15: mean cosine."""
    return _mean(F.col(cosines))


def pwcca(cosines: str = "cosines", sigma: str = "sigma_a") -> Column:
    """PW16: cosines weighted by the first pool's squared singular values; not symmetric."""
    s = F.slice(sigma, F.lit(1), F.size(cosines))
    w = F.transform(s, lambda x: x * x)
    return V.dot(w, cosines) / (V.total(w) + F.lit(1e-12))


def spectral_w1(a: str = "spectrum_a", b: str = "spectrum_b") -> Column:
    """PW9: distance of the cumulative spectra, the shorter padded with zeros."""
    n = F.greatest(F.size(a), F.size(b))
    return V.l1(V.running(V.padded(a, n)), V.running(V.padded(b, n)))


def truncated_w1(a: str = "sigma_a", b: str = "sigma_b") -> Column:
    """PW10 (STG): spectra cut to the shorter length before they are normalised. Not PW9."""
    n = F.least(F.size(a), F.size(b))
    return V.l1(V.running(V.shares(F.slice(a, F.lit(1), n))), V.running(V.shares(F.slice(b, F.lit(1), n))))


def representation_distance(w1, d_g, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """PW11."""
    return F.sqrt(F.lit(alpha) * w1 * w1 + F.lit(beta) * d_g * d_g)


def dual_channel(stg, sa, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """PW12."""
    return F.lit(alpha) * stg + F.lit(beta) * (1 - sa)


def direction_gain(sa) -> Column:
    """PW13: the share of new directions, 1 - SA_k."""
    return 1 - sa


def joint_score(r_eff, sa) -> Column:
    """PW20."""
    return F.sqrt(F.greatest(F.lit(0.0), r_eff)) * sa


def ssr(r_eff, sa, uid, n_classes) -> Column:
    """PW19: null where intrinsic dimension, alignment or number of classes is too small."""
    ok = uid.isNotNull() & ~F.isnan(uid) & (uid >= 1e-6) & (sa >= 1e-6) & (n_classes >= 2)
    return F.when(ok, r_eff / (sa * uid * F.log(n_classes.cast("double"))))


def multiscale(pairs: DataFrame, scales: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """PW4/PW14: SA_k at several k (bases must hold the largest), their mean and 1 - mean.

    A scale above a pool's rank uses that rank.
    """
    ids = ["probe", "pool_id_a", "pool_id_b"]
    schema = "probe string, pool_id_a string, pool_id_b string, scales map<int,double>"

    def run(batches):
        for batch in batches:
            out = []
            for ba, ka, bb, kb in zip(*(batch.column(c).to_pylist() for c in ("basis_a", "k_a", "basis_b", "k_b")), strict=True):
                a, b = np.array(ba).reshape(-1, ka), np.array(bb).reshape(-1, kb)
                # |V_a' V_b|_F^2 / k needs no inner decomposition
                out.append([(k, float(np.sum((a[:, :m].T @ b[:, :m]) ** 2) / m)) for k in scales for m in [min(k, ka, kb)]])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), pa.array(out, pa.map_(pa.int32(), pa.float64()))], names=[*ids, "scales"])

    found = pairs.select(*ids, "basis_a", "k_a", "basis_b", "k_b").mapInArrow(run, schema)
    at = {k: F.col("scales")[F.lit(k)] for k in scales}
    mean = sum(at.values()) / len(scales)
    return found.select(*ids, *(c.alias(f"sa_{k}") for k, c in at.items()), mean.alias("sa_mean"), (1 - mean).alias("gain_mean"))


def merged_spectrum(pairs: DataFrame) -> DataFrame:
    """pairs plus r_merged, the measured effective rank of the stacked rows (PW22): summed Grams."""
    pairs = pairs.withColumn("gram_ab", add_columns("gram_a", "gram_b")).withColumn("n_ab", F.col("n_a") + F.col("n_b"))
    schema = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes) + ", r_merged double"

    def run(batches):
        for batch in batches:
            out = []
            for packed, d, n in zip(*(batch.column(c).to_pylist() for c in ("gram_ab", "d_a", "n_ab")), strict=True):
                out.append(effective_rank(np.array(packed).reshape(d, d), n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "r_merged"])

    return pairs.mapInArrow(run, schema).drop("gram_ab")


def analyse(summaries: DataFrame, k: int | None = None) -> DataFrame:
    """CF6-CF8: one row for each pair with measured and predicted ranks in both dialects.

    gamma (CF6) divides by nuclear_a + 1e-8, gamma_c (CF7) by max(nuclear_a, 1e-10), gamma_d (CF8) by
    nuclear_a. delta_r and superadditive are against the larger part; delta_r_dom and
    superadditive_dom against the part with more energy (CF8). r_star_energy is CF6's nuclear share,
    r_star CF3's.
    """
    p = merged_spectrum(with_angles(pool_pairs(summaries), k))
    p = p.withColumn("sa_k", alignment()).withColumn("v_alpha", alignment_variance()).withColumn("cos2", F.transform("cosines", lambda c: c * c))
    na, nb, ra, rb, rm = (F.col(c) for c in ("nuclear_a", "nuclear_b", "r_eff_a", "r_eff_b", "r_merged"))
    p = p.withColumn("gamma", nb / (na + 1e-8)).withColumn("gamma_c", nb / F.greatest(na, F.lit(1e-10))).withColumn("gamma_d", nb / na)
    ideal = ra + rb
    top = F.when(F.col("gamma_d") <= 1, ra).otherwise(rb)
    ratio = F.greatest(ra, rb) / F.least(ra, rb)
    p = p.withColumn("r_pred_library", CF.merged_rank(ra, rb, F.col("gamma_c"), F.col("sa_k"), CF.LIBRARY)).withColumn("r_pred_selection", CF.merged_rank(ra, rb, F.col("gamma_d"), F.col("sa_k"), CF.SELECTION))
    return p.select(
        "probe", F.col("pool_id_a").alias("ds_a"), F.col("pool_id_b").alias("ds_b"), ra.alias("r_a"), rb.alias("r_b"), rm.alias("r_merged"), ideal.alias("r_ideal"),
        F.greatest(F.lit(0.0), (ideal - rm) / ideal).alias("collapse_ratio"), (rm - F.greatest(ra, rb)).alias("delta_r"), "sa_k", "v_alpha", "cos2", grassmann().alias("grassmann"),
        na.alias("nuclear_a"), nb.alias("nuclear_b"), "gamma", "gamma_c", "gamma_d", (na / (na + nb + 1e-8)).alias("r_star_energy"), CF.dominant_share(F.col("gamma_c"), F.col("sa_k")).alias("r_star"),
        CF.critical_ratio(F.col("gamma_c"), F.col("sa_k")).alias("rho_c"), ratio.alias("ratio"), "r_pred_library", "r_pred_selection", (F.col("r_pred_library") - rm).alias("pred_error"),
        (F.abs(F.col("r_pred_library") - rm) / rm * 100).alias("pred_error_pct"), (rm > F.greatest(ra, rb)).alias("is_superadditive"), (ratio < CF.critical_ratio(F.col("gamma_c"), F.col("sa_k"))).alias("pred_holds"),
        (rm - top).alias("delta_r_dom"), (rm > top).alias("is_superadditive_dom"), CF.dominant_cause(F.col("sa_k"), F.col("gamma"), rm - F.greatest(ra, rb)).alias("dominant_cause"),
        CF.expected_regime(F.col("sa_k"), F.col("gamma")).alias("expected_regime"),
    )


def symmetric(pairs: DataFrame, value: Column, diagonal: float, name: str, pools: DataFrame) -> DataFrame:
    """PW21: (probe, ds_i, ds_j, value) both ways and with the diagonal."""
    ways = F.array(F.struct(F.col("ds_a").alias("ds_i"), F.col("ds_b").alias("ds_j")), F.struct(F.col("ds_b").alias("ds_i"), F.col("ds_a").alias("ds_j")))
    both = pairs.select("probe", F.explode(ways).alias("way"), value.alias(name)).select("probe", "way.ds_i", "way.ds_j", name)
    return both.unionByName(pools.select("probe", F.col("pool_id").alias("ds_i"), F.col("pool_id").alias("ds_j"), F.lit(diagonal).alias(name)))


def grassmann_loss(pairs: DataFrame, clamp: float | None = None) -> DataFrame:
    """PW7/PW8 (its gradient: loss_gradient): sum of squared geodesic distances over pairs with cosines, by probe."""
    c = F.col("cosines") if clamp is None else F.transform("cosines", lambda x: F.greatest(F.lit(clamp), F.least(F.lit(1 - clamp), x)))
    pairs = pairs.withColumn("__c", c)
    return pairs.groupBy("probe").agg(F.sum(F.pow(grassmann("__c"), 2)).alias("loss"))


def angle_gradient(at: np.ndarray, other: np.ndarray, clamp: float = 1e-6) -> np.ndarray:
    """(d, k) gradient of the sum of squared principal angles by the first basis.

    A cosine changes with its left vector times the other space's matching direction; cosines beyond
    the clamp are constant there and add nothing.
    """
    p, cos, qt = np.linalg.svd(at.T @ other, full_matrices=False)
    inside = (cos > clamp) & (cos < 1 - clamp)
    c = np.clip(cos, clamp, 1 - clamp)
    slope = np.where(inside, -2 * np.arccos(c) / np.sqrt(1 - c * c), 0.0)
    return (other @ qt.T * slope) @ p.T


def loss_gradient(pairs: DataFrame, k: int | None = None, clamp: float = 1e-6) -> DataFrame:
    """PW8: (probe, pool_id, d, k, gradient), the clamped loss by each pool's basis, d x k row-major.

    Bases are cut to the smaller k of each pair; directions that a pair leaves out get zeros from it.
    Both members of a pair get their share, summed within batches and then by pool.
    """
    kinds = "probe string, pool_id string, d int, k int, gradient array<double>"
    many = pa.list_(pa.float64())

    def table(sums: dict) -> dict:
        return {"probe": [p for p, _ in sums], "pool_id": [n for _, n in sums], "d": pa.array([g.shape[0] for g in sums.values()], pa.int32()), "k": pa.array([g.shape[1] for g in sums.values()], pa.int32()), "gradient": pa.array([g.ravel() for g in sums.values()], many)}

    def run(batches):
        for batch in batches:
            sums = {}
            for probe, na, ba, ka, nb, bb, kb in zip(*(batch.column(c).to_pylist() for c in ("probe", "pool_id_a", "basis_a", "k_a", "pool_id_b", "basis_b", "k_b")), strict=True):
                top = min(x for x in (k, ka, kb) if x is not None)
                a, b = (np.array(v).reshape(-1, w) for v, w in ((ba, ka), (bb, kb)))
                for name, own, other in ((na, a, b), (nb, b, a)):
                    total = sums.setdefault((probe, name), np.zeros((len(own), own.shape[1] if k is None else min(k, own.shape[1]))))
                    total[:, :top] += angle_gradient(own[:, :top], other[:, :top], clamp)
            if sums:
                yield pa.RecordBatch.from_pydict(table(sums))

    def add(rows: pa.Table) -> pa.Table:
        first = rows.slice(0, 1).to_pylist()[0]
        total = np.sum([np.array(g) for g in rows.column("gradient").to_pylist()], axis=0)
        return pa.table(table({(first["probe"], first["pool_id"]): total.reshape(first["d"], first["k"])}))

    return pairs.mapInArrow(run, kinds).groupBy("probe", "pool_id").applyInArrow(add, kinds)


def subspace_tangents(at: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """Logarithm map on the Grassmann manifold: (m, d, k) tangents at one basis (d, k) towards m others.

    By principal vectors: each angle turns a direction of the space at hand towards one of the other's,
    along the part of the latter that is orthogonal to the former.
    """
    p, cos, qt = np.linalg.svd(at.T @ bases)
    x, y = at @ p, bases @ qt.transpose(0, 2, 1)
    across = y - x * cos[:, None, :]
    sin = np.linalg.norm(across, axis=1)
    turn = np.divide(np.arctan2(sin, cos), sin, out=np.zeros_like(sin), where=sin > 1e-12)
    return (across * turn[:, None, :]) @ p.transpose(0, 2, 1)


def subspace_step(at: np.ndarray, tangent: np.ndarray) -> np.ndarray:
    """Exponential map: the basis that a tangent leads to, with orthonormal columns."""
    u, s, wt = np.linalg.svd(tangent, full_matrices=False)
    moved = (at @ wt.T * np.cos(s) + u * np.sin(s)) @ wt
    left, _, right = np.linalg.svd(moved, full_matrices=False)
    return left @ right


def mean_subspace(bases: np.ndarray, rounds: int = 50, tolerance: float = 1e-10) -> np.ndarray:
    """The subspace whose tangents towards all bases cancel out, reached from the first of them."""
    mean = bases[0]
    for _ in range(rounds):
        pull = subspace_tangents(mean, bases).mean(0)
        if np.linalg.norm(pull) < tolerance:
            break
        mean = subspace_step(mean, pull)
    return mean


def karcher_mean(summaries: DataFrame, rounds: int = 50, tolerance: float = 1e-10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """PW6: (probe, d, k, basis), the Karcher mean of each probe's bases, in order of name.

    Bases are cut to the smallest k of the probe. Bases of a probe that fit into a block meet in a task;
    those of larger probes stay where they are: each round sends the means out, sums the tangents
    towards the bases in levels and brings back one sum for each probe, until the tangents cancel.
    """
    light = summaries.select("probe", "pool_id", "k", "basis").persist()
    sizes = light.groupBy("probe").agg(F.min("k").alias("k"), F.sum(8 * F.size("basis").cast("long")).alias("bytes"), F.min(F.struct("pool_id", "k", "basis")).alias("first")).persist()
    small = light.join(sizes.filter(F.col("bytes") <= block_bytes).select("probe"), "probe", "left_semi")

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["pool_id"])
        k = min(r["k"] for r in rows)
        mean = mean_subspace(np.stack([np.array(r["basis"]).reshape(-1, r["k"])[:, :k] for r in rows]), rounds, tolerance)
        return pa.table({"probe": [rows[0]["probe"]], "d": pa.array([mean.shape[0]], pa.int32()), "k": pa.array([k], pa.int32()), "basis": pa.array([mean.ravel()], pa.list_(pa.float64()))})

    schema = "probe string, d int, k int, basis array<double>"
    out = small.groupBy("probe").applyInArrow(run, schema)
    means = {r["probe"]: np.array(r["first"]["basis"]).reshape(-1, r["first"]["k"])[:, : r["k"]] for r in sizes.filter(F.col("bytes") > block_bytes).collect()}
    sizes.unpersist()
    if not means:
        return out
    going = set(means)
    for _ in range(rounds):
        pulls = _tangents(light.filter(F.col("probe").isin(list(going))), {p: means[p] for p in going})
        for probe, pull in pulls.items():
            if np.linalg.norm(pull) < tolerance:
                going.discard(probe)
            else:
                means[probe] = subspace_step(means[probe], pull)
        if not going:
            break
    rows = [(p, m.shape[0], m.shape[1], m.ravel().tolist()) for p, m in means.items()]
    return out.unionByName(summaries.sparkSession.createDataFrame(rows, schema))


def _tangents(bases: DataFrame, means: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Mean tangent of each probe from its mean towards its bases; a task holds one sum for each probe."""
    shared = bases.sparkSession.sparkContext.broadcast(means)

    def run(batches):
        sums = {}
        for batch in batches:
            for probe, k, basis in zip(*(batch.column(c) for c in ("probe", "k", "basis")), strict=True):
                probe, at = probe.as_py(), shared.value[probe.as_py()]
                other = basis.values.to_numpy(zero_copy_only=False).reshape(-1, k.as_py())[:, : at.shape[1]]
                n, total = sums.get(probe, (0, 0.0))
                sums[probe] = (n + 1, total + subspace_tangents(at, other[None])[0])
        for probe, (n, total) in sums.items():
            yield pa.RecordBatch.from_pydict({"probe": [probe], "n": pa.array([n], pa.int64()), "total": pa.array([total.ravel()], pa.list_(pa.float64()))})

    def add(names):
        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, first = 0, None, None
            for batch in batches:
                first = batch.slice(0, 1) if first is None else first
                n += sum(batch.column("n").to_pylist())
                for part in batch.column("total"):
                    part = part.values.to_numpy(zero_copy_only=False)
                    total = part if total is None else total + part
            yield pa.RecordBatch.from_arrays([*(first.column(c) for c in names), pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=[*names, "n", "total"])

        return together

    schema = "n bigint, total array<double>"
    rows = in_levels(bases.mapInArrow(run, f"probe string, {schema}"), ["probe"], add, schema, levels(bases, FAN)).collect()
    return {r["probe"]: np.array(r["total"]).reshape(means[r["probe"]].shape) / r["n"] for r in rows}


def parc(grams: DataFrame) -> DataFrame:
    """PW18: (probe, ds_a, ds_b, parc), Pearson's r of the mean-square profiles (column profile)."""
    long = grams.select("probe", "pool_id", F.posexplode("profile").alias("pos", "v"))
    other = long.select(F.col("probe").alias("p2"), F.col("pool_id").alias("ds_b"), F.col("pos").alias("pos2"), F.col("v").alias("w"))
    both = long.withColumnRenamed("pool_id", "ds_a").join(other, (F.col("probe") == F.col("p2")) & (F.col("pos") == F.col("pos2")) & (F.col("ds_a") < F.col("ds_b")))
    return both.groupBy("probe", "ds_a", "ds_b").agg(F.corr("v", "w").alias("parc"))


def linear_cka(features: DataFrame, rows: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """PW17: (probe, ds_a, ds_b, cka) of pools whose first rows rows (by row_id) correspond; without
    rows, all of them up to the smaller pool of each pair.

    Cross-products are sums over positions. A stretch of positions brings the rows of all pools of a probe
    together once, block_bytes of them; each pair of pools that both reach into it gives the Gram of
    their stacked rows there, and these add up to what all three norms follow from.
    """
    w = Window.partitionBy("probe", "pool_id").orderBy("row_id")
    ranked = features.withColumn("pos", F.row_number().over(w) - 1).select("probe", "pool_id", "pos", "features")
    ranked = ranked if rows is None else ranked.filter(F.col("pos") < rows)
    most = features.groupBy("probe").agg((F.countDistinct("pool_id") * F.max(F.size("features")) * 8).alias("bytes")).agg(F.max("bytes")).first()[0] or 1
    per = max(1, block_bytes // most)
    kinds = dict(features.dtypes)
    schema = f"probe {kinds['probe']}, ds_a {kinds['pool_id']}, ds_b {kinds['pool_id']}, n bigint, gram array<double>, colsum array<double>"
    many = pa.list_(pa.float64())

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        names, at = np.array(table.column("pool_id").to_pylist(), object), table.column("pos").to_numpy()
        flat = table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1)
        own = {n: flat[pick[np.argsort(at[pick])]] for n in sorted(set(names)) for pick in [np.flatnonzero(names == n)]}
        probe = table.column("probe").combine_chunks().slice(0, 1)
        for a, x in own.items():
            for b, y in own.items():
                if a < b:
                    n = min(len(x), len(y))
                    both = np.hstack((x[:n], y[:n]))
                    yield pa.RecordBatch.from_arrays([probe, *(pa.array([v], table.schema.field("pool_id").type) for v in (a, b)), pa.array([n], pa.int64()), pa.array([(both.T @ both).ravel()], many), pa.array([both.sum(0)], many)], names=["probe", "ds_a", "ds_b", "n", "gram", "colsum"])

    parts = ranked.withColumn("stretch", F.floor(F.col("pos") / per)).groupBy("probe", "stretch").applyInArrow(cross, schema)
    grams = sum_grams(parts, ["probe", "ds_a", "ds_b"])

    def run(batches):
        for batch in batches:
            out = []
            for n, packed, colsum in zip(*(batch.column(c).to_pylist() for c in ("n", "gram", "colsum")), strict=True):
                s = np.array(colsum)
                g = np.array(packed).reshape(len(s), len(s)) - np.outer(s, s) / n
                h = len(s) // 2
                out.append(float(np.sum(g[:h, h:] ** 2) / (np.sqrt(np.sum(g[:h, :h] ** 2) * np.sum(g[h:, h:] ** 2)) + 1e-12)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("probe", "ds_a", "ds_b")), pa.array(out, pa.float64())], names=["probe", "ds_a", "ds_b", "cka"])

    return grams.mapInArrow(run, f"probe {kinds['probe']}, ds_a {kinds['pool_id']}, ds_b {kinds['pool_id']}, cka double")
