"""Judging a choice of pools by what models learn from it (EV1-EV9)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramlake.functions import vectors as V
from gramlake.operators.blocks import BLOCK_BYTES, BlockRows
from gramlake.operators.gram import FAN, _matrix, in_levels, levels, pool_grams, sum_grams
from gramlake.operators.neighbours import nearest
from gramlake.operators.spectral import effective_rank, eigen


def moments(features: DataFrame, fan: int = FAN) -> DataFrame:
    """One row (n, mean, m2): count, mean and sum of squared deviations by dimension.

    Deviations are taken from a partition's first row, so nothing is lost to a large common offset and
    a constant gives exactly 0; partitions are merged pairwise by the difference of their means.
    """
    rows = features.filter(F.col("features").isNotNull()).select("features")
    schema = pa.schema([("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))])

    def merged(a, b):
        if a is None:
            return b
        n, step = a[0] + b[0], b[1] - a[1]
        return n, a[1] + step * (b[0] / n), a[2] + b[2] + step * step * (a[0] * b[0] / n)

    def row(own, names, state):
        return pa.RecordBatch.from_arrays([*own, *(pa.array([v], f.type) for v, f in zip(state, schema, strict=True))], names=[*names, *schema.names])

    def run(batches):
        state = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("features"))
                off = x - x[0]
                mean = off.mean(0)
                state = merged(state, (len(x), x[0] + mean, ((off - mean) ** 2).sum(0)))
        if state is not None:
            yield row([], [], state)

    def add(names):
        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, first = None, None
            for batch in batches:
                first = batch.slice(0, 1) if first is None else first
                for n, mean, m2 in zip(*(batch.column(c) for c in schema.names), strict=True):
                    state = merged(state, (n.as_py(), *(v.values.to_numpy(zero_copy_only=False) for v in (mean, m2))))
            yield row([first.column(k) for k in names], names, state)

        return together

    text = "n bigint, mean array<double>, m2 array<double>"
    return in_levels(rows.mapInArrow(run, text), [], add, text, levels(rows, fan), fan)


def scaling(train: DataFrame) -> DataFrame:
    """EV1: one row (mean, std, n): population statistics by dimension; no variance gives std 1. The row
    is computed here, once for all that is scaled by it."""
    std = F.transform("m2", lambda s: F.sqrt(s / F.col("n")))
    stats = moments(train).select("mean", F.transform(std, lambda s: F.when(s > 1e-12, s).otherwise(F.lit(1.0))).alias("std"), "n")
    return train.sparkSession.createDataFrame(stats.collect(), stats.schema)


def scale(df: DataFrame, stats: DataFrame) -> DataFrame:
    """df with features standardised; stats is one row, so its size is fixed."""
    scaled = F.zip_with(F.zip_with("features", "mean", lambda x, m: x - m), "std", lambda x, s: x / s)
    return df.crossJoin(F.broadcast(stats)).withColumn("features", scaled).drop("mean", "std", "n")


def train_neighbours(train: DataFrame, test: DataFrame, k: int = 5, block: int | None = None, labels: tuple[str, ...] = ("label",)) -> DataFrame:
    """(row_id, other_id, d, train_<label>...): the k nearest train rows of each test row, with their labels.

    Distance ties go to the smaller train row_id. The test set is a stated query set; neighbours.nearest()
    meets it with the train rows in pairs of blocks.
    """
    rows = train.select(F.col("row_id").alias("other_id"), *(F.col(y).alias(f"train_{y}") for y in labels), F.col("features").alias("x"))
    return nearest(rows, test.select("row_id", F.col("features").alias("x")), k, carry=[f"train_{y}" for y in labels], block=block)


def knn_vote(near: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """(row_id, label, predicted): majority of the neighbours' labels, vote ties to the smaller label."""
    votes = near.groupBy("row_id", f"train_{label}").agg(F.count("*").alias("votes"))
    best = votes.groupBy("row_id").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(f"train_{label}").alias("label"))).alias("b"))
    return test.select("row_id", F.col(label).alias("label")).join(best.select("row_id", F.col("b.label").alias("predicted")), "row_id")


def nearer(near: DataFrame, k: int) -> DataFrame:
    """The k nearest of train_neighbours() with more: one search serves all smaller k."""
    own = Window.partitionBy("row_id").orderBy(F.round("d", 9), "other_id")
    return near.withColumn("__n", F.row_number().over(own)).filter(F.col("__n") <= k).drop("__n")


def knn_predict(train: DataFrame, test: DataFrame, k: int = 5, block: int | None = None) -> DataFrame:
    """EV3: (row_id, label, predicted) of test rows: majority of the k nearest train rows.

    Distance ties go to the smaller train row_id, vote ties to the smaller label.
    """
    return knn_vote(train_neighbours(train, test, k, block), test)


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))


#: Bytes of features in a partition of the fit, which visits each partition in every iteration, and
#: classes that a model of one row of weights for each may have.
FIT_BYTES, MOST_CLASSES = 32 << 20, 100_000


def linear_probe(train: DataFrame, test: DataFrame, max_iter: int = 1000, c: float = 1.0) -> DataFrame:
    """EV2: (row_id, label, predicted) by multinomial logistic regression on standardised features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    row = scaling(train).first()
    n, d = (row["n"], len(row["mean"])) if row else (0, 0)
    stats = train.sparkSession.createDataFrame([(row["mean"], row["std"])] if row else [], "mean array<double>, std array<double>")
    tr, te = (scale(df, stats).select("row_id", "label", array_to_vector("features").alias("features")) for df in (train, test))
    # labels as 0, 1, ...; at least two, as the model needs
    tr = tr.coalesce(max(1, -(-n * d * 8 // FIT_BYTES))).persist()
    classes = tr.select("label").distinct().withColumn("y", (F.row_number().over(Window.orderBy("label")) - 1).cast("double"))
    y = F.broadcast(train.sparkSession.createDataFrame(classes.limit(MOST_CLASSES + 1).collect(), classes.schema))
    if y.count() > MOST_CLASSES:
        raise ValueError(f"over {MOST_CLASSES} classes")
    model = LogisticRegression(family="multinomial", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=max_iter, labelCol="y").fit(tr.join(y, "label"))
    tr.unpersist()
    classes = y
    found = model.transform(te).select("row_id", "label", F.col("prediction").alias("y"))
    return found.join(F.broadcast(classes.select(F.col("label").alias("predicted"), "y")), "y").select("row_id", "label", "predicted")


def augmented(features: DataFrame, target: str, pools: list[str]) -> DataFrame:
    """EV4: the target's train rows plus each chosen pool's, whose labels are made dense and shifted by
    the classes before them. The target among the pools, and pools without labels, are skipped.
    """
    order = [target, *(p for p in pools if p != target)]
    rows = features.filter(F.col("pool_id").isin(order) & F.col("label").isNotNull())
    place = F.array_position(F.array(*map(F.lit, order)), F.col("pool_id"))
    # classes are numbered among themselves, in order of place and label; rows stay where they are
    classes = rows.select("pool_id", "label").distinct()
    at = F.row_number().over(Window.orderBy(place, "label")) - 1
    numbered = classes.select("pool_id", "label", at.cast("int").alias("dense"))
    return rows.join(F.broadcast(numbered), ["pool_id", "label"]).withColumn("label", F.col("dense")).select(features.columns)


def projector(grams: DataFrame) -> tuple[np.ndarray, int]:
    """V_r V_r' of the stacked pools, r their rounded effective rank (at least 1). d x d numbers."""
    total = sum_grams(grams, []).first()
    gram = np.array(total["gram"]).reshape(len(total["colsum"]), -1)
    r = max(int(round(effective_rank(gram, total["n"]))), 1)
    v = eigen(gram)[1][:, :r]
    return v @ v.T, r


def project(df: DataFrame, p: np.ndarray) -> DataFrame:
    """Rows times a d x d matrix, in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(p)
    at = df.columns.index("features")

    def run(batches):
        for batch in batches:
            x = batch.column(at)
            m = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) @ shared.value if len(x) else np.zeros((0, len(shared.value)))
            cols = list(batch.columns)
            cols[at] = pa.array(list(m), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def fair_probe(features: DataFrame, chosen: list[str], train: DataFrame, test: DataFrame, max_iter: int = 300) -> DataFrame:
    """EV5: the linear probe after projecting both sets on the chosen pools' leading directions."""
    p, _ = projector(pool_grams(features.filter(F.col("pool_id").isin(chosen))))
    return linear_probe(project(train, p), project(test, p), max_iter)


def mean_over_targets(results: DataFrame, value: str = "accuracy", by: tuple[str, ...] = ()) -> DataFrame:
    """EV6: mean and count over targets; null if there is none."""
    return results.groupBy(*by).agg(F.avg(value).alias(f"{value}_mean"), F.count(value).alias("n_targets"))


def leading_vectors(times: Callable, m: int, count: int, steps: int = 200, tolerance: float = 1e-12, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the count algebraically largest eigenvalues of a symmetric m x m matrix that is
    only known by its products with vectors: Lanczos, each vector made orthogonal to all before."""
    rng = np.random.default_rng(seed)
    basis, diagonal, beside = [], [], []

    def fresh():
        v = rng.standard_normal(m)
        for _ in range(2):
            for b in basis:
                v -= (b @ v) * b
        return v / np.linalg.norm(v)

    basis.append(fresh())
    while True:
        w = times(basis[-1])
        diagonal.append(basis[-1] @ w)
        for _ in range(2):
            for b in basis:
                w -= (b @ w) * b
        size, scale = np.linalg.norm(w), max(1e-300, max(map(abs, diagonal + beside)))
        values, inner = eigen(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
        top = min(count, len(values))
        done = len(basis) >= count and size * np.abs(inner[-1, :top]).max() <= tolerance * scale
        if len(basis) == m or len(basis) >= steps or done and size > tolerance * scale:
            return values[:top], np.stack(basis, 1) @ inner[:, :top]
        # a space that is closed before all vectors are found goes on from another vector
        beside.append(size if size > tolerance * scale else 0.0)
        basis.append(w / size if size > tolerance * scale else fresh())


def centred_square(times_square: Callable) -> Callable:
    """Products with the doubly centred matrix -1/2 J D^2 J, from products with D^2."""

    def times(x):
        y = -0.5 * times_square(x - x.mean())
        return y - y.mean()

    return times


def scaled_points(times_square: Callable, m: int, dims: int) -> np.ndarray:
    """Classical scaling: coordinates from the doubly centred squares of the distances."""
    w, v = leading_vectors(centred_square(times_square), m, min(dims, m))
    x = v * np.sqrt(np.maximum(w, 0))
    return np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def majorising_step(d: np.ndarray, own: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Of rows d of the distances between points own and all points x: where majorisation moves own, and
    their part of the stress (each pair counts a half on either side).

    The step goes to the minimum of a quadratic that lies above the stress and touches it at the points
    at hand, so the stress never grows.
    """
    drawn = np.sqrt(np.maximum(((own[:, None, :] - x[None, :, :]) ** 2).sum(-1), 0))
    pull = np.divide(d, drawn, out=np.zeros_like(d), where=drawn > 1e-12)
    return (own * pull.sum(1)[:, None] - pull @ x) / len(x), float(((d - drawn) ** 2).sum() / 2)


def majorised(step: Callable, starts: list[np.ndarray], rounds: int, tolerance: float) -> tuple[np.ndarray, float]:
    """(points, stress), the best of several starts. step takes a list of layouts and gives a list of
    (moved points, stress at the layout), so that one visit of the distances serves all starts."""
    layouts = [x - x.mean(0) for x in starts]
    last = [np.inf] * len(layouts)
    ended: dict[int, tuple[np.ndarray, float]] = {}
    for turn in range(rounds + 1):
        going = [i for i in range(len(layouts)) if i not in ended]
        for i, (moved, now) in zip(going, step([layouts[i] for i in going]), strict=True):
            if turn == rounds or turn and last[i] - now <= tolerance * max(last[i], 1e-300):
                ended[i] = (layouts[i], now)
            else:
                layouts[i], last[i] = moved, now
        if len(ended) == len(layouts):
            break
    return min(ended.values(), key=lambda r: r[1])


def point_distances(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1), 0))


def stress(d: np.ndarray, x: np.ndarray) -> float:
    """Sum of squared differences between wanted and drawn distances, each pair once."""
    return float(((d - point_distances(x)) ** 2).sum() / 2)


def turned(x: np.ndarray) -> np.ndarray:
    """Points turned to their principal axes, the largest coordinate of each axis positive."""
    x = x - x.mean(0)
    x = x @ eigen(x.T @ x)[1]
    return x * np.where(x[np.abs(x).argmax(0), range(x.shape[1])] < 0, -1, 1)


def _distances(distances: DataFrame, block_bytes: int) -> BlockRows:
    return BlockRows(distances, value="distance", block_bytes=block_bytes)


def _placed(matrix: BlockRows, place: Callable) -> DataFrame:
    """(ds_i, x, stress) of place(products with D^2, steps of majorisation, m).

    A matrix of one block is placed by the task that holds it; larger ones by rounds over their blocks,
    for which the driver holds the points.
    """
    m = len(matrix.names)
    if m == 0:
        found = np.zeros(0)
    elif matrix.blocks == 1:

        def alone(_, d, __):
            steps = lambda layouts: [majorising_step(d, x, x) for x in layouts]
            x = turned(place(lambda v: (d * d) @ v, steps, m))
            return np.append(x.ravel(), steps([x])[0][1])

        found = matrix.rows(alone, None)[0][1]
    else:

        def moved(first, d, layouts):
            rows = [majorising_step(d, x[first : first + len(d)], x) for x in layouts]
            return np.concatenate([np.append(x.ravel(), s) for x, s in rows])

        def steps(layouts):
            count, width = len(layouts), layouts[0].shape[1]
            parts = [v.reshape(count, -1) for _, v in matrix.rows(moved, layouts)]
            return [(np.concatenate([p[i, :-1].reshape(-1, width) for p in parts]), float(sum(p[i, -1] for p in parts))) for i in range(count)]

        x = turned(place(lambda v: matrix.times(v, np.square), steps, m))
        found = np.append(x.ravel(), steps([x])[0][1])
    matrix.release()
    points = found[:-1].reshape(m, -1).tolist() if m else []
    rows = [(n, x, float(found[-1])) for n, x in zip(matrix.names, points, strict=True)]
    return matrix.spark.createDataFrame(rows, "ds_i string, x array<double>, stress double")


def classical_mds(distances: DataFrame, dims: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """EV7: (ds_i, x ARRAY<DOUBLE>) from a long symmetric matrix (ds_i, ds_j, distance), by double centring
    and its leading eigenvectors."""
    return _placed(_distances(distances, block_bytes), lambda square, _, m: scaled_points(square, m, dims)).drop("stress")


def stress_mds(distances: DataFrame, dims: int = 2, starts: int = 4, seed: int = 42, rounds: int = 300, tolerance: float = 1e-9, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """EV7: (ds_i, x ARRAY<DOUBLE>, stress) by stress majorisation, the best of the classical solution and
    of starts seeded random ones. Its stress is at most that of classical_mds.
    """

    def place(square, steps, m):
        rng = np.random.default_rng(seed)
        first = [scaled_points(square, m, dims), *(rng.uniform(size=(m, dims)) for _ in range(starts))]
        return majorised(steps, first, rounds, tolerance)[0]

    return _placed(_distances(distances, block_bytes), place)


def trend(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """EV8: least-squares line by group."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def random_baseline(runs: DataFrame, value: str, by: tuple[str, ...], z: float = 1.96) -> DataFrame:
    """EV9: mean of seeds with its interval mean -+ z sd / sqrt(n), and the sign test's p of n wins of n."""
    out = runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    half = F.lit(z) * F.col("sd") / F.sqrt("n")
    return out.withColumn("lo", F.col("mean") - half).withColumn("hi", F.col("mean") + half).withColumn("p_sign", F.pow(F.lit(2.0), -F.col("n")))


def cosine(x, y):
    """Cosine of two array columns."""
    return V.dot(x, y) / (V.norm(x) * V.norm(y))
