"""Statistics over result tables (ST1-ST23)."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _by(df: DataFrame, by):
    return df.groupBy(*by)


def pearson(df: DataFrame, x: str, y: str, by: tuple[str, ...] = (), least: int = 2) -> DataFrame:
    """ST1/ST20: r over rows where both are known; null under least rows."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    # corr() itself fails where a side doesn't vary; that r is null
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return _by(d, by).agg(F.count("*").alias("n"), r.alias("r")).withColumn("r", F.when(F.col("n") >= least, F.col("r")))


#: Distinct values of a group in a range of ranked(), and ranges of a group at most.
RANGE, RANGES = 100_000, 1024


def ranked(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, c) with c rows of each distinct value -> plus rank, ties at their mean, and off, the rank
    less the group's mean rank.

    Values of a group are cut into ranges, at approximate quantiles if it has many; counts of ranges are
    summed in order, and within a range the values are. So a task orders one range of a group.
    """
    keys = [F.col(k).alias(f"__key_{k}") for k in by]
    same = lambda t: F.lit(True) if not by else _all(t[k].eqNullSafe(F.col(f"__key_{k}")) for k in by)
    sizes = values.groupBy(*by).agg(F.count("*").alias("__d"), F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("__cuts"))
    cuts = sizes.filter(F.col("__d") > RANGE).select(*keys, "__cuts")
    placed = values.join(cuts, same(values), "left") if by else values.join(cuts, how="left")
    # cuts are in order, so the range is the number of cuts below the value
    at = F.coalesce(F.aggregate("__cuts", F.lit(0), lambda n, x: n + (x < F.col(value)).cast("int")), F.lit(0))
    placed = placed.withColumn("__range", at).drop("__cuts", *(f"__key_{k}" for k in by))
    counts = placed.groupBy(*by, "__range").agg(F.sum("c").alias("__c"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.select(*keys, F.col("__range").alias("__r"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(every).alias("__all"))
    both = placed.join(counts, same(placed) & (F.col("__range") == F.col("__r")))
    own = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.col("__before") + F.sum("c").over(own) - (F.col("c") - 1) / 2
    return both.withColumn("rank", rank).withColumn("off", F.col("rank") - (F.col("__all") + 1) / 2).drop("__range", "__r", "__before", "__all", *(f"__key_{k}" for k in by))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...] = (), least: int = 2) -> DataFrame:
    """ST3: (by, n, rho) over rows where both are known; null under least rows or if a side doesn't vary.

    Rows are counted by pair of values first. The mean of a group's ranks is known, so the products of
    the deviations are sums over pairs of values. Ranks are centred before they are multiplied: sums of
    whole ranks' products reach the cube of n, which no long holds and of which a double loses digits.
    """
    by = list(by)
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("__left"), F.col(y).alias("__right")).agg(F.count("*").alias("c"))
    sides = []
    for side, r in (("__left", "__off_left"), ("__right", "__off_right")):
        values = ranked(pairs.groupBy(*by, side).agg(F.sum("c").alias("c")), side, by)
        sides.append(values.select(*(F.col(k).alias(f"{r}{k}") for k in by), F.col(side).alias(f"{r}_v"), F.col("off").alias(r)))
    both = pairs
    for side, r, values in (("__left", "__off_left", sides[0]), ("__right", "__off_right", sides[1])):
        both = both.join(values, _all(pairs[k].eqNullSafe(F.col(f"{r}{k}")) for k in by) & (F.col(side) == F.col(f"{r}_v")))
    summed = lambda e: F.sum(F.col("c") * e)
    sums = both.groupBy(*by).agg(F.sum("c").alias("n"), summed(F.col("__off_left") * F.col("__off_right")).alias("xy"), summed(F.col("__off_left") ** 2).alias("xx"), summed(F.col("__off_right") ** 2).alias("yy"))
    rho = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    out = sums.select(*by, "n", F.when(F.col("n") >= least, rho).alias("rho"))
    return out if by else df.sparkSession.range(1).select().join(out.filter("n is not null"), how="left").select(F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "rho")


def channel_pairs(df: DataFrame, channels: list[str], *keep: str) -> DataFrame:
    """(keep, x, y, vx, vy): each row's values of each two channels."""
    pairs = [(x, y) for i, x in enumerate(channels) for y in channels[i + 1 :]]
    pair = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).cast("double").alias("vx"), F.col(y).cast("double").alias("vy")) for x, y in pairs)))
    return df.select(*keep, pair.alias("m")).select(*keep, "m.*")


def evaluator_correlations(results: DataFrame, metrics: list[str], by: str = "dataset", least: int = 4) -> DataFrame:
    """ST20: (scope, x, y, n, r, rho, p_r, p_rho) for each two metrics, over all rows (scope "all") and by dataset.

    Groups under least rows with both metrics are left out. One long table serves all pairs.
    """
    scopes = results.select(F.explode(F.array(F.lit("all"), F.concat(F.lit("="), F.col(by).cast("string")))).alias("scope"), *metrics)
    long, keys = channel_pairs(scopes, metrics, "scope"), ("scope", "x", "y")
    both = pearson(long, "vx", "vy", keys).join(spearman(long, "vx", "vy", keys).drop("n"), list(keys)).filter(F.col("n") >= least)
    both = both.withColumn("p_r", p_value("r", "n")).withColumn("p_rho", p_value("rho", "n"))
    return both.withColumn("scope", F.regexp_replace("scope", "^=", ""))


def _continued_fraction(a: float, b: float, x: float) -> float:
    """Lentz's method for the incomplete beta function's continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _continued_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _continued_fraction(b, a, 1 - x) / b


def correlation_p(r: float, n: int) -> float:
    """ST2: two-sided p of a correlation by the t distribution with n - 2 degrees."""
    if n < 3 or r is None or math.isnan(r):
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return beta_cdf((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


@F.pandas_udf(T.DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """ST2 for columns r and n."""
    return pd.Series([correlation_p(a, int(b)) for a, b in zip(r, n, strict=True)])


def r_squared(true, pred, eps: float = 1e-12) -> Column:
    """ST4 as an aggregate."""
    t, p = F.col(true), F.col(pred)
    return 1 - F.sum((t - p) * (t - p)) / (F.var_pop(t) * F.count(t) + F.lit(eps))


def errors(true: str, pred: str) -> list[Column]:
    """ST5 as aggregates: rmse, mae, max_err."""
    e = F.col(pred) - F.col(true)
    return [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("max_err")]


def rate(flag) -> Column:
    """ST6."""
    return F.avg((F.col(flag) if isinstance(flag, str) else flag).cast("double"))


class Statistic:
    """A statistic of resampled rows: columns whose sums over a sample determine it, and the formula.

    sums are a draw's totals, (draws, 1 + columns): the number of rows first.
    """

    def __init__(self, columns: list[Column], formula):
        self.columns, self.formula = columns, formula


def mean_statistic(x: str) -> Statistic:
    return Statistic([F.col(x)], lambda s: s[:, 1] / s[:, 0])


def pearson_statistic(x: str, y: str) -> Statistic:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")

    def formula(s):
        n, sx, sy, sxx, syy, sxy = s.T
        with np.errstate(invalid="ignore", divide="ignore"):
            return (n * sxy - sx * sy) / np.sqrt(np.maximum(n * sxx - sx * sx, 0) * np.maximum(n * syy - sy * sy, 0))

    return Statistic([a, b, a * a, b * b, a * b], formula)


def error_statistic(true: str, pred: str) -> Statistic:
    """Root of the mean squared error."""
    e = F.col(pred).cast("double") - F.col(true).cast("double")
    return Statistic([e * e], lambda s: np.sqrt(s[:, 1] / s[:, 0]))


#: Bytes of row moments that are sent to all tasks of a bootstrap at once.
MOMENT_BYTES = 64 << 20
#: Picks that a task holds at once.
PICKS = 1 << 20


def _picks(draws: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(draws, n) rows that each draw picks: md5 of seed, draw and place, modulo n."""
    digests = (hashlib.md5(f"{seed}:{b}:{j}".encode()).digest()[:4] for b in draws.tolist() for j in range(n))
    return (np.frombuffer(b"".join(digests), ">u4").astype(np.int64) % n).reshape(len(draws), n)


def bootstrap(df: DataFrame, key: str, stats: dict[str, Statistic], draws: int = 10000, seed: int = 42, level: float = 95.0) -> DataFrame:
    """ST7: (metric, point, ci_lo, ci_hi, se), percentile intervals over resampled rows.

    A draw's picks are md5 of seed, draw and place modulo the row count: the same on any engine. Tasks
    take draws, count how often each picks each row, and multiply counts with the rows' moments; there
    is no join of picks to rows. Rows are in order of key, those that lack a value are left out; more
    than MOMENT_BYTES of moments go out in several parts, whose sums are added up.
    """
    spark = df.sparkSession
    columns = [c.cast("double") for s in stats.values() for c in s.columns]
    formulas = {name: (len(s.columns), s.formula) for name, s in stats.items()}
    rows = df.select(F.col(key).alias("__k"), F.array(*columns).alias("m")).filter(~F.exists("m", lambda v: v.isNull())).orderBy("__k").select("m").persist()
    n, width = rows.count(), len(columns) + 1
    per_part = max(1, MOMENT_BYTES // (8 * width))
    whole = np.zeros(width)
    parts = spark.sparkContext.defaultParallelism * 4
    ids = spark.range(0, draws if n else 0, 1, max(1, min(parts, draws)))
    sums, part, first = None, [], 0

    def summed(moments: np.ndarray, first: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(moments)

        def run(batches):
            some = max(1, PICKS // n)
            for batch in batches:
                every = batch.column(0).to_numpy()
                for at in range(0, len(every), some):
                    b = every[at : at + some]
                    picks = _picks(b, n, seed) - first
                    inside = (picks >= 0) & (picks < len(shared.value))
                    owner = np.nonzero(inside)[0]
                    counts = np.bincount(owner * len(shared.value) + picks[inside], minlength=len(b) * len(shared.value))
                    total = counts.reshape(len(b), -1) @ shared.value
                    yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(list(total), pa.list_(pa.float64()))], names=["b", "s"])

        return ids.mapInArrow(run, "b bigint, s array<double>")

    for row in rows.toLocalIterator():
        part.append([1.0, *row["m"]])
        if len(part) == per_part or first + len(part) == n:
            moments = np.array(part)
            whole += moments.sum(0)
            found = summed(moments, first)
            sums = found if sums is None else sums.unionByName(found)
            first, part = first + len(part), []
    rows.unpersist()
    schema = "metric string, point double, ci_lo double, ci_hi double, se double"
    if sums is None:
        return spark.createDataFrame([], schema)
    if n > per_part:
        sums = sums.groupBy("b").agg(F.array(*(F.sum(F.col("s")[i]) for i in range(width))).alias("s"))

    def evaluated(batches):
        for batch in batches:
            s = np.array(batch.column("s").to_pylist()).reshape(-1, width)
            for m, v in _evaluated(formulas, s).items():
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(v)), pa.array(v)], names=["metric", "v"])

    edge = (100 - level) / 200
    values = sums.mapInArrow(evaluated, "metric string, v double").filter("not isnan(v)")
    spread = values.groupBy("metric").agg(F.percentile("v", F.lit(edge)).alias("ci_lo"), F.percentile("v", F.lit(1 - edge)).alias("ci_hi"), F.stddev_pop("v").alias("se"))
    point = spark.createDataFrame([(m, float(v[0])) for m, v in _evaluated(formulas, whole[None]).items()], "metric string, point double")
    return point.join(spread, "metric").select("metric", "point", "ci_lo", "ci_hi", "se")


def _evaluated(formulas: dict[str, tuple], sums: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 1
    for name, (width, formula) in formulas.items():
        out[name] = formula(np.column_stack((sums[:, :1], sums[:, at : at + width])))
        at += width
    return out


def overlapping_groups(df: DataFrame, groups: dict[str, Column], aggs: list[Column]) -> DataFrame:
    """ST8: named subsets that may overlap, in one pass: each row goes to every group it is in."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(g)) for g, c in groups.items())))
    return df.withColumn("group", F.explode(names)).groupBy("group").agg(*aggs)


def grouped(df: DataFrame, by: tuple[str, ...], aggs: list[Column]) -> DataFrame:
    """ST9."""
    return df.groupBy(*by).agg(*aggs)


def plot_grid(df: DataFrame, rows: str, cols: str, value: str, values: list | None = None) -> DataFrame:
    """ST10: means of value as a grid (the data of a heat map)."""
    return df.groupBy(rows).pivot(cols, values).agg(F.avg(value))


#: Distinct values that quantiles() puts in order in one task.
ORDERED = 10_000
BINS = 1024


def quantiles(df: DataFrame, value: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, q0, q1, ...): exact quantiles of the known values, interpolated between neighbours.

    By selection: each wanted place in the order lies in an interval of values, at first the whole range.
    A pass cuts each interval at approximate quantiles, counts values between the cuts and goes on with the
    bin that holds the place, until no interval has more than ORDERED distinct values; only these are
    put in order. No task holds a group.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("__v"))
    counted = rows.groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    whole = counted.groupBy(*by).agg(F.sum("__c").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count("*").alias("inside"))
    place = [(F.col("n") - 1) * F.lit(float(q)) for q in shares]
    wanted = F.explode(F.array_distinct(F.concat(*(F.array(F.floor(p).cast("bigint"), F.least(F.floor(p) + 1, F.col("n") - 1).cast("bigint")) for p in place))))
    state = whole.filter("n > 0").select(*by, "n", wanted.alias("k"), "lo", "hi", F.lit(0).cast("bigint").alias("below"), "inside").persist()
    held = [state]
    same = lambda a, b: _all(a[k].eqNullSafe(b[f"__key_{k}"]) for k in by)
    renamed = lambda t: t.select(*(F.col(k).alias(f"__key_{k}") for k in by), *(c for c in t.columns if c not in by))
    while (state.agg(F.max("inside")).first()[0] or 0) > ORDERED:
        open_ = renamed(state.filter((F.col("inside") > ORDERED) & (F.col("lo") < F.col("hi"))))
        inside = counted.join(F.broadcast(open_) if open_.count() <= ORDERED else open_, same(counted, open_) & (F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))
        cuts = inside.groupBy(*by, "k").agg(F.percentile_approx("__v", [i / BINS for i in range(1, BINS)], max(10 * BINS, 1000)).alias("cuts"))
        cuts = renamed(cuts.withColumnRenamed("k", "of"))
        inside = inside.drop(*(f"__key_{k}" for k in by)).join(cuts, same(inside, cuts) & (F.col("k") == F.col("of")))
        step = F.aggregate("cuts", F.lit(0), lambda i, x: i + (x < F.col("__v")).cast("int"))
        bins = inside.withColumn("bin", step).groupBy(*by, "n", "k", "below", "bin").agg(F.sum("__c").alias("c"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count("*").alias("inside"))
        upto = F.sum("c").over(Window.partitionBy(*by, "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        chosen = bins.withColumn("upto", F.col("below") + upto).filter((F.col("upto") - F.col("c") <= F.col("k")) & (F.col("k") < F.col("upto")))
        chosen = chosen.select(*by, "n", "k", "lo", "hi", (F.col("upto") - F.col("c")).alias("below"), "inside")
        state = state.filter((F.col("inside") <= ORDERED) | (F.col("lo") == F.col("hi"))).unionByName(chosen).persist()
        held.append(state)
    few = renamed(state)
    inside = counted.join(few, same(counted, few) & (F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))
    upto = F.sum("__c").over(Window.partitionBy(*by, "k").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = inside.withColumn("upto", F.col("below") + upto).filter((F.col("upto") - F.col("__c") <= F.col("k")) & (F.col("k") < F.col("upto"))).select(*by, "n", "k", "__v")
    at = found.groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("k", "__v"))).alias("at"))
    out = []
    for i, p in enumerate(place):
        low, high = F.col("at")[F.floor(p).cast("bigint")], F.col("at")[F.least(F.floor(p) + 1, F.col("n") - 1).cast("bigint")]
        out.append((low + (p - F.floor(p)) * (high - low)).alias(f"q{i}"))
    return at.select(*by, "n", *out)


def quartile_buckets(df: DataFrame, value: str, aggs: list[Column]) -> DataFrame:
    """ST11: rows up to the first quartile ("low") and from the third ("high")."""
    q = quantiles(df, value, [0.25, 0.75])
    marked = df.crossJoin(F.broadcast(q.select("q0", "q1"))).withColumn("bucket", F.when(F.col(value) <= F.col("q0"), "low").when(F.col(value) >= F.col("q1"), "high"))
    return marked.filter("bucket is not null").groupBy("bucket").agg(*aggs)


def medians(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """ST12: (by, n, median)."""
    return quantiles(df, value, [0.5], by).withColumnRenamed("q0", "median")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """ST13."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def channel_independence(df: DataFrame, channels: list[str], level: float = 0.05) -> DataFrame:
    """ST14: (x, y, n, rho, p_rho, r, p_r, independent) for each two channels, all from one scan."""
    long = channel_pairs(df, channels)
    both = pearson(long, "vx", "vy", ("x", "y")).join(spearman(long, "vx", "vy", ("x", "y")).drop("n"), ["x", "y"])
    out = both.withColumn("p_rho", p_value("rho", "n")).withColumn("p_r", p_value("r", "n"))
    return out.withColumn("independent", F.col("p_rho") > level)


def ranking_ablation(df: DataFrame, true: str, predictors: list[str], groups: dict[str, Column]) -> DataFrame:
    """ST15/ST19: Spearman's rho of each predictor with the truth in each group."""
    long = df.select(F.col(true).alias("__y"), F.explode(F.array_compact(F.array(*(F.when(c, F.lit(g)) for g, c in groups.items())))).alias("group"), *predictors)
    long = long.unpivot(["__y", "group"], predictors, "predictor", "value")
    return spearman(long, "value", "__y", ("group", "predictor")).select("group", "predictor", "n", "rho")


def matrix_consistency(a: DataFrame, b: DataFrame, value: str, least: int = 3) -> DataFrame:
    """ST16: Pearson's r of two long matrices (ds_i, ds_j, value) over common upper-triangle cells."""
    x = a.filter("ds_i < ds_j").select("ds_i", "ds_j", F.col(value).alias("x"))
    y = b.filter("ds_i < ds_j").select("ds_i", "ds_j", F.col(value).alias("y"))
    return pearson(x.join(y, ["ds_i", "ds_j"]), "x", "y", (), least)


def joint_lookup(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """ST18: each pair's score: that of ds_b if known, else of ds_a; a pool's first row (by seq) counts."""
    first = scores.withColumn("__n", F.row_number().over(Window.partitionBy("pool_id").orderBy("seq"))).filter("__n = 1").select("pool_id", "score")
    b = first.select(F.col("pool_id").alias("ds_b"), F.col("score").alias("score_b"))
    a = first.select(F.col("pool_id").alias("ds_a"), F.col("score").alias("score_a"))
    return pairs.join(b, "ds_b", "left").join(a, "ds_a", "left").withColumn("score", F.coalesce("score_b", "score_a")).drop("score_a", "score_b")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Distinct by keys, keeping the first row in a stated order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def verify_claims(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """ST21: (metric, expected, observed, status) from (metric, value) and (metric, expected, tol)."""
    both = expected.join(observed, "metric", "left")
    status = F.when(F.col("value").isNull(), "CHECK").when(F.abs(F.col("value") - F.col("expected")) < F.col("tol"), "PASS").otherwise("FAIL")
    return both.select("metric", "expected", F.col("value").alias("observed"), status.alias("status"))


def grid_summary(df: DataFrame, true: str, pred: str, superadditive: str) -> DataFrame:
    """ST22: one row: n, r2, max error, superadditive rate."""
    return df.agg(F.count("*").alias("n"), r_squared(true, pred, 1e-10).alias("r2"), errors(true, pred)[2], rate(superadditive).alias("superadditive"))


def leave_one_out(df: DataFrame, pred: str, true: str, by: str) -> DataFrame:
    """ST23: df plus c_loo, each row's calibration constant from the other rows of its group."""
    ln = F.log(F.col(pred) / F.col(true))
    w = Window.partitionBy(by)
    return df.withColumn("__ln", ln).withColumn("c_loo", F.exp(-(F.sum("__ln").over(w) - F.col("__ln")) / (F.count("*").over(w) - 1))).drop("__ln")


def calibrated(df: DataFrame, pred: str, true: str, by: str) -> DataFrame:
    """CF11 joined back: c and r_cal for each row."""
    c = df.groupBy(by).agg(F.exp(-F.avg(F.log(F.col(pred) / F.col(true)))).alias("c"))
    return df.join(F.broadcast(c), by).withColumn("r_cal", F.col("c") * F.col(pred))


