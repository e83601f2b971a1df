"""Exact top-k search by aggregation without random access.

Each dimension of a block of candidates is a list of its components, sorted once for all queries. A
query's score sums its products with one entry of each list, so it reads a list from the top where
its own component is positive and from the bottom where it is negative: the products fall as it
goes; dimensions in which it is 0 are not read. All lists are read to the same depth, some entries at a time,
which are added to running sums. What a candidate has shown so far plus each unread list's least
product is its lower bound, plus each unread list's last product its upper bound. Reading stops when
a candidate that has not been seen at all, whose bound is the sum of the last products, cannot
reach the k-th best score, and few seen ones could; those few are resolved to final scores.

The k-th best score is at least the k-th lower bound of the block, and at least the query's k-th
best among ``SEEDS`` candidates that are scored beforehand, so a block far from the query is left early.

Candidates and queries are dealt into blocks of bounded bytes by a hash of the id; each pair of
blocks is one task's work, and the k best of each block pair meet in a ranked aggregation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of vectors (8 for each component) in a block of candidates, and of queries.
CANDIDATE_BYTES, QUERY_BYTES = 2 << 20, 32 << 20
#: Candidates of each length that all queries are scored against first, and their bytes at most.
SEEDS, SEED_BYTES = 1024, 4 << 20
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def usable(column: str):
    """Neither null nor holding null or non-finite components."""
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~bad, F.lit(False))


def quantise(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, x as double: whole numbers, Python's where doubles overflow."""
    with np.errstate(over="ignore"):
        out = np.floor(vectors.astype(np.float64) * scale)
    if np.isfinite(out).all():
        return out
    return np.array([[int(x) * scale if abs(x) > 2.0**60 else math.floor(x * scale) for x in row] for row in vectors.tolist()], object).reshape(vectors.shape)


def whole_numbers(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


class Lists:
    """A block's candidates as one sorted list for each dimension."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, 0)
        #: Entries read so far, of all queries.
        self.entries = 0

    def candidates(self, query: np.ndarray, k: int, floor=None, first: int = 64) -> np.ndarray:
        """The candidates that can be among the query's k best, all that tie with the k-th included.

        floor: a score that the k-th best is known to reach. Without one, the first 1 / first of each
        list is read. Then the lists' entries at trial depths tell how deep the lists have to be read for an unseen
        candidate to be out; where that is over a quarter of them, all the rest is read at once.
        """
        n, d = self.vectors.shape
        dims = np.flatnonzero(query != 0)
        if n <= k or not len(dims):
            return np.arange(n)
        w = query[dims]
        up = np.array([v > 0 for v in w])
        # a list's last product when it has been read to a depth
        last = lambda depth: w * self.sorted[np.where(up, n - depth, depth - 1), dims]
        least = last(n)
        known, read = np.zeros(n, self.vectors.dtype), np.zeros((n, len(dims)), bool)
        done, kth, depth = 0, floor, 0 if floor is not None else max(1, -(-n // first))
        while True:
            if not depth:
                depth = self._depth_to(lambda x, kth=kth: last(x).sum() < kth, n)
                if depth > n // 4:
                    self.entries += (n - done) * len(dims)
                    known = self.vectors[:, dims] @ w
                    return np.flatnonzero(known >= _largest(known, k, floor))
                depth = max(depth, min(2 * done, n // 4))
            for c, j in enumerate(dims):
                rows = slice(n - depth, n - done) if up[c] else slice(done, depth)
                who = self.order[rows, j]
                known[who] += w[c] * self.sorted[rows, j]
                read[who, c] = True
            self.entries += (depth - done) * len(dims)
            done = depth
            kth = _largest(known + np.where(read, np.zeros_like(least), least).sum(1), k, kth)
            if last(done).sum() < kth:
                # a candidate that nobody has seen is out; a seen one's bound is by what it has not shown
                seen = np.flatnonzero(read.any(1))
                upper = known[seen] + np.where(read[seen], np.zeros_like(least), last(done)).sum(1)
                left = seen[upper >= kth]
                if len(left) <= max(4 * k, n // 32):
                    return left
                if done >= n // 4:
                    # many could still be among the best: what they have not shown is read
                    self.entries += int((~read[left]).sum())
                    score = self.vectors[np.ix_(left, dims)] @ w
                    return left[score >= _largest(score, min(k, len(left)), floor)]
            depth = 0

    @staticmethod
    def _depth_to(out, n: int) -> int:
        """The least depth at which out holds, n + 1 if there is none; out holds at all depths beyond."""
        low, high = 1, n + 1
        while low < high:
            mid = (low + high) // 2
            if mid <= n and not out(mid):
                low = mid + 1
            else:
                high = mid
        return low


def _largest(values: np.ndarray, k: int, floor):
    """The k-th largest value, or floor if that is more."""
    kth = sorted(values.tolist())[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]
    return kth if floor is None or floor < kth else floor


def _fitting(c: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products stay exact in floating point, or else Python's numbers are taken."""
    if int(abs(c).max(initial=0)) * int(abs(q).max(initial=0)) * max(1, c.shape[1]) >= 2**52:
        return whole_numbers(c), whole_numbers(q)
    return c, q


def _search_block(k: int, scale: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            d = int(left["d"].iloc[0])
            ids = left["id"].to_numpy()
            by_id = np.argsort(ids, kind="stable")
            ids = ids[by_id]
            c, q = (quantise(np.stack(x.to_numpy()).reshape(len(x), d), scale) for x in (left["v"], right["v"]))
            c, q = _fitting(c[by_id], q)
            lists = Lists(c)
            for own, query, floor in zip(right["id"].to_numpy(), q, right["floor"].to_numpy(), strict=True):
                # the query's own row may take a place, so one more is looked for
                could = lists.candidates(query, min(k + 1, len(ids)), None if np.isnan(floor) else floor)
                could = could[ids[could] != own]
                score = c[could] @ query if d else np.zeros(len(could))
                best = sorted(range(len(could)), key=lambda i: (-score[i], could[i]))[:k] if score.dtype == object else np.lexsort((could, -score))[:k]
                out += [(own, ids[could[b]], min(max(int(score[b]), LONG_MIN), LONG_MAX)) for b in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def with_floor(asked: DataFrame, candidates: DataFrame, k: int, scale: int) -> DataFrame:
    """asked plus floor: each query's k-th best score among some candidates of its length, the first by
    hash of id. Not a number if there are fewer than k."""
    lengths = [r["d"] for r in asked.select("d").distinct().collect()]
    seeds = {}
    for d in lengths:
        most = min(SEEDS, max(1, SEED_BYTES // (8 * max(d, 1))))
        rows = candidates.filter(F.col("d") == d).orderBy(F.xxhash64("id"), "id").limit(most).collect()
        seeds[d] = (np.array([r["id"] for r in rows], np.int64), [r["v"] for r in rows])
    shared = asked.sparkSession.sparkContext.broadcast(seeds)

    def run(frames):
        for pdf in frames:
            floors = []
            for own, v, d in zip(pdf["id"], pdf["v"], pdf["d"], strict=True):
                ids, vectors = shared.value[d]
                others = [x for i, x in zip(ids.tolist(), vectors, strict=True) if i != own] if own in ids else vectors
                if len(others) < k or not d:
                    floors.append(np.nan)
                    continue
                c, q = _fitting(quantise(np.array(others, float).reshape(-1, d), scale), quantise(np.array(v, float).reshape(1, d), scale))
                score = sorted((c @ q[0]).tolist())[-k]
                # scores beyond 64 bits rank as the nearest long; a number that no double holds is rounded down
                score = min(max(score, LONG_MIN), LONG_MAX)
                floors.append(np.nextafter(float(score), -np.inf) if abs(score) >= 2**52 else float(score))
            yield pdf.assign(floor=floors)

    return asked.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in asked.dtypes) + ", floor double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of vectors by inner product of quantised
    components; ties go to smaller ids. Fewer candidates give fewer rows.

    Vectors that are null, hold null or non-finite components, or have a null id take no part. Scores
    are exact whole numbers; one beyond 64 bits is given as the nearest long, and ranks as that
    between blocks. Only vectors of the query's length are its candidates (empty ones score 0
    among each other). Rows with the query's id are not. Repeated rows count once; of rows that
    differ under one id the smallest vector counts. Other columns are not read; empty tables give an
    empty result.
    """

    def clean(df):
        df = df.filter(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
        return df.groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))

    def parts(df, size):
        row = df.agg(F.sum(8 * F.greatest(F.size(vector_col), F.lit(1)).cast("long")).alias("bytes")).first()
        return max(1, -(-(row["bytes"] or 0) // size))

    blocks, sheets = parts(vectors, CANDIDATE_BYTES), parts(queries, QUERY_BYTES)
    candidates = clean(vectors)
    dealt = candidates.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long"))).withColumn("qb", F.explode(F.expr(f"sequence(0L, {sheets - 1}L)")))
    asked = with_floor(clean(queries), candidates, k, scale).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(sheets).cast("long"))).withColumn("cb", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    found = dealt.groupBy("d", "cb", "qb").cogroup(asked.groupBy("d", "cb", "qb")).applyInPandas(_search_block(k, scale), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_query(spark, sf_dir):
    """The contract's rows: ids divisible by 50 against all of embeddings."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


OP1_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
