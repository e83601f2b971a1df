"""Queries over choices of pools, transferability scores and evaluators."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from gramlake.operators import downstream as D
from gramlake.operators import gram as G
from gramlake.operators import pairs as P
from gramlake.operators import select as S
from gramlake.operators import spectral as SP
from gramlake.operators import statistics as ST
from gramlake.operators import synthetic as SY
from gramlake.operators import transfer as T
from gramlake.operators.blocks import BLOCK_BYTES, BlockRows
from gramlake.plans.fixtures import domains, pools, sql_folded, sql_pairs, sql_pools, sql_predict, sql_rank, summaries
from gramlake.plans.registry import query
from gramlake.plans.unary import R

_D2 = f"WITH {sql_pools()}, {sql_pairs()}"


def centroids(spark, sf, **kw):
    return G.pool_grams(pools(spark, sf, **kw)).select("pool_id", G.centroid().alias("centroid"))


def names_frame(spark, names):
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "round int, pool_id string")


@query("centroid_ff_k3", f"""WITH {sql_pools()}, c AS (SELECT pool, sx / sqrt(sx * sx + sy * sy) AS x, sy / sqrt(sx * sx + sy * sy) AS y FROM g),
m AS (SELECT avg(x) / sqrt(avg(x) * avg(x) + avg(y) * avg(y)) AS x, avg(y) / sqrt(avg(x) * avg(x) + avg(y) * avg(y)) AS y FROM c),
a AS (SELECT c.* FROM c, m ORDER BY round(sqrt(pow(c.x - m.x, 2) + pow(c.y - m.y, 2)), 9) DESC, pool LIMIT 1),
b AS (SELECT c.* FROM c, a WHERE c.pool <> a.pool ORDER BY round(sqrt(pow(c.x - a.x, 2) + pow(c.y - a.y, 2)), 9) DESC, c.pool LIMIT 1),
d AS (SELECT c.pool FROM c, a, b WHERE c.pool NOT IN (a.pool, b.pool) ORDER BY round(least(sqrt(pow(c.x - a.x, 2) + pow(c.y - a.y, 2)), sqrt(pow(c.x - b.x, 2) + pow(c.y - b.y, 2))), 9) DESC, c.pool LIMIT 1)
SELECT 1 AS round, pool AS pool_id FROM a UNION ALL SELECT 2, pool FROM b UNION ALL SELECT 3, pool FROM d""")
def centroid_ff_k3(spark, sf):
    return names_frame(spark, S.farthest_first(centroids(spark, sf, dims=2), 3))


@query("predictive_round_d2", f"""WITH {sql_pools()}, s AS (SELECT * FROM e ORDER BY round(r_eff, 9) DESC, pool LIMIT 1),
c AS (SELECT e.pool, s.r_eff AS r_cur, e.r_eff, e.nuclear / (s.nuclear + 1e-8) AS gam, cos(e.th - s.th) * cos(e.th - s.th) AS sa FROM e, s WHERE e.pool <> s.pool)
SELECT pool AS pool_id, round({sql_predict('r_cur', 'r_eff', 'gam', 'sa', 'selection')}, 6) AS score FROM c""")
def predictive_round_d2(spark, sf):
    """One round of the predictive greedy: scores of all candidates against the seed."""
    pools_ = S.Pools(summaries(spark, sf, dims=2))
    first = pools_.first("r_eff")
    scores = pools_.scores(pools_.state(first), [n for n in pools_.names if n != first], "prediction", 1)
    return spark.createDataFrame(list(scores.items()), "pool_id string, score double").withColumn("score", F.round("score", 6))


@query("vendi_round_d2", f"""WITH {sql_pools()}, s AS (SELECT * FROM e ORDER BY round(vendi, 9) DESC, pool LIMIT 1),
c AS (SELECT e.pool, e.a + s.a AS a, e.b + s.b AS b, e.c + s.c AS c FROM e, s WHERE e.pool <> s.pool), d AS (SELECT *, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l1, (a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l2 FROM c)
SELECT pool AS pool_id, round({sql_rank('l1', 'l2')}, 6) AS score FROM d""")
def vendi_round_d2(spark, sf):
    pools_ = S.Pools(summaries(spark, sf, dims=2))
    first = pools_.first("vendi")
    scores = pools_.scores(pools_.state(first), [n for n in pools_.names if n != first], "vendi", 1)
    return spark.createDataFrame(list(scores.items()), "pool_id string, score double").withColumn("score", F.round("score", 6))


@query("exhaustive_k2_d2", f"{_D2} SELECT ds_a || ',' || ds_b AS subset, round(r_merged, 6) AS r_eff FROM pr")
def exhaustive_k2_d2(spark, sf):
    return S.exhaustive(G.pool_grams(pools(spark, sf, dims=2)), 2).select(F.concat_ws(",", "subset").alias("subset"), R("r_eff"))


@query("best_subset_regret_d2", f"""{_D2}, three AS (SELECT x.pool AS p, y.pool AS q, z.pool AS r, x.a + y.a + z.a AS a, x.b + y.b + z.b AS b, x.c + y.c + z.c AS c FROM e x JOIN e y ON x.pool < y.pool JOIN e z ON y.pool < z.pool),
w AS (SELECT *, sqrt((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2) AS s1, sqrt(greatest((a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2, 0)) AS s2 FROM three),
v AS (SELECT p || ',' || q || ',' || r AS subset, {sql_rank('s1', 's2')} AS r_eff FROM w),
top AS (SELECT string_agg(pool, ',' ORDER BY pool) AS subset FROM (SELECT pool FROM e ORDER BY round(r_eff, 9) DESC, pool LIMIT 3))
SELECT round(max(v.r_eff), 6) AS best, round(max(CASE WHEN v.subset = top.subset THEN v.r_eff END), 6) AS chosen, round((max(v.r_eff) - max(CASE WHEN v.subset = top.subset THEN v.r_eff END)) / max(v.r_eff) * 100, 4) AS regret_pct FROM v, top""")
def best_subset_regret_d2(spark, sf):
    """SEL15: what the three pools of the largest ranks lose against the best of all subsets of three."""
    s = summaries(spark, sf, dims=2).persist()
    chosen = [r["pool_id"] for r in S.top_pools(s, 3).collect()]
    best = S.exhaustive(s, 3).first()["r_eff"]
    own = S.Pools(s).stack(chosen).rank
    s.unpersist()
    return spark.createDataFrame([(round(best, 6), round(own, 6), round(S.regret(best, own), 4))], "best double, chosen double, regret_pct double")


@query("retention_d2", f"""WITH {sql_pools()}, t AS (SELECT sum(a) AS a, sum(b) AS b, sum(c) AS c FROM g), f AS (SELECT *, sqrt((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2) AS s1, sqrt((a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2) AS s2 FROM t),
p AS (SELECT sum(g.a) AS a, sum(g.b) AS b, sum(g.c) AS c FROM g WHERE pool IN ('p0', 'p1', 'p2')), q AS (SELECT *, sqrt((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2) AS s1, sqrt((a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2) AS s2 FROM p)
SELECT round({sql_rank('q.s1', 'q.s2')} / {sql_rank('f.s1', 'f.s2')} * 100, 4) AS retention_pct FROM q, f""")
def retention_d2(spark, sf):
    r = S.retention(S.Pools(summaries(spark, sf, dims=2)), ["p0", "p1", "p2"])
    return spark.createDataFrame([(round(r, 4),)], "retention_pct double")


def _greedy_sql(score: str, rounds: int, start: str) -> str:
    """Rounds of a greedy at two dimensions and one direction, a chain of states (a, b, c, chosen pools)."""
    formula = {
        "prediction": sql_predict("s.r_eff", "e.r_eff", "(e.nuclear / (s.nuclear + 1e-8))", "(cos(e.th - s.th) * cos(e.th - s.th))", "selection"),
        "vendi": sql_rank("(e.a + s.a + e.c + s.c + sqrt(pow(e.a + s.a - e.c - s.c, 2) + 4 * pow(e.b + s.b, 2))) / 2", "(e.a + s.a + e.c + s.c - sqrt(pow(e.a + s.a - e.c - s.c, 2) + 4 * pow(e.b + s.b, 2))) / 2"),
        "direction": "1 - cos(e.th - s.th) * cos(e.th - s.th)",
    }[score]
    parts = [f"WITH {sql_pools()}", f"w1 AS ({start})"]
    for r in range(1, rounds + 1):
        parts.append(f"d{r} AS (SELECT *, sqrt((a - c) * (a - c) + 4 * b * b) AS dd FROM w{r})")
        parts.append(f"v{r} AS (SELECT *, sqrt((a + c + dd) / 2) AS s1, sqrt(greatest((a + c - dd) / 2, 0)) AS s2, 0.5 * atan2(2 * b, a - c) AS th FROM d{r})")
        parts.append(f"s{r} AS (SELECT *, s1 + s2 AS nuclear, {sql_rank('s1', 's2')} AS r_eff FROM v{r})")
        parts.append(f"p{r} AS (SELECT e.pool, e.a, e.b, e.c, {formula} AS score FROM e, s{r} s WHERE NOT list_contains(s.chosen, e.pool) ORDER BY round(score, 9) DESC, e.pool LIMIT 1)")
        parts.append(f"w{r + 1} AS (SELECT w.a + p.a AS a, w.b + p.b AS b, w.c + p.c AS c, list_append(w.chosen, p.pool) AS chosen FROM w{r} w, p{r} p)")
    return ", ".join(parts)


def _greedy_rounds(score: str, rounds: int, start: str, seeded: bool) -> str:
    sql = _greedy_sql(score, rounds, start)
    first = ["SELECT CAST(1 AS INTEGER) AS round, chosen[1] AS selected, CAST(NULL AS DOUBLE) AS score FROM w1"] if seeded else []
    return f"{sql} " + " UNION ALL ".join([*first, *(f"SELECT CAST({r + seeded} AS INTEGER) AS round, pool AS selected, round(score, 6) AS score FROM p{r}" for r in range(1, rounds + 1))])


def _scored(spark, rounds):
    """Rounds as (round, selected, score), without the scores of those that were not selected."""
    return S.rounds_frame(spark, rounds).select("round", "selected", F.round("score", 6).alias("score"))


_BEST = "SELECT a, b, c, [pool] AS chosen FROM e ORDER BY round({}, 9) DESC, pool LIMIT 1"


@query("merge_greedy_d2", _greedy_rounds("prediction", 4, _BEST.format("r_eff"), True))
def merge_greedy_d2(spark, sf):
    """SEL1 over all rounds at two dimensions."""
    return _scored(spark, S.greedy(S.Pools(summaries(spark, sf, dims=2)), 5, k_basis=1))


@query("vendi_greedy_d2", _greedy_rounds("vendi", 4, _BEST.format("vendi"), True))
def vendi_greedy_d2(spark, sf):
    return _scored(spark, S.greedy(S.Pools(summaries(spark, sf, dims=2)), 5, "vendi"))


@query("delta_dir_greedy_d2", _greedy_rounds("direction", 3, "SELECT a, b, c, [pool] AS chosen FROM e WHERE pool = 'p0'", True))
def delta_dir_greedy_d2(spark, sf):
    return _scored(spark, S.greedy(S.Pools(summaries(spark, sf, dims=2)), 4, "direction", 1, start=["p0"]))


@query("target_greedy_d2", _greedy_rounds("prediction", 3, "SELECT a, b, c, [pool] AS chosen FROM e WHERE pool = 'p0'", False))
def target_greedy_d2(spark, sf):
    """SEL1c: p0 is the target, not a candidate."""
    with G.held(summaries(spark, sf, dims=2)) as s:
        target = S.Pools(s.filter("pool_id = 'p0'")).state("p0")
        return _scored(spark, S.greedy(S.Pools(s.filter("pool_id <> 'p0'")), 3, k_basis=1, anchor=target))


@query("merge_greedy")
def merge_greedy(spark, sf):
    """SEL1 at full width: rounds with all scores."""
    return S.rounds_frame(spark, S.greedy(S.Pools(summaries(spark, sf)), 5))


@query("merge_greedy_distributed")
def merge_greedy_distributed(spark, sf):
    """SEL1 with candidates scored on the executors, as for summaries too large for the driver."""
    return S.rounds_frame(spark, S.greedy(S.Pools(summaries(spark, sf), local_bytes=0), 3))


@query("target_greedy")
def target_greedy(spark, sf):
    """SEL1c: conditioned on a target pool's summary."""
    with G.held(summaries(spark, sf)) as s:
        target = S.Pools(s.filter("pool_id = 'p0'")).state("p0")
        return S.rounds_frame(spark, S.greedy(S.Pools(s.filter("pool_id <> 'p0'")), 3, anchor=target))


@query("vendi_greedy")
def vendi_greedy(spark, sf):
    return S.rounds_frame(spark, S.greedy(S.Pools(summaries(spark, sf)), 5, "vendi"))


@query("delta_dir_greedy")
def delta_dir_greedy(spark, sf):
    return S.rounds_frame(spark, S.greedy(S.Pools(summaries(spark, sf)), 4, "direction", start=["p0"]))


@query("hybrid_col_cen")
def hybrid_col_cen(spark, sf):
    return _hybrid(spark, sf, lambda p, c: S.hybrid_predict_then_spread(p, c, 5))


@query("hybrid_cen_col")
def hybrid_cen_col(spark, sf):
    return _hybrid(spark, sf, lambda p, c: S.hybrid_spread_then_predict(p, c, 5))


@query("hybrid_col_dom")
def hybrid_col_dom(spark, sf):
    with G.held(summaries(spark, sf)) as s:
        return names_frame(spark, S.hybrid_predict_then_domains(S.Pools(s), s, domains(spark, sf), 5))


def _similarity(spark, sf, block_bytes=BLOCK_BYTES):
    with G.held(summaries(spark, sf)) as s:
        return BlockRows(P.symmetric(P.analyse(s, k=20), F.col("sa_k"), 1.0, "sa", s), value="sa", block_bytes=block_bytes)


def _chosen(spark, sf, choose, block_bytes=BLOCK_BYTES):
    matrix = _similarity(spark, sf, block_bytes)
    names = choose(matrix)
    matrix.release()
    return names_frame(spark, names)


@query("facility_location")
def facility_location(spark, sf):
    return _chosen(spark, sf, lambda m: S.facility_location(m, 3))


@query("k_medoids")
def k_medoids(spark, sf):
    return _chosen(spark, sf, lambda m: S.k_medoids(m, 3))


@query("clone_attack")
def clone_attack(spark, sf):
    """SEL16: five pools and five slightly turned clones; how many clones each strategy picks."""
    import numpy as np

    base = S.Pools(summaries(spark, sf).filter("pool_id in ('p0', 'p1', 'p2', 'p3', 'p4')"))
    rows = []
    for i, n in enumerate(base.names):
        st = base.state(n)
        for name, gram in ((n, st.gram), (f"{n}_clone", S.clone(st.gram, (0.01, 0.03, 0.05, 0.07, 0.1)[i], i))):
            rows.append(("emb", name, st.n, len(gram), gram.ravel().tolist(), np.zeros(len(gram)).tolist()))
    from gramlake.operators.spectral import summarise

    frame = summarise(spark.createDataFrame(rows, "probe string, pool_id string, n bigint, d int, gram array<double>, colsum array<double>"))
    p = S.Pools(frame)
    out = [("prediction", [r["selected"] for r in S.greedy(p, 3)]), ("max_rank", [r["pool_id"] for r in S.top_pools(frame, 3).collect()])]
    return spark.createDataFrame([(name, chosen, p.stack(chosen).rank) for name, chosen in out], "strategy string, selected array<string>, r_merged double")


@query("strategy_grid")
def strategy_grid(spark, sf):
    with G.held(summaries(spark, sf)) as s:
        return S.compare_strategies(spark, s, s.select("pool_id", G.centroid().alias("centroid")), domains(spark, sf), [3, 5], [1, 2, 3])


@query("strategy_targets")
def strategy_targets(spark, sf):
    """SEL19 with evaluators: what the linear probe and kNN of 5 learn about pool p3's classes from each
    strategy's three pools, and the seconds that the choice took."""
    f = pools(spark, sf).persist()
    test = f.filter("split = 'test' and pool_id = 'p3'")
    rest = f.filter("pool_id <> 'p3'")
    s = SP.summarise(G.pool_grams(rest)).persist()

    def evaluate(chosen):
        train = D.augmented(f.filter("split = 'train'"), "p3", chosen)
        st = D.scaling(train)
        probe, near = D.linear_probe(train, test, 100), D.knn_predict(D.scale(train, st), D.scale(test, st), 5)
        return D.accuracy(probe).first()["accuracy"], D.accuracy(near).first()["accuracy"]

    out = S.compare_strategies(spark, s, s.select("pool_id", G.centroid().alias("centroid")), domains(spark, sf), [3], [1, 2], evaluate)
    s.unpersist()
    f.unpersist()
    return out


def _hybrid(spark, sf, choose):
    """The choice of a hybrid strategy over summaries and the centroids that they hold."""
    with G.held(summaries(spark, sf)) as s:
        return names_frame(spark, choose(S.Pools(s), s.select("pool_id", G.centroid().alias("centroid"))))


# ---- evaluators ------------------------------------------------------------------------------

_ROWS = """r AS (SELECT vec_id, label % 4 AS y, [CAST(x AS DOUBLE) FOR x IN embedding] AS v, substr(md5(CAST(vec_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') AS test FROM embeddings),
n AS (SELECT vec_id, y, test, [x / greatest(sqrt(list_sum([z * z FOR z IN v])), 1e-10) FOR x IN v] AS v FROM r),
l AS (SELECT vec_id, y, test, unnest(v) AS x, unnest(range(64)) AS i FROM n),
m AS (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) > 1e-12 THEN stddev_pop(x) ELSE 1 END AS s FROM l WHERE NOT test GROUP BY i)"""


def sets(spark, sf):
    rows = pools(spark, sf, label=(F.col("label") % 4).cast("int"))
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


@query("standardize_pop", f"WITH {_ROWS} SELECT CAST(i AS INTEGER) AS i, round(m, 6) AS m, round(s, 6) AS s FROM m")
def standardize_pop(spark, sf):
    st = D.scaling(sets(spark, sf)[0])
    return st.select(F.posexplode(F.arrays_zip("mean", "std")).alias("i", "z")).select("i", R("m", F.col("z.mean")), R("s", F.col("z.std")))


_KNN = f"""WITH {_ROWS}, z AS (SELECT vec_id, y, test, list((x - m) / s ORDER BY i) AS v FROM l JOIN m USING (i) GROUP BY ALL),
d AS (SELECT q.vec_id, q.y AS label, t.y, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(sqrt(list_sum([pow(p[1] - p[2], 2) FOR p IN list_zip(q.v, t.v)])), 9), t.vec_id) AS rn FROM z q JOIN z t ON q.test AND NOT t.test),
c AS (SELECT vec_id, label, y, count(*) AS votes FROM d WHERE rn <= 5 GROUP BY ALL),
b AS (SELECT vec_id, label, y AS predicted FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, y) = 1)"""


def knn(spark, sf):
    train, test = sets(spark, sf)
    st = D.scaling(train)
    return D.knn_predict(D.scale(train, st), D.scale(test, st), 5)


@query("knn5_predictions", f"{_KNN} SELECT vec_id AS row_id, CAST(label AS INTEGER) AS label, CAST(predicted AS INTEGER) AS predicted FROM b")
def knn5_predictions(spark, sf):
    return knn(spark, sf)


@query("knn5_accuracy", f"{_KNN} SELECT count(*) AS n, round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM b")
def knn5_accuracy(spark, sf):
    return D.accuracy(knn(spark, sf)).select("n", R("accuracy"))


@query("target_aug_offsets", """WITH r AS (SELECT 'p' || label AS pool, vec_id, vec_id % 3 AS y FROM embeddings WHERE label IN (0, 3, 7)), o AS (SELECT *, CASE pool WHEN 'p3' THEN 1 WHEN 'p0' THEN 2 ELSE 3 END AS place, dense_rank() OVER (PARTITION BY pool ORDER BY y) - 1 AS dense FROM r),
k AS (SELECT place, max(dense) + 1 AS c FROM o GROUP BY 1), s AS (SELECT place, coalesce(sum(c) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM k)
SELECT pool AS pool_id, vec_id AS row_id, CAST(dense + shift AS INTEGER) AS label FROM o JOIN s USING (place)""")
def target_aug_offsets(spark, sf):
    return D.augmented(pools(spark, sf, dims=2), "p3", ["p0", "p3", "p7"]).select("pool_id", "row_id", "label")


@query("mean_over_targets", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS v_mean, count(o_totalprice) AS n_targets FROM orders GROUP BY 1")
def mean_over_targets(spark, sf):
    from gramlake.plans.fixtures import table

    return D.mean_over_targets(table(spark, sf, "orders").withColumnRenamed("o_totalprice", "v"), "v", ("o_orderpriority",)).withColumn("v_mean", F.round("v_mean", 4))


@query("linear_probe")
def linear_probe(spark, sf):
    train, test = sets(spark, sf)
    return D.accuracy(D.linear_probe(train, test))


@query("fair_lp")
def fair_lp(spark, sf):
    train, test = sets(spark, sf)
    return D.accuracy(D.fair_probe(pools(spark, sf), ["p0", "p1", "p2"], train, test))


@query("augmented_knn")
def augmented_knn(spark, sf):
    f = pools(spark, sf)
    train = D.augmented(f.filter("split = 'train'"), "p3", ["p0", "p7"])
    test = f.filter("split = 'test' and pool_id = 'p3'")
    st = D.scaling(train)
    return D.accuracy(D.knn_predict(D.scale(train, st), D.scale(test, st), 5))


@query("classical_mds")
def classical_mds(spark, sf):
    with G.held(summaries(spark, sf)) as s:
        return D.classical_mds(P.symmetric(P.analyse(s, k=20), 1 - F.col("sa_k"), 0.0, "distance", s))


@query("stress_mds")
def stress_mds(spark, sf):
    with G.held(summaries(spark, sf)) as s:
        return D.stress_mds(P.symmetric(P.analyse(s, k=20), 1 - F.col("sa_k"), 0.0, "distance", s))


#: Views of the vectors that stand for encoders: whole, and sums of runs or of every n-th component.
VIEWS = {"whole": {}, "runs16": {"dims": 16}, "strides16": {"dims": 16, "strides": True}, "runs8": {"dims": 8}}


#: Sets of classes of the same vectors.
CLASSES = {"label_mod4": lambda: (F.col("label") % 4).cast("int"), "label_half": lambda: (F.col("label") >= 5).cast("int")}


def evaluated(spark, sf, view: str) -> list[tuple]:
    """(view, dataset, rank, linear probe, kNN of 5, kNN of 20) of each set of classes.

    The rank, the scaling and the neighbours don't depend on classes, and the 5 nearest are among the 20:
    a view's neighbours are looked for once.
    """
    raw = pools(spark, sf, label=F.col("label"), pool=F.lit("all"), **VIEWS[view])
    f = raw.select("*", *(y().alias(name) for name, y in CLASSES.items())).drop("label").persist()
    train, test = f.filter("split = 'train'"), f.filter("split = 'test'")
    st = D.scaling(train)
    near = D.train_neighbours(D.scale(train, st), D.scale(test, st), 20, labels=tuple(CLASSES)).persist()
    rank = SP.summarise(G.pool_grams(f)).first()["r_eff"]
    out = []
    for name in CLASSES:
        knn = [D.accuracy(D.knn_vote(few, test, name)).first()["accuracy"] for few in (D.nearer(near, 5), near)]
        own = [df.withColumn("label", F.col(name)) for df in (train, test)]
        out.append((view, name, rank, D.accuracy(D.linear_probe(*own)).first()["accuracy"], *knn))
    near.unpersist()
    f.unpersist()
    return out


@query("evaluator_correlations")
def evaluator_correlations(spark, sf):
    """ST20 over real evaluators: rank, linear probe and two kNN of four views on two sets of classes.
    The fits don't depend on each other, so their jobs run side by side."""
    with ThreadPool(len(VIEWS)) as pool:
        found = pool.starmap(inheritable_thread_target(spark)(evaluated), [(spark, sf, view) for view in VIEWS])
    results = spark.createDataFrame([r for rows in found for r in rows], "probe string, dataset string, r_eff double, lp double, knn5 double, knn20 double")
    return ST.evaluator_correlations(results, ["r_eff", "lp", "knn5", "knn20"])


# ---- transferability ------------------------------------------------------------------------


def labelled(spark, sf, dims):
    """Three pools by id, classes by label."""
    return pools(spark, sf, dims=dims, pool=F.concat(F.lit("h"), (F.col("vec_id") % 3).cast("string")), label=F.col("label"))


_CLASSES = f"""raw AS (SELECT 'h' || (vec_id % 3) AS pool, label, {sql_folded(0)} AS x0, {sql_folded(1)} AS y0 FROM embeddings),
u AS (SELECT pool, label, x0 / greatest(sqrt(x0 * x0 + y0 * y0), 1e-10) AS x, y0 / greatest(sqrt(x0 * x0 + y0 * y0), 1e-10) AS y FROM raw),
k AS (SELECT pool, label, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c FROM u GROUP BY ALL),
t AS (SELECT pool, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM k GROUP BY pool)"""


@query("hscore_d2", f"""WITH {_CLASSES}, w AS (SELECT pool, sum(CASE WHEN n > 1 THEN a - sx * sx / n ELSE 0 END) AS a, sum(CASE WHEN n > 1 THEN b - sx * sy / n ELSE 0 END) AS b, sum(CASE WHEN n > 1 THEN c - sy * sy / n ELSE 0 END) AS c FROM k GROUP BY pool),
s AS (SELECT k.pool, sum(k.n * pow(k.sx / k.n - t.sx / t.n, 2)) AS a, sum(k.n * (k.sx / k.n - t.sx / t.n) * (k.sy / k.n - t.sy / t.n)) AS b, sum(k.n * pow(k.sy / k.n - t.sy / t.n, 2)) AS c FROM k JOIN t USING (pool) GROUP BY k.pool),
z AS (SELECT pool, w.a / t.n + 1e-4 AS wa, w.b / t.n AS wb, w.c / t.n + 1e-4 AS wc, s.a / t.n AS ba, s.b / t.n AS bb, s.c / t.n AS bc FROM w JOIN s USING (pool) JOIN t USING (pool))
SELECT pool AS pool_id, round((wc * ba - 2 * wb * bb + wa * bc) / (wa * wc - wb * wb), 6) AS hscore FROM z""")
def hscore_d2(spark, sf):
    return T.transferability(labelled(spark, sf, 2)).select("pool_id", R("hscore"))


def _rate(a, b, c, n):
    """Half the sum of ln(1 + 2 / 0.25 * eigenvalue of G / n) = half the ln of a 2 x 2 determinant."""
    return f"0.5 * ln((1 + 8 * {a} / {n}) * (1 + 8 * {c} / {n}) - 64 * {b} * {b} / {n} / {n})"


@query("transrate_d2", f"WITH {_CLASSES} SELECT t.pool AS pool_id, round(max({_rate('t.a', 't.b', 't.c', 't.n')}) - sum(CASE WHEN k.n > 1 THEN k.n / t.n * {_rate('k.a', 'k.b', 'k.c', 'k.n')} ELSE 0 END), 6) AS transrate FROM k JOIN t USING (pool) GROUP BY t.pool")
def transrate_d2(spark, sf):
    return T.transferability(labelled(spark, sf, 2)).select("pool_id", R("transrate"))


@query("transfer_bundle")
def transfer_bundle(spark, sf):
    return T.transferability(labelled(spark, sf, 64))


# ---- synthetic grids --------------------------------------------------------------------------


@query("synthetic_grid")
def synthetic_grid(spark, sf):
    """GEN3: prediction against measurement where the truth is controlled; one row."""
    return ST.grid_summary(SY.grid(spark, *SY.MINI), "r_merged", "r_pred", "is_superadditive")


@query("synthetic_grid_full")
def synthetic_grid_full(spark, sf):
    """GEN2: the same over all 280 settings."""
    return ST.grid_summary(SY.grid(spark, *SY.FULL), "r_merged", "r_pred", "is_superadditive")


@query("best_subset_regret")
def best_subset_regret(spark, sf):
    """SEL15: what each strategy's three pools lose against the best three of all, in percent, and how many
    of the best it picks."""
    s = summaries(spark, sf).persist()
    best = S.exhaustive(s.select("pool_id", "n", "gram", "colsum"), 3).first()
    p = S.Pools(s)
    c = S.local_centroids(s.select("pool_id", G.centroid().alias("centroid")))
    picks = {"prediction": [r["selected"] for r in S.greedy(p, 3)], "vendi": [r["selected"] for r in S.greedy(p, 3, "vendi")], "farthest_first": S.farthest_first(c, 3), "max_rank": sorted(p.names, key=lambda n: (-round(p.light[n]["r_eff"], 9), n))[:3]}
    rows = [(name, chosen, S.regret(best["r_eff"], p.stack(chosen).rank), len(set(chosen) & set(best["subset"])) / 3) for name, chosen in picks.items()]
    s.unpersist()
    return spark.createDataFrame(rows, "strategy string, selected array<string>, regret_pct double, recall double")


@query("regime_guide", """WITH m AS (SELECT 'labels' AS pools, count(DISTINCT label) AS m FROM embeddings UNION ALL SELECT 'sources', count(DISTINCT source) FROM documents UNION ALL SELECT 'unknown', 0)
SELECT pools, CAST(k AS INTEGER) AS k, CAST(m AS INTEGER) AS m, CASE WHEN m = 0 THEN 'hybrid_spread_then_predict' WHEN k <= 0.2 * m THEN 'prediction' ELSE 'farthest_first' END AS strategy FROM m, range(1, 11) a(k)""")
def regime_guide(spark, sf):
    """SEL17 for budgets up to ten of the pools that labels or sources make; 0 stands for an unknown number."""
    from gramlake.plans.fixtures import table

    counts = {"labels": table(spark, sf, "embeddings").select("label").distinct().count(), "sources": table(spark, sf, "documents").select("source").distinct().count(), "unknown": 0}
    return spark.createDataFrame([(name, k, m, S.recommend(k, m or None)) for name, m in counts.items() for k in range(1, 11)], "pools string, k int, m int, strategy string")


@query("synthetic_generators")
def synthetic_generators(spark, sf):
    """GEN4: the same over generators whose angles aren't equal."""
    out = None
    for mode in ("shared", "spread", "noise"):
        one = SY.grid(spark, (0.2, 0.6), (0.5, 2.0), 1, 128, 16, 200, mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out
