"""The additive summary of a pool: n, Gram matrix and column sums (SP1, PW22).

Every partition folds its rows into one partial Gram for each key it meets, cut into tiles of rows of
``TILE_BYTES``. A partition that holds more than ``HELD_BYTES`` of them passes them on and begins
again, so its memory doesn't grow with the number of pools. Tiles are added up by key and tile in as
many levels as the number of partitions asks for, each sum a stream over its partials; the last
level puts a key's tiles together. Rows never cross the network. Gram matrices add under stacking,
which makes merging pools a sum of summaries.

Pools with no more rows than dimensions have the smaller Gram on the other side: row_kernels() gives
the products of rows, whose eigenvalues are the same but for zeros. r_factors() keeps what squaring
loses, the singular values under the square root of the rounding error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partials that one task of a level adds up, and the bytes of a tile and of what a partition holds.
FAN = 64
TILE_BYTES = 4 << 20
HELD_BYTES = 256 << 20
#: Bytes of Gram matrices in a partition of held().
PART_BYTES = 1 << 20
#: Bytes of rows in a block of row_kernels().
BLOCK_BYTES = 16 << 20
NAMES = ["probe", "pool_id"]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a dense matrix; all rows must be as long as the first."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_key(batch: pa.RecordBatch, keys: list[str]):
    """(values of the keys, rows of features) for each distinct key of a batch."""
    x = _matrix(batch.column("features"))
    if not keys:
        yield (), x
        return
    table = pa.Table.from_batches([batch])
    groups = table.select(keys).group_by(keys).aggregate([]).to_pylist()
    index = {tuple(g.values()): i for i, g in enumerate(groups)}
    codes = np.array([index[t] for t in zip(*(table.column(k).to_pylist() for k in keys), strict=True)])
    for values, i in index.items():
        yield values, x[codes == i]


def _kinds(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{k}` {kinds[k]}, " for k in keys)


def tile_rows(d: int, tile_bytes: int) -> int:
    """Rows of a d x d matrix in a tile."""
    return max(1, min(d, tile_bytes // (8 * d)))


def _fold(keys: list[str], tile_bytes: int, held_bytes: int):
    def run(batches):
        parts: dict = {}
        held, kinds = 0, []

        def passed_on():
            for values, (n, gram, colsum) in parts.items():
                d = len(colsum)
                step = tile_rows(d, tile_bytes)
                for at in range(0, d, step):
                    first = at == 0
                    columns = [*([v] for v in values), [at], [n if first else 0], [d], [gram[at : at + step].ravel()], [colsum if first else []]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, *KIND], strict=True)], names=[*keys, *PART])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(k).type for k in keys]
            for values, rows in _by_key(batch, keys):
                if values not in parts:
                    d = rows.shape[1]
                    if parts and held + 8 * d * d > held_bytes:
                        yield from passed_on()
                        parts, held = {}, 0
                    parts[values] = [0, np.zeros((d, d)), np.zeros(d)]
                    held += 8 * d * d
                part = parts[values]
                part[0] += len(rows)
                part[1] += rows.T @ rows
                part[2] += rows.sum(0)
        yield from passed_on()

    return run


PART = ["tile", "n", "d", "part", "colsum"]
KIND = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
PART_SCHEMA = "tile int, n bigint, d int, part array<double>, colsum array<double>"


def _added(keys: list[str], whole: bool):
    """Sum of a stream of partial tiles: of one tile, or (whole) of all tiles of a key, put together."""
    names = [*keys, "n", "gram", "colsum"] if whole else [*keys, *PART]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, d, tile, total, colsum, first = 0, 0, 0, None, None, None
        for batch in batches:
            if first is None:
                first = batch.slice(0, 1)
                d, tile = first.column("d")[0].as_py(), first.column("tile")[0].as_py()
                colsum = np.zeros(d)
                total = np.zeros(d * d if whole else len(first.column("part")[0]))
            n += sum(batch.column("n").to_pylist())
            for at, part, sums in zip(batch.column("tile").to_pylist(), batch.column("part"), batch.column("colsum"), strict=True):
                values = part.values.to_numpy(zero_copy_only=False)
                begin = at * d if whole else 0
                total[begin : begin + len(values)] += values
                if len(sums):
                    colsum += sums.values.to_numpy(zero_copy_only=False)
        own = [first.column(k) for k in keys]
        many = pa.list_(pa.float64())
        if whole:
            yield pa.RecordBatch.from_arrays([*own, pa.array([n], pa.int64()), pa.array([total], many), pa.array([colsum], many)], names=names)
        else:
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([v], t) for v, t in zip((tile, n, d, total, colsum if tile == 0 else []), KIND, strict=True))], names=names)

    return run


def levels(df: DataFrame, fan: int) -> int:
    """Levels of sums of fan partials for the partitions that a plan may have: as many as its files or
    its shuffles give, by the optimizer's estimate of bytes."""
    conf = df.sparkSession.conf
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    per_file = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    # plans that aren't estimated claim nearly all bytes there can be
    scans = -(-size // per_file) if size < 1 << 60 else 1
    partitions = max(int(conf.get("spark.sql.shuffle.partitions")), scans, 1)
    return max(1, math.ceil(math.log(partitions, fan) - 1e-9))


def in_levels(partials: DataFrame, keys: list[str], add, schema: str, depth: int, fan: int = FAN) -> DataFrame:
    """partials (keys and schema's columns) of a partition each, combined by keys in levels of fan.

    add(names) gives the function that combines a stream of rows which agree in names, the first columns.
    """
    kinds = _kinds(partials, keys)
    level = partials.withColumn("slot", F.spark_partition_id())
    for _ in range(depth - 1):
        level = level.withColumn("slot", F.floor(F.col("slot") / fan).cast("int"))
        level = level.groupBy(*keys, "slot").applyInArrow(add([*keys, "slot"]), f"{kinds}slot int, {schema}")
    return level.drop("slot").groupBy(*keys).applyInArrow(add(keys), kinds + schema)


def sum_tiles(partials: DataFrame, keys: list[str], depth: int = 1, fan: int = FAN) -> DataFrame:
    """(keys, tile, n, d, part, colsum) rows added up by keys: (keys, n, gram, colsum). tile is a tile's first row."""
    kinds = _kinds(partials, keys)
    level = partials.withColumn("slot", F.spark_partition_id())
    for _ in range(depth - 1):
        level = level.withColumn("slot", F.floor(F.col("slot") / fan).cast("int"))
        added = level.groupBy(*keys, "tile", "slot").applyInArrow(_added([*keys, "slot"], whole=False), f"{kinds}slot int, {PART_SCHEMA}")
        level = added
    return level.drop("slot").groupBy(*keys).applyInArrow(_added(keys, whole=True), f"{kinds}n bigint, gram array<double>, colsum array<double>")


def sum_grams(partials: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, gram, colsum) rows added up by keys, each row a Gram as a whole."""
    tiles = partials.select(*keys, F.lit(0).alias("tile"), "n", F.size("colsum").alias("d"), F.col("gram").alias("part"), "colsum")
    return sum_tiles(tiles, keys, levels(partials, FAN))


def pool_grams(features: DataFrame, keys: list[str] | None = None, tile_bytes: int = TILE_BYTES, held_bytes: int = HELD_BYTES, fan: int = FAN) -> DataFrame:
    """(keys, n, d, gram, colsum) of each group of feature rows; gram is d x d, row-major.

    Rows without features are left out.
    """
    keys = NAMES if keys is None else keys
    rows = features.filter(F.col("features").isNotNull()).select(*keys, "features")
    partials = rows.mapInArrow(_fold(keys, tile_bytes, held_bytes), _kinds(features, keys) + PART_SCHEMA)
    return sum_tiles(partials, keys, levels(rows, fan), fan).withColumn("d", F.size("colsum"))


@contextmanager
def held(grams: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[DataFrame]:
    """grams or summaries, computed once and kept on the executors for a with block, in as many partitions
    as their bytes ask for.

    A cached plan's last shuffle keeps all its partitions, each of which would begin Python workers for a
    few pools or none. With one more exchange that shuffle is merged by size, and so is what is kept.
    """
    own = grams.hint("rebalance").persist()
    try:
        size = own.agg(F.sum(8 * F.size("gram").cast("long"))).first()[0] or 0
        yield own.coalesce(max(1, -(-size // part_bytes)))
    finally:
        own.unpersist()


def row_kernels(features: DataFrame, keys: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """SP1 from the other side: (keys, n, d, gram, colsum), where gram is the n x n products of a pool's
    rows in order of row_id.

    For pools with no more rows than dimensions. A pool's rows are cut into blocks of block_bytes; each
    pair of blocks is one product, so a task holds two blocks, and d never squares.
    """
    keys = NAMES if keys is None else keys
    kinds = _kinds(features, keys)
    rows = features.filter(F.col("features").isNotNull()).select(*keys, "row_id", "features")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d"))
    per = F.greatest(F.lit(1), F.floor(F.lit(block_bytes) / (F.col("d") * 8)))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / per).cast("int"))
    own = [F.col(k).alias(f"__{k}") for k in keys]
    on = [rows[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
    dealt = rows.join(sizes.select(*own, "n", "blocks"), on).drop(*(f"__{k}" for k in keys)).withColumn("own", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("i"), F.greatest(b, F.col("own")).alias("j")))
    meet = dealt.select(*keys, "n", "row_id", "features", "own", F.explode(pair).alias("pair")).select(*keys, "n", "row_id", "features", "own", "pair.*")

    def products(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        at = table.column("own").to_numpy()
        ids, x = table.column("row_id").to_numpy(), _matrix(table.column("features"))
        left, right = at == i, at == j
        out = {k: pa.chunked_array([table.column(k).combine_chunks().slice(0, 1)]) for k in [*keys, "n"]}
        many, whole = pa.list_(pa.float64()), pa.list_(pa.int64())
        colsum = x.sum(0) if i == j else np.zeros(0)
        return pa.table(out | {"rows": pa.array([ids[left]], whole), "cols": pa.array([ids[right]], whole), "part": pa.array([(x[left] @ x[right].T).ravel()], many), "colsum": pa.array([colsum], many)})

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, colsum = [], None, None
        for batch in batches:
            first = batch.slice(0, 1) if first is None else first
            for a, b, part, sums in zip(*(batch.column(c) for c in ("rows", "cols", "part", "colsum")), strict=True):
                a, b, part, sums = (v.values.to_numpy(zero_copy_only=False) for v in (a, b, part, sums))
                held.append((a, b, part.reshape(len(a), len(b))))
                if len(sums):
                    colsum = sums if colsum is None else colsum + sums
        order = np.sort(np.concatenate([a for a, b, _ in held if len(a) == len(b) and (a == b).all()]))
        gram = np.zeros((len(order), len(order)))
        for a, b, part in held:
            a, b = np.searchsorted(order, a), np.searchsorted(order, b)
            gram[np.ix_(a, b)] = part
            gram[np.ix_(b, a)] = part.T
        yield pa.RecordBatch.from_arrays([*(first.column(k) for k in [*keys, "n"]), pa.array([gram.ravel()], pa.list_(pa.float64())), pa.array([colsum], pa.list_(pa.float64()))], names=[*keys, "n", "gram", "colsum"])

    parts = meet.groupBy(*keys, "i", "j").applyInArrow(products, kinds + "n bigint, rows array<bigint>, cols array<bigint>, part array<double>, colsum array<double>")
    return parts.groupBy(*keys).applyInArrow(together, kinds + "n bigint, gram array<double>, colsum array<double>").withColumn("d", F.size("colsum"))


def r_factors(features: DataFrame, keys: list[str] | None = None, held_bytes: int = HELD_BYTES, fan: int = FAN) -> DataFrame:
    """(keys, n, d, r): the triangular factor of each pool's rows, row-major, of min(n, d) rows or fewer.

    Its singular values are those of the rows, also the small ones that a Gram matrix loses. Rows are
    factored where they lie, factors of a key are stacked and factored again in levels.
    """
    keys = NAMES if keys is None else keys
    kinds = _kinds(features, keys)
    rows = features.filter(F.col("features").isNotNull()).select(*keys, "features")
    schema = pa.schema([("n", pa.int64()), ("d", pa.int32()), ("r", pa.list_(pa.float64()))])
    text = "n bigint, d int, r array<double>"

    def row(own, names, n, d, r):
        return pa.RecordBatch.from_arrays([*own, *(pa.array([v], f.type) for v, f in zip((n, d, r.ravel()), schema, strict=True))], names=[*names, "n", "d", "r"])

    def run(batches):
        parts, held, types = {}, 0, []

        def passed_on():
            for values, (n, r) in parts.items():
                yield row([pa.array([v], t) for v, t in zip(values, types, strict=True)], keys, n, r.shape[1], r)

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(k).type for k in keys]
            for values, x in _by_key(batch, keys):
                if values not in parts and parts and held + 8 * x.shape[1] ** 2 > held_bytes:
                    yield from passed_on()
                    parts, held = {}, 0
                if values not in parts:
                    held += 8 * x.shape[1] ** 2
                    parts[values] = [0, np.zeros((0, x.shape[1]))]
                parts[values][0] += len(x)
                parts[values][1] = np.linalg.qr(np.vstack((parts[values][1], x)), mode="r")
        yield from passed_on()

    def stacked(names):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, first = 0, None, None
            for batch in batches:
                first = batch.slice(0, 1) if first is None else first
                d = batch.column("d")[0].as_py()
                n += sum(batch.column("n").to_pylist())
                for r in batch.column("r"):
                    r = r.values.to_numpy(zero_copy_only=False).reshape(-1, d)
                    total = r if total is None else np.linalg.qr(np.vstack((total, r)), mode="r")
            yield row([first.column(k) for k in names], names, n, total.shape[1], total)

        return add

    return in_levels(rows.mapInArrow(run, kinds + text), keys, stacked, text, levels(rows, fan), fan)


def add_columns(a, b):
    """Element-wise sum of two packed arrays: the Gram of stacked pools, without moving a row."""
    return F.zip_with(a, b, lambda x, y: x + y)


def gram_entries(grams: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, g): packed Grams as entries."""
    keys = ["probe", "pool_id"] if keys is None else keys
    return grams.select(*keys, "d", F.posexplode("gram").alias("at", "g")).select(*keys, F.floor(F.col("at") / F.col("d")).cast("int").alias("i"), (F.col("at") % F.col("d")).cast("int").alias("j"), "g")


def centroid(colsum="colsum", n="n"):
    """SP9: the mean row, at unit length."""
    from gramlake.functions import vectors as V

    return V.unit(F.transform(F.col(colsum), lambda v: v / F.col(n)))


def mean_squares(grams: DataFrame) -> DataFrame:
    """SP10 as a column `profile`: mean of squares by dimension, the Gram's diagonal over n."""
    diagonal = F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda i: F.element_at("gram", (i * (F.col("d") + 1) + 1).cast("int")) / F.col("n"))
    return grams.withColumn("profile", diagonal)
