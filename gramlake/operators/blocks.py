"""A matrix of pools by pools in blocks of rows, which stay on the executors.

Rounds of iterative methods broadcast what they need of the last one (a few numbers for each pool),
visit every block, and bring back a sum over blocks or a few numbers for each row. So the driver holds
the pools' names and vectors over pools, never the matrix, and a task holds one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.operators.gram import in_levels, levels

BLOCK_BYTES = 16 << 20
_MANY = pa.list_(pa.float64())


class BlockRows:
    """Values of a long matrix (i, j, value); absent cells are 0. Its rows and columns are in order of name."""

    def __init__(self, long: DataFrame, i: str = "ds_i", j: str = "ds_j", value: str = "value", block_bytes: int = BLOCK_BYTES):
        self.spark, self.evaluations = long.sparkSession, 0
        cells = long.select(F.col(i).alias("i"), F.col(j).alias("j"), F.col(value).cast("double").alias("v")).hint("rebalance").persist()
        both = cells.select(F.col("i").alias("name")).union(cells.select("j")).distinct()
        self.names = sorted(r["name"] for r in both.collect())
        m = len(self.names)
        self.per_block = max(1, block_bytes // (8 * max(m, 1)))
        self.blocks = -(-m // self.per_block)
        index = self.spark.createDataFrame([(n, k) for k, n in enumerate(self.names)], "name string, at int")
        at = cells.join(index.select(F.col("name").alias("i"), F.col("at").alias("row")), "i").join(index.select(F.col("name").alias("j"), F.col("at").alias("col")), "j")
        at = at.select(F.floor(F.col("row") / self.per_block).cast("int").alias("block"), "row", "col", "v")
        per_block = self.per_block

        def dense(table: pa.Table) -> pa.Table:
            block = table.column("block")[0].as_py()
            first = block * per_block
            values = np.zeros((min(per_block, m - first), m))
            values[table.column("row").to_numpy() - first, table.column("col").to_numpy()] = table.column("v").to_numpy()
            return pa.table({"first": pa.array([first], pa.int32()), "values": pa.array([values.ravel()], _MANY)})

        # as many partitions as blocks: those without one would begin Python workers, too
        self.frame = at.repartition(max(1, self.blocks), "block").groupBy("block").applyInArrow(dense, "first int, values array<double>").persist()
        self.frame.count()
        cells.unpersist()

    def release(self) -> None:
        self.frame.unpersist()

    def _visited(self, fn: Callable, shared):
        """Batches of (first row, fn's array) for each block."""
        sent = self.spark.sparkContext.broadcast(shared)
        m = len(self.names)

        def run(batches):
            for batch in batches:
                for first, values in zip(batch.column("first").to_pylist(), batch.column("values"), strict=True):
                    out = fn(first, values.values.to_numpy(zero_copy_only=False).reshape(-1, m), sent.value)
                    yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([np.ravel(out)], _MANY)], names=["first", "out"])

        return self.frame.mapInArrow(run, "first int, out array<double>")

    def total(self, fn: Callable, shared) -> np.ndarray:
        """Sum over blocks of fn(first row, block, shared), flat."""

        def add(names):
            def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out, first = None, None
                for batch in batches:
                    first = batch.slice(0, 1) if first is None else first
                    for part in batch.column("out"):
                        part = part.values.to_numpy(zero_copy_only=False)
                        out = part if out is None else out + part
                yield pa.RecordBatch.from_arrays([*(first.column(n) for n in names), pa.array([out], _MANY)], names=[*names, "out"])

            return together

        parts = self._visited(fn, shared).drop("first")
        return np.array(in_levels(parts, [], add, "out array<double>", levels(self.frame, 64)).first()["out"])

    def rows(self, fn: Callable, shared) -> list[tuple[int, np.ndarray]]:
        """(first row, fn(first row, block, shared), flat) of all blocks, by first row."""
        return sorted(((r["first"], np.array(r["out"])) for r in self._visited(fn, shared).collect()), key=lambda r: r[0])

    def times(self, x: np.ndarray, change: Callable = lambda v: v) -> np.ndarray:
        """change(matrix) @ x, for a vector x over pools."""
        return np.concatenate([v for _, v in self.rows(lambda _, d, y: change(d) @ y, x)])
