"""Writers of feature and result tables (SNK1-SNK6). Numbers only; figures are out of scope, their
data are tables (gramlake.operators.statistics.plot_grid and friends)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK1: Parquet, partitioned by probe and pool, so that later scans read the pools asked for.
    Rows are brought together by pool, but adaptive execution splits a pool too large for a task."""
    df.hint("rebalance", "probe", "pool_id").write.mode(mode).partitionBy("probe", "pool_id").parquet(path)


def _flat(df: DataFrame) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("array<string"):
            c = F.concat_ws("|", c)
        elif kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        out.append(c.alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single: bool = True) -> None:
    """SNK2: CSV with a header; lists of strings joined by "|", other nested values as JSON.

    single suits result tables of a few rows; for large ones leave the partitions as they are.
    """
    (_flat(df).coalesce(1) if single else _flat(df)).write.mode(mode).csv(path, header=True)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK3: one JSON object a line."""
    df.write.mode(mode).json(path)


def write_text(df: DataFrame, path: str, template: str, mode: str = "overwrite") -> None:
    """SNK4: a line for each row by a printf template over its columns."""
    df.select(F.format_string(template, *df.columns).alias("value")).write.mode(mode).text(path)


def skip_existing(df: DataFrame, path: str) -> None:
    """SNK6: write unless the target exists."""
    df.write.mode("ignore").parquet(path)
