"""Compare a query with its SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    def value(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        return None if v is None or v is pd.NA or v != v else float(f"{v:.9g}") if isinstance(v, float) else v

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(value, r))) for r in df.itertuples(index=False))


def check(spark, sf, fn, sql):
    got, want = fn(spark, sf).toPandas(), connect(sf).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
