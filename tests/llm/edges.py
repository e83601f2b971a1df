"""Small tables with nulls, empties, repeats, long texts and clashing column names."""

import numpy as np

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40000))
#: Columns that operators use inside, as columns of the input.
CLASH = ["id", "h1", "h2", "b", "score", "fp", "kept", "size", "target", "taken", "rid", "name", "bands", "v", "n", "key", "root", "first"]


def words(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghij"), r.integers(2, 9))) for _ in range(n))


def texts():
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    passage = words(2, 70)
    return [
        (0, base, "en", "s1"),
        (1, "  ".join(base.split()), "en", "s1"),
        (2, " ".join(near), "en", "s2"),
        (3, "", "en", "s1"),
        (4, None, None, None),
        (5, "x", "en", None),
        (5, "x", "en", None),
        (6, "a\tb\n\nc", "de", "s2"),
        (7, "a b c", "de", "s2"),
        (None, "no id here", "de", "s3"),
        (None, None, None, None),
        (8, LONG, "en", "s3"),
        (9, words(3, 40) + "\n" + passage + "\n" + words(4, 30), "en", "s3"),
        (10, words(5, 35) + "\n" + passage, "en", "s4"),
        (11, words(6, 90) + " " + passage + " " + words(7, 60), "en", "s4"),
        (12, "ÄÖÜ grün ▁ \0 日本語 " + words(8, 9), "de", "s5"),
        (13, base.upper(), "en", "s5"),
        (14, " \n\t ", "en", "s1"),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


def clashing(df):
    from pyspark.sql import functions as F

    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def write(spark, path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
