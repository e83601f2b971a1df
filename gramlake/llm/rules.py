"""Quality rules with thresholds that the data set, in DataFrame operations only.

A fixed cutoff that suits one source cuts into another: tables of formulas have symbols, minutes
have repeated lines. So each measure of a document is compared with what is usual in its language
and source. What is usual comes from a quantile sketch: counts of values rounded down to seven
significant bits (an error below 1/64 of the value), a histogram whose buckets are the same
everywhere. Sketches are rows (group, measure, bucket, count) and merge by adding counts, so each
partition sums its own before the shuffle, no group is ever gathered, a source's sketches add up to
its language's, and the order of merging doesn't matter.

The threshold of a measure is median + reach * (median - lower quartile) + slack. Only the lower
half counts, as bad documents lie above: up to half of a group may be bad before its threshold
moves with them. Groups with fewer than ``least`` documents take the sketch of their language, and
small languages that of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlake.llm.common import SPACE, stash, text_or_empty

SYMBOLS = r"[#*$%&|<>]"
#: Significant bits of a sketch's buckets.
BITS = 7
#: Measures with their slack: parts of a million, for word_length thousandths of a character.
SLACK = {"symbols": 20_000, "capitals": 60_000, "exclaims": 20_000, "dup_lines": 400_000, "repeats": 400_000, "word_length": 1_000}


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Number of words in three-word windows that occur twice or more among words.

    Rows whose windows all differ by hash are done; for the others the windows themselves are
    sorted, neighbours compared, and the places of equal ones counted once for each word.
    """

    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def named(w):
        gram = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), gram))

    def again(s):
        same = lambda x, k: F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(at):
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    differ = let(windows(words), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when((F.size(words) < 4) | differ, F.lit(0).cast("bigint")).otherwise(covered(let(named(words), again)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id, lang, source, n_words, counts of the rules, and the measures as integers."""
    text = F.col("text")
    table = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text_or_empty(text_col).alias("text"))
    table = table.withColumn("words", F.array_remove(F.split(text, SPACE), ""))
    table = table.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    table = table.select(
        "id", "lang", "source", F.size("words").cast("bigint").alias("n_words"), F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"), F.regexp_count(text, F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"), F.regexp_count(text, F.lit("!")).cast("bigint").alias("n_exclaims"),
        F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    of = lambda part, whole, scale=1_000_000: F.expr(f"({part} * {scale}) div greatest({whole}, 1)")
    measures = {
        "symbols": of("n_symbols", "word_chars"), "capitals": of("n_capitals", "word_chars"), "exclaims": of("n_exclaims", "word_chars"),
        "dup_lines": of("n_dup_lines", "n_lines"), "repeats": of("n_repeat_words", "n_words"), "word_length": of("word_chars", "n_words", 1000),
    }
    return table.select("id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(v.alias(k) for k, v in measures.items()))


def bucket(value: Column, bits: int = BITS) -> Column:
    """A whole number of 0 or more, rounded down to so many significant bits."""
    low = F.greatest(F.length(F.bin(value)) - bits, F.lit(0))
    return value - value % F.call_function("shiftleft", F.lit(1).cast("bigint"), low)


def sketches(table: DataFrame, measures: list[str]) -> DataFrame:
    """(lang, source, measure, bucket, n): the quantile sketch of each measure in each group."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in measures)))
    return table.select("lang", "source", each.alias("x")).select("lang", "source", "x.*").groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups: the sums of their parts'."""
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure, rows, q25, q50): the lowest buckets with a quarter and half of a sketch's rows up to them."""
    own = Window.partitionBy(*by, "measure")
    upto = F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = sketch.withColumn("upto", upto).withColumn("rows", F.sum("n").over(own))
    reached = lambda share: F.min(F.when(F.col("upto") * 100 >= F.col("rows") * share, F.col("bucket")))
    return at.groupBy(*by, "measure").agg(F.max("rows").alias("rows"), reached(25).alias("q25"), reached(50).alias("q50"))


def thresholds(sketch: DataFrame, slack: dict[str, int], reach: int, least: int) -> DataFrame:
    """(lang, source, limits): for each group the limit of each measure, from the finest sketch with enough rows."""
    limit = lambda k: F.when(F.col("rows") >= least, F.col("q50") + reach * (F.col("q50") - F.col("q25"))).alias(k)
    own = quantiles(sketch, ["lang", "source"]).select("lang", "source", "measure", limit("own"))
    lang = quantiles(merged(sketch, ["lang"]), ["lang"]).select(F.col("lang").alias("lang2"), F.col("measure").alias("measure2"), limit("of_lang"))
    every = quantiles(merged(sketch, []), []).select(F.col("measure").alias("measure3"), (F.col("q50") + reach * (F.col("q50") - F.col("q25"))).alias("of_all"))
    table = own.join(lang, F.col("lang").eqNullSafe(F.col("lang2")) & (F.col("measure") == F.col("measure2"))).join(every, F.col("measure") == F.col("measure3"))
    bound = F.coalesce("own", "of_lang", "of_all")
    return table.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, bound + extra)).alias(f"most_{m}") for m, extra in slack.items()))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", slack: dict[str, int] | None = None, reach: int = 8, least: int = 200, words: int = 50, repeats: int = 50) -> DataFrame:
    """One row per row of docs: id, lang, source, the counts, base_failed, kept, the measures and their limits.

    base_failed: fewer than ``words`` words, or more than ``repeats`` of a hundred words in repeated
    three-word windows. kept: not base_failed, and no measure above its group's limit. Thresholds are
    set by all documents, those that fail included.

    A null text counts as empty and fails; null languages and sources are groups of their own, and null
    ids are kept. Repeated rows count and are judged as often as they come. A text of one long
    word has no windows; long texts are whole. Other columns are not read; an empty table gives an empty result.
    """
    slack = SLACK if slack is None else slack
    table = stash(measured(docs, id_col, text_col, lang_col, source_col), "measures")
    sketch = stash(sketches(table, list(slack)), "sketch")
    # a table of its own: Spark knows its size, and sends it to all tasks only if it is small
    limits = stash(thresholds(sketch, slack, reach, least).withColumnRenamed("lang", "l").withColumnRenamed("source", "s"), "limits")
    out = table.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")))
    failed = (F.col("n_words") < words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeats)
    usual = F.lit(True)
    for m in slack:
        usual = usual & (F.col(m) <= F.col(f"most_{m}"))
    return out.select(F.col("id").alias(id_col), "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & usual).alias("kept"), *slack, *(f"most_{m}" for m in slack))


def op13_query(spark, sf_dir):
    """The contract's rows over all of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_MEASURES = ", ".join(f"('{m}', {m}, {extra})" for m, extra in SLACK.items())
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
     w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
     g AS (SELECT rid, unnest(range(len(words) - 2)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda k : words[k] || ' ' || words[k + 1] || ' ' || words[k + 2])) AS gram FROM w WHERE len(words) >= 3),
     twice AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
     r AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
     c AS (SELECT rid, doc_id, lang, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x : length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(text, '!')) AS n_exclaims,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
           FROM w LEFT JOIN r USING (rid)),
     m AS (SELECT *, n_symbols * 1000000 // greatest(word_chars, 1) AS symbols, n_capitals * 1000000 // greatest(word_chars, 1) AS capitals, n_exclaims * 1000000 // greatest(word_chars, 1) AS exclaims,
             n_dup_lines * 1000000 // greatest(n_lines, 1) AS dup_lines, n_repeat_words * 1000000 // greatest(n_words, 1) AS repeats, word_chars * 1000 // greatest(n_words, 1) AS word_length FROM c),
     x AS (SELECT rid, lang, source, v.* FROM m, LATERAL (VALUES {_MEASURES}) v(measure, value, slack)),
     b AS (SELECT *, value - value % (1::BIGINT << greatest(length(bin(value)) - {BITS}, 0)) AS bucket FROM x),
     s AS (SELECT DISTINCT lang, source, measure, slack,
             count(*) OVER own AS n1, count(*) OVER of_lang AS n2,
             quantile_disc(bucket, 0.25) OVER own AS a1, quantile_disc(bucket, 0.5) OVER own AS m1,
             quantile_disc(bucket, 0.25) OVER of_lang AS a2, quantile_disc(bucket, 0.5) OVER of_lang AS m2,
             quantile_disc(bucket, 0.25) OVER every AS a3, quantile_disc(bucket, 0.5) OVER every AS m3
           FROM b WINDOW own AS (PARTITION BY lang, source, measure), of_lang AS (PARTITION BY lang, measure), every AS (PARTITION BY measure)),
     t AS (SELECT lang, source, measure, slack + CASE WHEN n1 >= 200 THEN m1 + 8 * (m1 - a1) WHEN n2 >= 200 THEN m2 + 8 * (m2 - a2) ELSE m3 + 8 * (m3 - a3) END AS most FROM s),
     bad AS (SELECT DISTINCT rid FROM x JOIN t ON x.lang IS NOT DISTINCT FROM t.lang AND x.source IS NOT DISTINCT FROM t.source AND x.measure = t.measure WHERE value > most),
     f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM f
"""
