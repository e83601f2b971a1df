"""The corpus pipeline: quality filter, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of documents.
"""

from pyspark.sql import functions as F

from gramlake.llm import exact_dedup, mixing, paragraphs, pieces, quality, simhash
from gramlake.llm.common import keep_rows, stash

SCORE = "__quality_score"


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier scores 0.7 or more stay."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    others = tuple(c for c in docs.columns if c != "doc_id")
    return quality.score(docs, model, keep=others, name=SCORE).filter(F.col(SCORE) >= 0.7).select(*docs.columns)


def exact_stage(spark, docs, sf_dir):
    """Of documents with equal normalised texts the one with the smallest id stays."""
    return keep_rows(docs, exact_dedup.exact_dedup(docs).filter("kept"))


def near_stage(spark, docs, sf_dir):
    """A document stays if it is the first of its group by SimHash and by shingle similarity.

    SimHash groups fingerprints of five-word shingles within two bits. They don't reach down to a
    similarity of 0.8, where fingerprints differ in some ten bits, so most near copies go by the
    second grouping: MinHash bands over the same shingles, verified by exact Jaccard similarity of
    0.8 or more. Both look at all documents of the stage.
    """
    one, two = (df.filter("kept").select(F.col("doc_id").alias(f"i{k}"), F.col("h1").alias(f"a{k}"), F.col("h2").alias(f"b{k}")) for k, df in enumerate((simhash.simhash_dedup(docs), paragraphs.similar_documents(docs))))
    both = one.join(two, F.col("i0").eqNullSafe(F.col("i1")) & (F.col("a0") == F.col("a1")) & (F.col("b0") == F.col("b1")), "left_semi")
    return keep_rows(docs, both.select(F.col("i0").alias("doc_id"), F.col("a0").alias("h1"), F.col("b0").alias("h2")))


def mixing_stage(spark, docs, sf_dir):
    """Each source is taken to its target: whole epochs, then a sample. The stage is native, and no column
    may be added on the way to it, so the weight is mix()'s own and not the classifier's score."""
    return mixing.repeat_rows(docs, mixing.mix(docs))


def encoding_stage(spark, docs, sf_dir):
    """Every document of the mix as SentencePiece ids."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]
#: The classifier, the automaton and the fingerprints have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, name.replace(" ", "-"))
    return docs
