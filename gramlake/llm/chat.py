"""Chat formatting with multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that participant as the
assistant and all others as named users; the loss mask covers what the assistant says. Rendering
is done in pieces of a bounded number of turns (turn numbers divided by ``span``), spread over tasks;
then the pieces of a conversation are joined in order, with one mask. A row holds a whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.llm.common import text_or_empty

#: The markers of the rendered format.
START, END = "<|im_start|>", "<|im_end|>\n"
NAMELESS = "unknown"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", narrators: tuple[str, ...] = ("system",), span: int = 64) -> DataFrame:
    """One row per conversation and participant: conv_id, perspective, n_turns, rendered, mask.

    mask: [start, stop) character ranges of rendered that are learnt, the text and end marker of
    each turn of the perspective's speaker. Narrators (system) are rendered as themselves from
    every perspective and have none of their own; a conversation of narrators alone has no rows.
    Turns are in order of number (null last), then speaker, then text. A null speaker is a participant named "unknown", a null text is empty, a null
    conversation is one conversation of its own. Markers inside texts lose their bar ("<|" becomes
    "< |"), so that no text can end its turn. Repeated rows are repeated turns. Other columns are
    not read; an empty table gives an empty result.
    """
    said = F.replace(text_or_empty(text_col), F.lit("<|"), F.lit("< |"))
    who = F.coalesce(F.col(speaker_col).cast("string"), F.lit(NAMELESS))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.replace(who, F.lit("<|"), F.lit("< |")).alias("who"), said.alias("said"))
    rows = rows.groupBy("conv", "turn", "who", "said").agg(F.count("*").cast("int").alias("times"))  # repeats are combined before the shuffle
    tells = F.col("who").isin(*narrators)
    people = rows.filter(~tells).select(F.col("conv").alias("c"), F.col("who").alias("perspective")).distinct()
    pieces = rows.groupBy("conv", F.floor(F.col("turn") / span).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("turn", "who", "said", "times"))).alias("turns"))
    pieces = pieces.withColumn("turns", F.flatten(F.transform("turns", lambda t: F.array_repeat(F.struct(t["who"].alias("who"), t["said"].alias("said")), t["times"]))))
    seen = pieces.join(people, F.col("conv").eqNullSafe(F.col("c")))
    own = lambda t: t["who"] == F.col("perspective")
    head = lambda t: F.when(own(t), F.lit(START + "assistant\n")).when(t["who"].isin(*narrators), F.concat(F.lit(START), t["who"], F.lit("\n"))).otherwise(F.concat(F.lit(START + "user name="), t["who"], F.lit("\n")))
    seen = seen.withColumn("parts", F.transform("turns", lambda t: F.struct(own(t).alias("own"), head(t).alias("head"), F.concat(t["said"], F.lit(END)).alias("body"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("mask"))

    def step(acc, p):
        start = acc["at"] + F.length(p["head"])
        stop = start + F.length(p["body"])
        return F.struct(stop.alias("at"), F.when(p["own"], F.concat(acc["mask"], F.array(F.struct(start.alias("start"), stop.alias("stop"))))).otherwise(acc["mask"]).alias("mask"))

    done = seen.select("conv", "perspective", F.col("piece").isNull().alias("last"), "piece", F.size("parts").alias("n"), F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"), F.aggregate("parts", zero, step).alias("end"))
    whole = done.groupBy("conv", "perspective").agg(F.sort_array(F.collect_list(F.struct("last", "piece", "n", "text", "end"))).alias("pieces"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,stop:int>>>").alias("masks"))

    def join(acc, p):
        moved = F.transform(p["end"]["mask"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["stop"] + acc["at"]).alias("stop")))
        return F.struct((acc["at"] + p["end"]["at"]).alias("at"), F.array_append(acc["masks"], moved).alias("masks"))

    return whole.select(
        F.col("conv").alias(conv_col), "perspective", F.aggregate("pieces", F.lit(0), lambda a, p: a + p["n"]).alias("n_turns"),
        F.array_join(F.col("pieces.text"), "").alias("rendered"), F.flatten(F.aggregate("pieces", begin, join)["masks"]).alias("mask"),
    )


def op9_query(spark, sf_dir):
    """Every conversation from every participant's perspective; the mask as its text "start-stop ..."."""
    out = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["stop"].cast("string"))), " ")
    return out.select("conv_id", "perspective", F.col("n_turns").cast("bigint").alias("n_turns"), "rendered", spans.alias("mask"))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS who, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who <> 'system'),
x AS (
  SELECT t.*, perspective,
    CASE WHEN who = perspective THEN '<|im_start|>assistant' || chr(10) WHEN who = 'system' THEN '<|im_start|>system' || chr(10)
         ELSE '<|im_start|>user name=' || who || chr(10) END AS head,
    said || '<|im_end|>' || chr(10) AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, who, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM x)
SELECT conv_id, perspective, count(*) AS n_turns, string_agg(head || body, '' ORDER BY turn, who, said) AS rendered,
  coalesce(string_agg(CASE WHEN who = perspective THEN CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(head) + length(body) AS BIGINT) AS VARCHAR) END, ' ' ORDER BY turn, who, said), '') AS mask
FROM y GROUP BY conv_id, perspective
"""
