"""Chat formatting with cumulative-snapshot collapse.

A log that saves a conversation after every turn holds each conversation many times, as prefixes of its last state. Every
turn gets two rolling hashes of the conversation up to it (running sums of hashes of place, role and text, 128 bits
together). A conversation whose last hash is another one's hash at an earlier turn is a prefix of it; an anti-join
removes it. Of equal conversations the smallest conv_id stays. What is left is rendered.

Defined results: rows without a conv_id belong to no conversation and are left out; turns are ordered by turn, role and text
(nulls first), so ties and repeated turns have one order; null role renders as an empty role and null text as empty text,
but neither equals an empty string; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "idx", F.col("role").isNull(), "role", F.col("text").isNull(), "text").cast("decimal(38,0)")


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, idx (from 1), total, h1, h2, role, text: each turn with the hashes of the conversation up to it."""
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    rows = rows.withColumn("idx", F.row_number().over(w))
    upto = Window.partitionBy("conv_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    # a turn is the last one when nothing follows it: no count over the whole conversation is held
    last = F.lead("idx").over(Window.partitionBy("conv_id").orderBy("idx")).isNull()
    return rows.select("conv_id", "idx", last.alias("last"), F.sum(_hash(1)).over(upto).alias("h1"), F.sum(_hash(2)).over(upto).alias("h2"), "role", "text")


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no prefix of another; copies are logs of the same conversation."""
    key = ["idx", "h1", "h2"]
    rows = prefixes(conversations).select("conv_id", "last", *key)
    whole = rows.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    part = rows.where("NOT last").select(*key).distinct()
    return whole.join(part, key, "left_anti").select("conv_id", F.col("idx").cast("long").alias("n_turns"), "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: the maximal conversations in ChatML."""
    keep = maximal(conversations)
    turns = prefixes(conversations).select("conv_id", "idx", F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE)).alias("piece"))
    # a rendered conversation is one value, so its turns have to meet
    text = turns.join(keep.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(idx, piece))), x -> x.piece)"), "").alias("rendered"))
    return keep.join(text, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")
