"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every node draws -ln(u) / weight, with u from a hash of (key, node), and the least draw wins. A node's
weight is the sum of its shards' weights, and its draw depends on nothing else; so when weights change, keys move only into
or out of the subtrees whose weights did, and a shard that is added as a region of its own takes keys only into itself.

Slots are gapless in a shard: keys are dealt to blocks by hash, a small table of counts gives each block's first slot, and
rows are numbered inside their block. No task sees a whole shard.

Defined results: null keys draw like a key of their own; null text has 1 as its size and the crc32 of nothing; rows that
repeat go to one shard, each with its own slot; an empty table gives no rows. Everything is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, about.
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    number: int
    weight: float = 1.0


def layout(shards: int) -> tuple[Shard, ...]:
    """Two regions of two racks of two shards; each further shard is a region of its own."""
    return tuple(Shard(n // 4, n // 2, n) if n < 8 else Shard(n - 6, n - 4, n) for n in range(shards))


def _draw(key: Column, level: str, node: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level} {node}")), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(u) / weight


def _pick(key: Column, level: str, nodes: dict[int, tuple[float, Column]]) -> Column:
    """The value of the node that draws least; nodes: number -> weight and value."""
    draws = [F.struct(_draw(key, level, n, w).alias("d"), F.lit(n).alias("n"), value.alias("v")) for n, (w, value) in nodes.items() if w > 0]
    return F.least(*draws)["v"] if len(draws) > 1 else draws[0]["v"]


def shard_of(key: Column, shards: tuple[Shard, ...]) -> Column:
    regions: dict[int, dict[int, list[Shard]]] = {}
    for s in shards:
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    weigh = lambda own: sum(s.weight for s in own)
    top = {}
    for r, racks in regions.items():
        mid = {k: (weigh(own), _pick(key, "shard", {s.number: (s.weight, F.lit(s.number)) for s in own})) for k, own in racks.items()}
        top[r] = (sum(weigh(own) for own in racks.values()), _pick(key, "rack", mid))
    return _pick(key, "region", top)


def shard_documents(docs: DataFrame, shards: tuple[Shard, ...] | int = 8, grown: tuple[Shard, ...] | int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row of docs (doc_id, text)."""
    shards = layout(shards) if isinstance(shards, int) else shards
    grown = layout(len(shards) + 1) if grown is None else layout(grown) if isinstance(grown, int) else grown
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.col("doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumns({"shard": shard_of(key, shards), "grown_shard": shard_of(key, grown)})
    blocks = max(1, docs.count() // (BLOCK_ROWS * len(shards)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    rows = rows.withColumn("at", F.row_number().over(place)).join(first, ["shard", "block"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")
