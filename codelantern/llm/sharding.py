"""Balanced shards: contiguous runs of documents of nearly the same size.

The order is fixed by hashes of text and id.  It is cut into blocks, whose
totals give each block its global start; a sum inside the block gives each
document its place on the line from zero to the total size, and equal cuts of
the line are the shards.  Texts themselves do not move.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelantern.operators.sizing import durable


@dataclass(frozen=True)
class Shards:
    count: int = 40
    row_bytes: int = 16       #: added to the bytes of each text
    slack: float = 0.01       #: share of a shard up to which equal texts stay together
    blocks: int = 1024        #: blocks that the order is cut into, besides one for each large group of equal texts


def shard_by_size(docs: DataFrame, spec: Shards = Shards(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row; slots count from 0 in each shard.

    A null text has no bytes and the checksum of an empty one.  A document lies
    in the shard that holds the middle of its stretch; equal texts that together
    stay under the slack lie where the middle of the group does, larger groups are
    dealt out like single documents.  Repeated rows are rows of their own, null
    ids come first where hashes are equal.  An empty table gives an empty result.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + spec.row_bytes).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        F.xxhash64(F.col(id_col).cast("long"), F.lit("shard")).alias("id_hash"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    # A group above the slack is cut into as many blocks as its share of all bytes asks for.
    large = (
        rows.groupBy("text_hash").agg(F.sum("size").alias("all")).where(F.col("all") > spec.slack * total / spec.count)
        .select("text_hash", F.ceil(F.col("all") * spec.blocks / max(total, 1)).alias("deals"))
    )
    blocked = rows.join(F.broadcast(large), "text_hash", "left").select(
        "id", "size", "text_crc32", "text_hash", "id_hash",
        F.struct(
            F.pmod("text_hash", F.lit(spec.blocks)).alias("part"), F.when(F.col("deals").isNotNull(), F.col("text_hash")).alias("large"),
            F.pmod("id_hash", "deals").alias("deal")).alias("block"))
    blocked = durable(blocked)
    totals = blocked.groupBy("block").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    # One row per block: at most 2 * blocks + count / slack of them, whatever the table's size.
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("block").orderBy("text_hash", "id_hash", "id", "size", "text_crc32")
    group = Window.partitionBy("block", "text_hash")
    placed = (
        blocked.withColumn("rank", F.row_number().over(inside))
        .withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("group_end", F.when(F.col("block.large").isNull(), F.max("end").over(group)).otherwise(F.col("end")))
        .withColumn("group_size", F.when(F.col("block.large").isNull(), F.sum("size").over(group)).otherwise(F.col("size")))
        .join(F.broadcast(starts), "block")
        .withColumn("middle", F.col("size_before") + F.col("group_end") - F.col("group_size") / 2)
        .withColumn("shard", F.least(F.lit(spec.count - 1), F.floor(F.col("middle") * spec.count / F.lit(max(total, 1)))).cast("int"))
        .select("id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("rank") - 1).alias("at"))
    )
    placed = durable(placed)
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))
