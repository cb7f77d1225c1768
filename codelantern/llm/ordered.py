"""Rows dealt out in a global order, each block of them with the row that follows it."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks at most; beyond it blocks grow, and each is still sorted and read as a stream.
MAX_BLOCKS = 10_000


def descending_blocks(df: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """``(block, guest, id, text)``: whole blocks in one partition, sorted by descending id, null ids last.

    Cuts are approximate quantiles of the ids, so a block has about
    ``block_bytes`` of text whatever the ids are.  The first row of each
    non-empty block comes a second time, as the ``guest`` at the end of the block
    before it (the very first row: at the end of the last block), so neighbours
    are always in one place.  Rows that share an id are ordered by their text,
    null first.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n, nbytes = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if not n:
        return rows.select(F.lit(0).alias("block"), F.lit(False).alias("guest"), "id", "text")
    blocks = min(MAX_BLOCKS, n, max(1, ceil((nbytes or 0) / block_bytes)))
    shares = [i / blocks for i in range(1, blocks)]
    cuts = rows.agg(F.percentile_approx("id", F.array(*map(F.lit, shares)) if shares else F.lit(0.5), 10 * blocks)).first()[0]
    cuts = np.unique(np.array(cuts if shares and cuts else [], np.int64))

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, ids.to_numpy(), side="right"), dtype="int32")

    # A nullable column would reach pandas as doubles, which do not hold every id.
    block = F.when(F.col("id").isNull(), F.lit(len(cuts))).otherwise(block_of(F.coalesce("id", F.lit(0))))
    placed = rows.withColumn("block", block)
    heads = sorted((r.block, r.head) for r in placed.groupBy("block").agg(F.max("id").alias("head")).collect())
    before = [heads[-1][0], *(block for block, _ in heads[:-1])]
    guests = df.sparkSession.createDataFrame(
        [(block, head, to) for (block, head), to in zip(heads, before, strict=True)],
        "block int, head long, to_block int")
    dealt = placed.join(F.broadcast(guests), "block").select(
        F.explode(F.when(F.col("id").eqNullSafe(F.col("head")), F.array(
            F.struct("block", F.lit(False).alias("guest")), F.struct(F.col("to_block").alias("block"), F.lit(True).alias("guest"))
        )).otherwise(F.array(F.struct("block", F.lit(False).alias("guest"))))).alias("at"), "id", "text")
    return (
        dealt.select("at.block", "at.guest", "id", "text").repartition(len(heads), "block")
        .sortWithinPartitions("block", "guest", F.col("id").desc_nulls_last(), F.col("text").asc_nulls_first())
    )
