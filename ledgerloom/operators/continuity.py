"""Whether blocks follow one another and running gas sums add up, without a window over a whole chain or block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINK_WIDTH = 4096
GAS_WIDTH = 1024


def parent_links(blocks: DataFrame, width: int = LINK_WIDTH) -> DataFrame:
    """(chain_id, block_number, linked): whether a block's parent hash is the hash of the block below it.

    NULL where that block is not stored or a hash is NULL. Blocks are checked in ranges of ``width``; the last block of a
    range is handed to the next range too, so one shuffle serves and no task holds more than a range of a chain. Hashes are
    compared without case. One row per block is expected; among several of one number the order is by hash.
    """
    last = F.expr(f"block_number % {width} = {width - 1}")
    own = F.expr(f"block_number div {width}")
    spread = blocks.select(
        "chain_id", "block_number", F.lower("block_hash").alias("hash"), F.lower("parent_hash").alias("parent"), own.alias("_own"),
        F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))).alias("_range"),
    )
    below = F.lag(F.struct("block_number", "hash")).over(Window.partitionBy("chain_id", "_range").orderBy("block_number", "hash"))
    linked = F.when(F.col("_below.block_number") == F.col("block_number") - 1, F.col("_below.hash") == F.col("parent"))
    return spread.withColumn("_below", below).where("_range = _own").select("chain_id", "block_number", linked.alias("linked"))


def cumulative_gas(receipts: DataFrame, width: int = GAS_WIDTH) -> DataFrame:
    """Receipts with the sum of ``gas_used`` up to them in their block, and whether they state it.

    Sums run within stretches of ``width`` transactions; sums of the stretches below, a row each, are joined in, so a block
    with very many receipts is split over tasks. Receipts of one block with the same ``tx_index`` get the same sum. A
    NULL gas counts as 0 in the sums; ``agrees`` is NULL where the receipt states none.
    """
    block = ["chain_id", "block_number"]
    rows = receipts.select(*block, "tx_index", "tx_hash", "gas_used", "cumulative_gas_used", F.expr(f"tx_index div {width}").alias("_stretch"))
    before = Window.partitionBy(*block).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    below = (
        rows.groupBy(*block, "_stretch").agg(F.sum("gas_used").alias("_sum"))
        .withColumn("_below", F.sum("_sum").over(before))
        .where("_below > 0").select(*block, "_stretch", "_below")
    )
    inside = F.sum("gas_used").over(Window.partitionBy(*block, "_stretch").orderBy("tx_index"))
    total = F.coalesce("_inside", F.lit(0)) + F.coalesce("_below", F.lit(0))
    return (
        rows.withColumn("_inside", inside)
        .join(below, [*block, "_stretch"], "left")
        .withColumn("gas_sum", total.cast("bigint"))
        .select(*block, "tx_index", "tx_hash", "gas_sum", (F.col("gas_sum") == F.col("cumulative_gas_used")).alias("agrees"))
    )
