"""Confirmed ingest: which range of each chain to take next, and whether it is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import completeness as C
from ledgerloom.operators import messages as M


def next_ranges(
    heads: DataFrame,
    state: DataFrame,
    start_block: int = 0,
    confirmations: int = 0,
    batch_size: int = 1000,
    strict: bool = False,
) -> DataFrame:
    """(chain_id, from_block, to_block) per chain with confirmed blocks to take.

    ``heads`` holds (chain_id, latest_block). The confirmed head is latest - confirmations;
    while a chain is shorter than that it is block 0, or nothing with ``strict``.
    """
    if strict:
        heads = heads.where(F.col("latest_block") >= confirmations)
    first = F.coalesce(F.col("last_processed_block") + 1, F.lit(start_block).cast("bigint"))
    return (
        heads.join(state, "chain_id", "left")
        .select(
            "chain_id",
            first.alias("from_block"),
            F.greatest(F.col("latest_block") - confirmations, F.lit(0)).alias("head"),
        )
        .where(F.col("from_block") <= F.col("head"))
        .select(
            "chain_id",
            "from_block",
            F.least(F.col("from_block") + (batch_size - 1), F.col("head")).alias("to_block"),
        )
    )


def in_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows inside the range of their chain. ``ranges`` has one row per chain, so it is sent to the rows.

    Dealt by chain, whole tables would be shuffled and sorted in as many tasks as there are chains.
    """
    r = ranges.alias("r")
    m = rows.alias("m")
    return m.join(
        F.broadcast(r),
        (F.col("m.chain_id") == F.col("r.chain_id"))
        & (F.col("m.block_number") >= F.col("r.from_block"))
        & (F.col("m.block_number") <= F.col("r.to_block")),
        "left_semi",
    )


def available(
    ranges: DataFrame, blocks: DataFrame, transactions: DataFrame, receipts: DataFrame
) -> DataFrame:
    """Ranges whose blocks are all there with all receipts; the others wait for the next run."""
    whole = C.complete_blocks(
        in_ranges(blocks, ranges), in_ranges(transactions, ranges), in_ranges(receipts, ranges)
    )
    waiting = C.coverage_gaps(ranges, whole).select("chain_id").distinct()
    return ranges.join(waiting, "chain_id", "left_anti")


def publish(
    blocks: DataFrame,
    transactions: DataFrame,
    receipts: DataFrame,
    logs: DataFrame,
    prefix: str,
) -> DataFrame:
    """(topic, key, value) messages ordered per topic: block, its transactions, receipts, logs."""
    place = ["block_number", "_rank", "_position"]

    def ranked(df: DataFrame, rank: int, position) -> DataFrame:
        return df.withColumn("_rank", F.lit(rank)).withColumn("_position", position)

    merged = (
        M.encode_blocks(ranked(blocks, 0, F.lit(0).cast("bigint")), prefix, *place)
        .unionByName(M.encode_transactions(ranked(transactions, 1, F.col("tx_index")), prefix, *place))
        .unionByName(M.encode_receipts(ranked(receipts, 2, F.col("tx_index")), prefix, *place))
        .unionByName(M.encode_logs(ranked(logs, 3, F.col("log_index")), prefix, *place))
    )
    return merged.repartitionByRange("topic", *place).sortWithinPartitions("topic", *place).drop(*place)
