"""Which blocks are whole, and which are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.sources.tables import sort_for_ingest

# Blocks enumerated per row when a planned range is expanded.
RANGE_CHUNK = 4096


def with_receipts(transactions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Every transaction beside its receipt; both keys are unique, so nothing is skewed."""
    outcome = receipts.select(
        *S.TX_KEY, "status", "gas_used", "cumulative_gas_used", "contract_address", "effective_gas_price"
    )
    return transactions.join(outcome, S.TX_KEY)


def without_receipt(transactions: DataFrame, receipts: DataFrame) -> DataFrame:
    return transactions.join(receipts.select(*S.TX_KEY), S.TX_KEY, "left_anti")


def incomplete_blocks(transactions: DataFrame, receipts: DataFrame) -> DataFrame:
    """(chain_id, block_number, missing) of blocks with a transaction lacking its receipt."""
    return (
        without_receipt(transactions, receipts)
        .groupBy(*S.BLOCK_KEY)
        .agg(F.count("*").alias("missing"))
    )


def complete_blocks(blocks: DataFrame, transactions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Blocks whose ``tx_count`` transactions have all landed, each with its receipt.

    Transactions count for the block version they came with: those of another hash at the same
    number belong to a fork. The counts are reduced per block before they meet the blocks.
    """
    version = [*S.BLOCK_KEY, "block_hash"]
    outcomes = receipts.select(*S.TX_KEY, F.lit(True).alias("_done"))
    landed = (
        transactions.select(*S.TX_KEY, "block_number", "block_hash")
        .join(outcomes, S.TX_KEY, "left")
        .groupBy(*version)
        .agg(F.count("*").alias("_landed"), F.count("_done").alias("_with_receipt"))
    )
    expected = F.coalesce("tx_count", F.lit(0))
    return (
        blocks.join(landed, version, "left")
        .where(F.coalesce("_landed", F.lit(0)) == expected)
        .where(F.coalesce("_with_receipt", F.lit(0)) == expected)
        .select(*blocks.columns)
    )


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """(chain_id, block_number) of planned ranges (chain_id, from_block, to_block).

    Two steps, so that no row ever holds more than ``RANGE_CHUNK`` numbers and a long
    range spreads over tasks in between.
    """
    starts = ranges.where(F.col("from_block") <= F.col("to_block")).select(
        "chain_id",
        "to_block",
        F.explode(F.expr(f"sequence(from_block, to_block, {RANGE_CHUNK}L)")).alias("start"),
    )
    return starts.repartition("chain_id", "start").select(
        "chain_id",
        F.explode(
            F.expr(f"sequence(start, least(start + {RANGE_CHUNK - 1}L, to_block))")
        ).alias("block_number"),
    )


def coverage_gaps(ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of the planned ranges that are not stored."""
    return expand_ranges(ranges).join(blocks.select(*S.BLOCK_KEY), S.BLOCK_KEY, "left_anti")


def merge_chunks(chunks: list[DataFrame], position: str = "log_index") -> DataFrame:
    """Chunk results as one frame in ingest order."""
    merged = chunks[0]
    for chunk in chunks[1:]:
        merged = merged.unionByName(chunk)
    return sort_for_ingest(merged, position)
