"""Summaries over tables and batches. All of them combine on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.operators.filters import SUMMARY_ORDER, LogFilter, top


def transaction_summary(logs: DataFrame) -> DataFrame:
    """Lowest block and number of logs per transaction."""
    return logs.groupBy(*S.TX_KEY).agg(
        F.min("block_number").alias("block_number"), F.count("*").alias("log_count")
    )


def top_transaction_summary(logs: DataFrame, wanted: LogFilter) -> DataFrame:
    return top(transaction_summary(wanted.apply(logs)), SUMMARY_ORDER, wanted.limit)


def block_range(blocks: DataFrame, chain_id: int | None = None) -> DataFrame:
    """One row: min_block, max_block (0 when there are none) and has_blocks."""
    if chain_id is not None:
        blocks = blocks.where(F.col("chain_id") == chain_id)
    low, high = F.min("block_number"), F.max("block_number")
    return blocks.agg(
        F.coalesce(low, F.lit(0)).alias("min_block"),
        F.coalesce(high, F.lit(0)).alias("max_block"),
        high.isNotNull().alias("has_blocks"),
    )


def batch_max_block(messages: DataFrame) -> DataFrame:
    """Highest block per chain of a batch; a chain that only reached block 0 has no row."""
    return (
        messages.groupBy("chain_id")
        .agg(F.max("block_number").alias("max_block"))
        .where(F.col("max_block") > 0)
    )


def offset_range(messages: DataFrame) -> DataFrame:
    """First and last offset per partition number."""
    return messages.groupBy("partition").agg(
        F.min("offset").alias("min_offset"), F.max("offset").alias("max_offset")
    )


def batch_counts(messages: DataFrame) -> DataFrame:
    """Rows a flush writes, by kind."""
    kind = F.col("kind")
    return messages.agg(
        F.count("*").alias("messages"),
        F.count_if(kind == S.LOG).alias("logs"),
        F.count_if(kind == S.BLOCK).alias("blocks"),
        F.count_if(kind == S.TRANSACTION).alias("transactions"),
        F.count_if(kind == S.RECEIPT).alias("receipts"),
    )


def transactions_per_block(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy(*S.BLOCK_KEY).agg(F.count("*").alias("tx_count"))


def last_processed(state: DataFrame, chain_ids: list[int]) -> DataFrame:
    """Highest watermark over the configured chains; 0 when none has one."""
    wanted = state.where(F.col("chain_id").isin(*chain_ids))
    return wanted.agg(
        F.coalesce(F.max("last_processed_block"), F.lit(0)).alias("last_processed_block")
    )
