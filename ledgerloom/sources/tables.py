"""Parquet tables laid out by chain and block range.

Files are range-partitioned and sorted by (chain, block, position), so a busy chain is
spread over many writers and min/max statistics skip row groups. ``block_bucket`` is a
partition column derived from the block number; readers turn a block range into a bucket
range, which prunes directories.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BUCKET = 100_000


def with_bucket(df: DataFrame, width: int = BLOCK_BUCKET) -> DataFrame:
    return df.withColumn("block_bucket", F.expr(f"block_number div {width}"))


def fitting_width(height: int, least: int = BLOCK_BUCKET, folders: int = 32) -> int:
    """Width of buckets for a chain of so many blocks: ``least``, doubled until ``folders`` buckets hold them.

    What writers create, readers list and the driver plans counts folders, so their number must not grow with the chain.
    A table keeps the width it was made with.
    """
    width = least
    while height >= width * folders:
        width *= 2
    return width


def sort_for_ingest(df: DataFrame, position: str, partitions: int | None = None) -> DataFrame:
    """Total order within a chain: range partitions, each sorted.

    The position is part of the range key, so even a third of all rows in one block
    splits over several tasks.
    """
    return _spread(df, position, partitions).sortWithinPartitions("chain_id", "block_number", position)


def _spread(df: DataFrame, position: str, partitions: int | None) -> DataFrame:
    order = ["chain_id", "block_number", position]
    return df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)


def append(
    df: DataFrame,
    path: str,
    position: str,
    width: int = BLOCK_BUCKET,
    partitions: int | None = None,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Append rows to a table; nothing is deduplicated.

    ``finish`` makes the table's columns from rows that are already in place: what it makes is neither shuffled nor sorted.
    It is a projection that keeps ``chain_id`` and ``block_bucket``; rows are sorted by these first, as the writer asks.
    """
    order = ["chain_id", "block_bucket", "block_number", position]
    spread = with_bucket(_spread(df, position, partitions), width).sortWithinPartitions(*order)
    (
        (finish(spread) if finish else spread)
        .write.mode("append")
        .partitionBy("chain_id", "block_bucket")
        .parquet(path)
    )


def bucket_bounds(from_block: int | None, to_block: int | None, width: int = BLOCK_BUCKET) -> list[Column]:
    """Bounds on the bucket that a block range implies; as partition filters they prune directories."""
    found = []
    if from_block is not None:
        found.append(F.col("block_bucket") >= from_block // width)
    if to_block is not None:
        found.append(F.col("block_bucket") <= to_block // width)
    return found


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table with its ``block_bucket`` column, for filters that know the width of the buckets."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("block_bucket", T.LongType())])).parquet(path)


def scan(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    chain_id: int | None = None,
    from_block: int | None = None,
    to_block: int | None = None,
    width: int = BLOCK_BUCKET,
) -> DataFrame:
    """Columns of a table, pruned to a chain and a block range where given."""
    df = stored(spark, path, schema)
    for bound in bucket_bounds(from_block, to_block, width):
        df = df.where(bound)
    if chain_id is not None:
        df = df.where(F.col("chain_id") == chain_id)
    if from_block is not None:
        df = df.where(F.col("block_number") >= from_block)
    if to_block is not None:
        df = df.where(F.col("block_number") <= to_block)
    return df.select(*schema.fieldNames())
