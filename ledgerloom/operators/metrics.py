"""Stream metrics computed from the messages themselves.

Lag is measured against a given processing time, so a run is repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def lag_seconds(processed_at: Column) -> Column:
    """Seconds from message time to processing time."""
    return (F.unix_micros(processed_at) - F.unix_micros("message_time")) / F.lit(1e6)


def topic_messages(messages: DataFrame) -> DataFrame:
    """Messages per topic (partition NULL) and per topic and partition, in one pass."""
    return messages.groupingSets(
        [[F.col("topic")], [F.col("topic"), F.col("partition")]], "topic", "partition"
    ).agg(F.count("*").alias("messages"))


def max_lag(messages: DataFrame, processed_at: Column) -> DataFrame:
    """Highest lag overall (topic NULL) and per topic and partition.

    The oldest message has the highest lag, so only a minimum is aggregated.
    """
    oldest = messages.groupingSets(
        [[], [F.col("topic"), F.col("partition")]], "topic", "partition"
    ).agg(F.min("message_time").alias("message_time"))
    return oldest.select("topic", "partition", lag_seconds(processed_at).alias("max_lag_seconds"))


def latest_row(messages: DataFrame) -> DataFrame:
    """Coordinates and size of the latest message; one row, of NULLs when there is none."""
    row = F.struct("topic", "partition", "offset", "bytes", "message_time")
    latest = F.max_by(row, F.struct("message_time", "offset", "partition", "topic"))
    return messages.agg(latest.alias("m")).select("m.*")


def last_message(messages: DataFrame) -> DataFrame:
    return latest_row(messages).where(F.col("topic").isNotNull())


def errors(dead: DataFrame) -> DataFrame:
    """Dead letters per stage and reason."""
    return dead.groupBy("dead_stage", "dead_reason").agg(F.count("*").alias("errors"))


def block_lag(latest: DataFrame, state: DataFrame) -> DataFrame:
    """latest - last where last > 0 and latest >= last, else 0. One row."""
    none = F.lit(None).cast("bigint")
    heights = latest.select("latest_block", none.alias("last_processed_block")).unionByName(
        state.select(none.alias("latest_block"), "last_processed_block")
    )
    last, head = F.col("last_processed_block"), F.col("latest_block")
    return heights.agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("latest_block", "last_processed_block")]
    ).withColumn("block_lag", F.when((last > 0) & (head >= last), head - last).otherwise(0))
