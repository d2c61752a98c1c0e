"""Message sources: one topic per chain, or files with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas as S

TOPIC_PREFIX = "chain-logs"


def topic_name(chain_id: int, prefix: str = TOPIC_PREFIX) -> str:
    return f"{prefix}-{chain_id}"


def topic_list(chain_ids: list[int], prefix: str = TOPIC_PREFIX) -> str:
    return ",".join(topic_name(c, prefix) for c in chain_ids)


def read_kafka(
    spark: SparkSession,
    servers: str,
    chain_ids: list[int],
    prefix: str = TOPIC_PREFIX,
    starting_offsets: str = "earliest",
    max_offsets_per_trigger: int | None = None,
    stream: bool = True,
) -> DataFrame:
    """All configured chains as one source. Needs the Kafka connector on the class path."""
    reader = (spark.readStream if stream else spark.read).format("kafka")
    reader = (
        reader.option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic_list(chain_ids, prefix))
        .option("startingOffsets", starting_offsets)
    )
    if stream and max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load().select(*S.RAW_MESSAGE.fieldNames())


def read_files(
    spark: SparkSession,
    path: str,
    chain_ids: list[int] | None = None,
    prefix: str = TOPIC_PREFIX,
    max_files_per_trigger: int | None = None,
    stream: bool = True,
) -> DataFrame:
    """The same columns from Parquet files of recorded messages."""
    reader = (spark.readStream if stream else spark.read).schema(S.RAW_MESSAGE)
    if stream and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.parquet(path)
    if chain_ids is not None:
        df = df.where(F.col("topic").isin(*[topic_name(c, prefix) for c in chain_ids]))
    return df


def union_chains(frames: list[DataFrame]) -> DataFrame:
    """Per-chain frames as one, by column name."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged
