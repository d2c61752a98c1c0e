"""Streaming jobs: messages to changelog, changelog to incremental balances.

The changelog is written once per micro-batch into ``batch_id=<n>``. A batch that runs
again after a failure overwrites exactly its own folder, so the table never holds a
message of one delivery twice; deliveries repeated by the source are resolved by the
views over the changelog.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom import schemas as S
from ledgerloom.functions.hexnum import LIMB_COLUMNS
from ledgerloom.operators import balances as B
from ledgerloom.operators import messages as M
from ledgerloom.operators import reorg as R
from ledgerloom.operators import writers as W
from ledgerloom.sources.tables import BLOCK_BUCKET, bucket_bounds
from ledgerloom.streaming import compaction

_LONG, _TEXT = T.LongType(), T.StringType()
_NARROW = {"uint": _LONG, "string": _TEXT, "bool": T.BooleanType(), "array": T.ArrayType(_TEXT)}


def changelog_schema(seq: T.DataType = _LONG) -> T.StructType:
    fields = [("seq", seq), ("topic", _TEXT), ("partition", T.IntegerType()), ("offset", _LONG)]
    fields += [("message_time", T.TimestampType()), ("bytes", T.IntegerType())]
    fields += [(n, _NARROW[k]) for n, k in S.ENVELOPE_FIELDS]
    fields += [("raw", _TEXT), ("dead_stage", _TEXT), ("dead_reason", _TEXT)]
    fields += [("batch_id", _LONG), ("kind", _TEXT), ("block_bucket", _LONG)]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def store_batch(decoded: DataFrame, batch_id: int, path: str, width: int = BLOCK_BUCKET) -> None:
    """Write one micro-batch of changelog rows; running it again replaces it.

    Rows are brought together by folder first, so that a batch writes about as many files as
    folders, not tasks times folders; with adaptive execution a busy folder is split again.
    """
    (
        decoded.withColumn("block_bucket", F.expr(f"block_number div {width}"))
        .hint("rebalance", "kind", "chain_id", "block_bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("kind", "chain_id", "block_bucket")
        .parquet(f"{path}/batch_id={batch_id}")
    )


def read_changelog(spark: SparkSession, path: str, seq: T.DataType = _LONG) -> DataFrame:
    """The stored changelog, folded or not; filters on kind, chain and bucket prune directories."""
    return compaction.read(spark, path, changelog_schema(seq))


def fold_changelog(spark: SparkSession, path: str, batch_id: int, seq: T.DataType = _LONG, fan: int = compaction.FAN) -> int:
    """Fold the batches before ``batch_id``, which are closed once it is stored. To be called from ``after_batch``."""
    return compaction.fold(spark, path, changelog_schema(seq), batch_id - 1, fan)


def stored_seq(spark: SparkSession, path: str, batch_id: int) -> T.DataType:
    """The type in which a batch stored its ``seq``; an empty batch has none and counts as BIGINT."""
    try:
        stored = spark.read.parquet(f"{path}/batch_id={batch_id}").schema
    except AnalysisException:
        return _LONG
    return stored["seq"].dataType


def start_changelog(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    seq: Column | str = "offset",
    after_batch: Callable[[SparkSession, int], None] | None = None,
    trigger: dict | None = None,
    width: int = BLOCK_BUCKET,
) -> StreamingQuery:
    """Decode a message stream into the changelog.

    Offsets are committed by the checkpoint after the batch is stored. ``after_batch`` runs
    in between, e.g. ``refresh_balances``; it must be idempotent too. Batch size and pace
    come from the source (``maxOffsetsPerTrigger``, ``maxFilesPerTrigger``) and ``trigger``.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, batch_id, path, width)
        if after_batch:
            after_batch(batch.sparkSession, batch_id)

    return (
        M.decode(messages, seq)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


# --- balances kept per block bucket --------------------------------------------------------


def touched_buckets(batch: DataFrame, changelog: DataFrame, width: int = BLOCK_BUCKET) -> DataFrame:
    """(chain_id, block_bucket) whose logs a batch may change.

    Its logs touch their own bucket; a reorg marker touches every bucket that holds logs of
    its chain from the marker's block upwards. The lowest marker of each chain, one row per
    chain in the batch, becomes a filter on the folders.
    """
    is_log = F.col("kind") == S.LOG
    touched = batch.where(is_log).select("chain_id", "block_bucket")
    lowest = R.markers(batch).groupBy("chain_id").agg(F.min("from_block")).collect()
    if lowest:
        above = F.lit(False)
        for chain_id, block in lowest:
            folders = (F.col("chain_id") == chain_id) & bucket_bounds(block, None, width)[0]
            above = above | (folders & (F.col("block_number") >= block))
        rewound = changelog.where(is_log & above)
        touched = touched.unionByName(rewound.select("chain_id", "block_bucket"))
    return touched.distinct()


def refresh_balances(
    spark: SparkSession,
    changelog_path: str,
    batch_id: int,
    path: str,
    event_id: str,
    width: int = BLOCK_BUCKET,
) -> None:
    """Recompute the limb sums of the buckets a batch touched, from the changelog.

    Sums are replaced per (chain, bucket), never added to, so duplicates, reorgs and
    repeated batches all come out right. An empty row marks a bucket whose logs all went.
    ``width`` is the one the changelog was stored with.
    """
    changelog = read_changelog(spark, changelog_path, stored_seq(spark, changelog_path, batch_id))
    batch = changelog.where(F.col("batch_id") == batch_id)
    touched = touched_buckets(batch, changelog, width)
    lowest = touched.agg(F.min("block_bucket")).first()[0]
    if lowest is None:
        return
    # One number prunes the scan to the head of the chain; the semi join is exact.
    recent = changelog.where(
        (F.col("kind") == S.REORG) | ((F.col("kind") == S.LOG) & (F.col("block_bucket") >= lowest))
    )
    rows = M.to_logs(recent, "seq", "block_bucket").join(
        touched, ["chain_id", "block_bucket"], "left_semi"
    )
    alive = R.invalidate(W.normalise_logs(rows), R.markers(recent))
    sums = B.partial_sums(
        B.credits(W.first_writer(alive, S.LOG_KEY), event_id, extra=("block_bucket",)), "block_bucket"
    )
    empty = touched.select(
        "chain_id", F.lit("").alias("address"), "block_bucket",
        *[F.lit(0).cast("bigint").alias(c) for c in LIMB_COLUMNS],
    )
    (
        sums.unionByName(empty)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("chain_id", "block_bucket")
        .parquet(path)
    )


def sums_schema() -> T.StructType:
    fields = [("address", _TEXT), *[(c, _LONG) for c in LIMB_COLUMNS]]
    fields += [("chain_id", _LONG), ("block_bucket", _LONG)]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def incremental_balances(spark: SparkSession, path: str) -> DataFrame:
    """Balances from the stored sums of all buckets."""
    sums = spark.read.schema(sums_schema()).parquet(path).where(F.col("address") != "")
    return B.to_balances(B.partial_sums(sums))


# --- stream operators -------------------------------------------------------------------------


def dedupe_stream(logs: DataFrame, delay: str, event_time: str = "message_time") -> DataFrame:
    """Drop logs delivered again within ``delay``; state older than that is dropped. To be started within ``large_state``."""
    return logs.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(S.LOG_KEY)


#: keys that a partition of a stream's state holds at most, about
KEYS_PER_PARTITION = 500_000
_ROCKSDB = "spark.sql.streaming.stateStore.rocksdb"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # one bound for all partitions on an executor; else each has its own buffers
    f"{_ROCKSDB}.boundedMemoryUsage": "true",
    # a lookup for every write
    f"{_ROCKSDB}.trackTotalNumberOfRows": "false",
}


@contextmanager
def large_state(spark: SparkSession, keys: int) -> Iterator[None]:
    """Settings for streams whose state holds about so many keys: it lies on disk, in partitions of bounded size.

    By default state lies in the heap of the executors and in as many partitions as the session shuffles to, whatever its
    size. A stream keeps what it was first started with, so ``keys`` is what it is to hold at its fullest.
    """
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // KEYS_PER_PARTITION))
    wanted = {**_STATE, "spark.sql.shuffle.partitions": str(partitions)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
