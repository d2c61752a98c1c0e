"""What the query endpoints return, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.functions.fields import null_to_blank
from ledgerloom.operators import aggregates as A
from ledgerloom.operators import filters as Q
from ledgerloom.operators import metrics as X


def logs(table: DataFrame, wanted: Q.LogFilter = Q.LogFilter()) -> DataFrame:
    return Q.top_logs(wanted.apply(table).select(*S.LOGS.fieldNames()), wanted.limit)


def transactions(table: DataFrame, wanted: Q.TransactionFilter = Q.TransactionFilter()) -> DataFrame:
    rows = Q.top_transactions(wanted.apply(table).select(*S.TRANSACTIONS.fieldNames()), wanted.limit)
    return rows.select(*[null_to_blank(c) if c == "to_addr" else c for c in rows.columns])


def balances(table: DataFrame, wanted: Q.BalanceFilter = Q.BalanceFilter()) -> DataFrame:
    return Q.top_balances(wanted.apply(table).select("chain_id", "address", "balance"), wanted.limit)


def chains(spark: SparkSession, chain_ids: list[int]) -> DataFrame:
    """The configured chains, one row each."""
    for chain_id in chain_ids:
        Q.check_unsigned("chain_id", chain_id)
    return spark.createDataFrame([(c,) for c in chain_ids], "chain_id bigint")


def state(watermarks: DataFrame, configured: DataFrame) -> DataFrame:
    """Every configured chain with its watermark, 0 and ``has_state`` false when it has none."""
    return configured.join(watermarks, "chain_id", "left").select(
        "chain_id",
        F.coalesce("last_processed_block", F.lit(0)).alias("last_processed_block"),
        F.col("last_processed_block").isNotNull().alias("has_state"),
    )


def blocks(table: DataFrame, watermarks: DataFrame, chain_id: int | None = None) -> DataFrame:
    """Block range, and the watermark when a chain is given. One row.

    The range and the watermark are partial rows of one aggregate, so no join is needed.
    """
    Q.check_unsigned("chain_id", chain_id)
    span = table.select("chain_id", "block_number", F.lit(None).cast("bigint").alias("watermark"))
    if chain_id is not None:
        marks = watermarks.select(
            "chain_id",
            F.lit(None).cast("bigint").alias("block_number"),
            F.col("last_processed_block").alias("watermark"),
        )
        span = span.unionByName(marks).where(F.col("chain_id") == chain_id)
    low, high, mark = F.min("block_number"), F.max("block_number"), F.max("watermark")
    return span.agg(
        F.lit(chain_id).cast("bigint").alias("chain_id"),
        F.coalesce(low, F.lit(0)).alias("min_block"),
        F.coalesce(high, F.lit(0)).alias("max_block"),
        high.isNotNull().alias("has_blocks"),
        F.coalesce(mark, F.lit(0)).alias("last_processed_block"),
        mark.isNotNull().alias("has_state"),
    )


def reindex(watermarks: DataFrame, chain_id: int, from_block: int) -> DataFrame:
    """Watermarks after rewinding a chain to re-ingest from ``from_block``; 0 clears it."""
    Q.check_unsigned("chain_id", chain_id)
    Q.check_unsigned("from_block", from_block)
    others = watermarks.where(F.col("chain_id") != chain_id).select("chain_id", "last_processed_block")
    if from_block == 0:
        return others
    # VALUES keeps the one new row in the plan; no Python rows are shipped.
    rewound = watermarks.sparkSession.sql(
        f"select cast({chain_id} as bigint) as chain_id, cast({from_block - 1} as bigint) as last_processed_block"
    )
    return others.unionByName(rewound)


def metrics(
    changelog: DataFrame,
    watermarks: DataFrame,
    latest: DataFrame,
    processed_at: Column,
    started_at: Column,
    commit_errors: int = 0,
    fetch_errors: int = 0,
) -> DataFrame:
    """All metrics as rows (metric, topic, partition, value).

    The counters are reduced to one row per topic and partition in a hash aggregate, and
    totals per topic and overall are grouping sets over those few rows. The last message is
    a second pass over its narrow columns: beside the counters it would force a sort.
    """
    kind, block = F.col("kind"), F.col("block_number")
    is_log = kind == S.LOG
    in_last = is_log
    if "batch_id" in changelog.columns:
        # stored changelogs name the batch of a row; without it all rows are one batch
        newest = changelog.agg(F.max("batch_id").alias("_newest"))
        changelog = changelog.join(F.broadcast(newest), F.col("batch_id") == F.col("_newest"), "left")
        in_last = is_log & F.col("_newest").isNotNull()
    per_partition = changelog.groupBy("topic", "partition").agg(
        F.count("*").alias("messages"),
        F.count_if(is_log).alias("logs"),
        F.count_if(F.col("dead_stage") == "decode").alias("decode_errors"),
        F.count_if(F.col("dead_stage") == "apply").alias("apply_errors"),
        F.min("message_time").alias("oldest"),
        F.min(F.when(in_last, block)).alias("batch_from"),
        F.max(F.when(in_last, block)).alias("batch_to"),
        F.count_if(in_last).alias("batch_logs"),
    )
    totals = per_partition.groupingSets(
        [[], [F.col("topic")], [F.col("topic"), F.col("partition")]], "topic", "partition"
    ).agg(
        F.grouping_id().alias("level"),
        *[F.sum(c).alias(c) for c in ("messages", "logs", "batch_logs", "decode_errors", "apply_errors")],
        F.min("oldest").alias("oldest"),
        F.min("batch_from").alias("batch_from"),
        F.max("batch_to").alias("batch_to"),
    )

    def seconds(column: str) -> Column:
        micros = F.unix_micros(processed_at) - F.unix_micros(column)
        return F.rint(micros / F.lit(1e6)).cast("bigint")

    def metric(name: str, value: Column, topic: Column | None = None) -> Column:
        return F.struct(
            F.lit(name).alias("metric"),
            (F.col("topic") if topic is None else topic).alias("topic"),
            value.cast("bigint").alias("value"),
        )

    overall = F.array(
        metric("last_batch_from", F.coalesce("batch_from", F.lit(0))),
        metric("last_batch_to", F.coalesce("batch_to", F.lit(0))),
        metric("last_batch_count", F.coalesce("batch_logs", F.lit(0))),
        metric("logs_total", F.coalesce("logs", F.lit(0))),
        metric("messages_total", F.coalesce("messages", F.lit(0))),
        metric("decode_errors_total", F.coalesce("decode_errors", F.lit(0))),
        metric("apply_errors_total", F.coalesce("apply_errors", F.lit(0))),
        metric("max_lag_seconds", seconds("oldest")),
    )
    per_topic = F.array(metric("topic_messages_total", F.col("messages")))
    per_part = F.array(
        metric("partition_messages_total", F.col("messages")),
        metric("partition_max_lag_seconds", seconds("oldest")),
    )
    rows = totals.select(
        "partition",
        F.explode(
            F.when(F.col("level") == 3, overall).when(F.col("level") == 1, per_topic).otherwise(per_part)
        ).alias("m"),
    ).select("m.metric", "m.topic", "partition", "m.value")
    nothing = F.lit(None).cast("string")
    of_last = F.array(
        metric("last_partition", F.coalesce("partition", F.lit(0)), nothing),
        metric("last_offset", F.coalesce("offset", F.lit(0)), nothing),
        metric("last_bytes", F.coalesce("bytes", F.lit(0)), nothing),
        metric("last_timestamp_seconds", F.unix_seconds("message_time"), nothing),
        metric("last_lag_seconds", seconds("message_time"), nothing),
        metric("last_topic", F.when(F.col("topic").isNotNull(), 1), F.col("topic")),
    )
    last = X.latest_row(changelog).select(F.explode(of_last).alias("m")).select(
        "m.metric", "m.topic", F.lit(None).cast("int").alias("partition"), "m.value"
    )
    # Lags are reported only when positive.
    rows = rows.unionByName(last).where(
        F.col("value").isNotNull() & (~F.col("metric").endswith("lag_seconds") | (F.col("value") > 0))
    )

    running = F.unix_micros(processed_at) - F.unix_micros(started_at)
    uptime = F.rint(running / F.lit(1e6)).cast("bigint")
    # Without messages there are no totals to report: these counters then stay zero.
    counters = (
        "last_batch_from", "last_batch_to", "last_batch_count", "logs_total", "messages_total",
        "decode_errors_total", "apply_errors_total",
    )
    heights = X.block_lag(latest, watermarks).select(
        F.explode(
            F.array(
                metric("uptime_seconds", uptime, nothing),
                metric("latest_block", F.col("latest_block"), nothing),
                metric("last_processed_block", F.col("last_processed_block"), nothing),
                metric("block_lag", F.col("block_lag"), nothing),
                metric("commit_errors_total", F.lit(commit_errors), nothing),
                metric("fetch_errors_total", F.lit(fetch_errors), nothing),
                *[metric(name, F.lit(0), nothing) for name in counters],
            )
        ).alias("m")
    ).select("m.metric", "m.topic", F.lit(None).cast("int").alias("partition"), "m.value")
    return (
        rows.unionByName(heights)
        .groupBy("metric", "topic", "partition")
        .agg(F.max("value").alias("value"))
    )
