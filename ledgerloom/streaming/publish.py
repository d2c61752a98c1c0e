"""The ordering job: confirmed ranges of each chain become messages of a sink, then the watermark moves.

A run writes its intent first (the ranges and reorg markers it is about to publish), then the messages, then the
watermarks as the next version of its manifest. A run that finds an intent without its version repeats exactly that
intent, so whatever step the last one died at, the sink ends up with the same messages and no block is passed over. The
intent and the watermarks have a row for each chain; only these reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import messages as M
from ledgerloom.operators import reorg as R
from ledgerloom.plans import ingest as I
from ledgerloom.streaming import manifest as L

Sink = Callable[[DataFrame, int], None]
_RANGES = "chain_id bigint, from_block bigint, to_block bigint"
_STATE = "chain_id bigint, last_processed_block bigint"
_REORGS = "chain_id bigint, from_block bigint, reason string"


def file_sink(path: str) -> Sink:
    """Messages as Parquet by run and topic. A repeated run replaces its own folder."""

    def write(messages: DataFrame, run: int) -> None:
        messages.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("topic").parquet(f"{path}/run={run}")

    return write


def kafka_sink(servers: str) -> Sink:
    """Messages to their topics. A repeated run sends the same messages again; consumers write by key."""

    def write(messages: DataFrame, run: int) -> None:
        messages.selectExpr("topic", "cast(key as binary) as key", "cast(value as binary) as value").write.format("kafka").option(
            "kafka.bootstrap.servers", servers
        ).save()

    return write


def watermarks(spark: SparkSession, root: str) -> DataFrame:
    """(chain_id, last_processed_block) as of the last finished run."""
    return spark.createDataFrame([(e["chain"], e["last"]) for e in L.live(spark, root)[1]], _STATE)


def rewind(spark: SparkSession, root: str, chain_id: int, from_block: int) -> None:
    """Publish a chain again from a block on; 0 forgets its watermark. An unfinished run is finished by the next one first."""
    version, entries = L.live(spark, root)
    if L.exists(spark, f"{root}/_intent/{version + 1}"):
        raise RuntimeError("the last run did not finish: run it again first")
    kept = [e for e in entries if e["chain"] != chain_id]
    L.commit(spark, root, version + 1, kept + [{"chain": chain_id, "last": from_block - 1}] * (from_block > 0))


def run(
    spark: SparkSession, root: str, sink: Sink, heads: DataFrame, tables: dict[str, DataFrame], prefix: str, detected: DataFrame | None = None,
    start_block: int = 0, confirmations: int = 0, batch_size: int = 1000, strict: bool = False, whole: bool = True,
) -> int:
    """Publish the next range of every chain; returns the number of the run, or -1 if there was nothing to publish.

    ``tables``: blocks, transactions, receipts and logs. ``detected`` are decisions of ``reorg.detect``: a chain with a
    reorg publishes its marker, moves back, and takes no range in this run. With ``whole`` a range waits until all its
    blocks are there with their transactions and receipts.
    """
    version, entries = L.live(spark, root)
    number = version + 1
    place = f"{root}/_intent/{number}"
    if L.exists(spark, place):
        intent = json.loads(L.read_text(spark, place))
    else:
        intent = _intend(spark, entries, heads, tables, detected, whole, start_block=start_block, confirmations=confirmations, batch_size=batch_size, strict=strict)
        if not intent["ranges"] and not intent["reorgs"]:
            return -1
        L.write_text(spark, place, json.dumps(intent))
    ranges = spark.createDataFrame([tuple(r) for r in intent["ranges"]], _RANGES)
    chosen = [I.in_ranges(tables[t], ranges) for t in ("blocks", "transactions", "receipts", "logs")]
    messages = I.publish(*chosen, prefix)
    if intent["reorgs"]:
        markers = spark.createDataFrame([(c, f, "reorg") for c, f, _ in intent["reorgs"]], _REORGS)
        messages = messages.unionByName(M.encode_reorgs(markers, prefix))
    sink(messages, number)
    state = {e["chain"]: e["last"] for e in entries}
    state |= {c: to for c, _, to in intent["ranges"]} | {c: last for c, _, last in intent["reorgs"]}
    L.commit(spark, root, number, [{"chain": c, "last": b} for c, b in sorted(state.items()) if b is not None])
    L.delete(spark, place)
    return number


def _intend(spark: SparkSession, entries: list[dict], heads: DataFrame, tables: dict[str, DataFrame], detected: DataFrame | None, whole: bool, **limits) -> dict:
    """What a run is about to publish: ranges (chain, from, to) and reorgs (chain, from, new watermark), a row per chain."""
    state = spark.createDataFrame([(e["chain"], e["last"]) for e in entries], _STATE)
    reorgs = []
    if detected is not None:
        rewound = R.reorg_messages(detected).select("chain_id").join(detected, "chain_id")
        reorgs = [list(r) for r in rewound.select("chain_id", "from_block", "last_processed_block").collect()]
    ranges = I.next_ranges(heads, state, **limits)
    if whole:
        ranges = I.available(ranges, tables["blocks"], tables["transactions"], tables["receipts"])
    held = {r[0] for r in reorgs}
    return {"ranges": sorted(list(r) for r in ranges.collect() if r[0] not in held), "reorgs": sorted(reorgs, key=lambda r: r[0])}
