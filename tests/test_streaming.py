import json
import re

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schemas as S
from ledgerloom.operators import messages as M
from ledgerloom.plans import changelog as V
from ledgerloom.plans import queries
from ledgerloom.session import scratch_path
from ledgerloom.sources import topics
from ledgerloom.streaming import jobs
from ledgerloom.streaming.listener import ProgressCounters

EVENT = "0x" + "ab" * 32


def log(chain, block, index, address, amount, version="a"):
    return {
        "type": "log", "chain_id": chain, "block_number": block, "block_hash": f"0x{block}{version}",
        "tx_hash": f"0x{block}", "log_index": index, "address": "0xC",
        "topics": [EVENT, "0x" + f"{address:064x}"], "data": "0x" + f"{amount:064x}",
    }


BATCHES = [
    [log(1, 1, 0, 1, 10), log(1, 2, 0, 1, 20), {"type": "block", "chain_id": 1, "block_number": 2, "block_hash": "0x2a"}],
    # a repeated delivery, and blocks in another bucket
    [log(1, 2, 0, 1, 20), log(1, 12, 0, 2, 5), log(1, 13, 0, 2, 7), log(1, 13, 1, 3, 1)],
    # block 12 upwards is replaced
    [{"type": "reorg", "chain_id": 1, "from_block": 12}, log(1, 12, 0, 2, 6, "b"), "broken {"],
    # an orphaned log comes back on the main chain
    [log(1, 13, 0, 2, 7), log(1, 25, 0, 1, 2**255), log(1, 25, 1, 1, 2**255)],
    # everything from block 25 goes, nothing follows
    [{"type": "reorg", "chain_id": 1, "from_block": 25, "reason": "reorg"}],
]
BALANCES = {1: 30, 2: 13}


def land(spark, path, batch, number):
    rows = [
        ("t-1", 0, 100 * number + i, m if isinstance(m, str) else json.dumps(m)) for i, m in enumerate(batch)
    ]
    df = spark.createDataFrame(rows, "topic string, partition int, offset bigint, value string")
    df.select(
        "topic", "partition", "offset", F.timestamp_seconds(F.col("offset") + 1_000_000).alias("timestamp"),
        F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value"),
    ).coalesce(1).write.mode("append").parquet(path)


def test_a_batch_writes_files_by_folder_not_by_task(spark, tmp_path):
    for number, batch in enumerate(BATCHES[:2]):
        for _ in range(3):  # several input files, so several tasks
            land(spark, str(tmp_path / "in"), batch, number)
    stored = str(tmp_path / "changelog")
    decoded = M.decode(topics.read_files(spark, str(tmp_path / "in"), stream=False).repartition(8))
    jobs.store_batch(decoded, 0, stored, width=10)
    files = list((tmp_path / "changelog").rglob("*.parquet"))
    assert len(files) == len({f.parent for f in files}) == 3  # one of blocks, two of logs
    assert jobs.read_changelog(spark, stored).count() == decoded.count()


def test_a_marker_reads_folders_of_its_chain_from_its_block_on(spark, tmp_path):
    batches = [
        [log(c, b, 0, 1, 1) for c in (1, 2) for b in (5, 15, 25, 35)],
        [{"type": "reorg", "chain_id": 1, "from_block": 27}, {"type": "reorg", "chain_id": 2, "from_block": 12}],
    ]
    stored = str(tmp_path / "changelog")
    for number, batch in enumerate(batches):
        source = str(tmp_path / f"in{number}")
        land(spark, source, batch, number)
        jobs.store_batch(M.decode(topics.read_files(spark, source, stream=False)), number, stored, width=10)
    changelog = jobs.read_changelog(spark, stored)
    touched = jobs.touched_buckets(changelog.where("batch_id = 1"), changelog, width=10)
    assert {tuple(r) for r in touched.collect()} == {(1, 3), (2, 1), (2, 2), (2, 3)}
    text = touched._jdf.queryExecution().executedPlan().toString()
    for bound in (1, 2):
        assert re.search(rf"PartitionFilters: \[[^\]]*block_bucket#\d+L >= {bound}", text), text


def run(spark, source, changelog, offsets, after=None):
    stream = topics.read_files(spark, source, [1], prefix="t", max_files_per_trigger=1)
    query = jobs.start_changelog(stream, changelog, offsets, after_batch=after, width=10)
    query.awaitTermination()


def balances(spark, sums):
    return {int(r.address, 16): int(r.balance) for r in jobs.incremental_balances(spark, sums).collect()}


def test_incremental_balances_survive_a_crash(spark):
    source, changelog, offsets, sums = (scratch_path(spark, n) for n in ("in", "log", "offsets", "sums"))
    crash = {"left": 1}

    def refresh(session, batch_id):
        jobs.refresh_balances(session, changelog, batch_id, sums, EVENT, width=10)
        if batch_id == 2 and crash["left"]:
            crash["left"] -= 1
            raise RuntimeError("lost after the batch was stored, before its offsets were")

    for number, batch in enumerate(BATCHES):
        land(spark, source, batch, number)
        try:
            run(spark, source, changelog, offsets, refresh)
        except StreamingQueryException:
            run(spark, source, changelog, offsets, refresh)
    assert crash["left"] == 0
    stored = jobs.read_changelog(spark, changelog)
    assert stored.count() == sum(map(len, BATCHES))
    assert balances(spark, sums) == BALANCES
    whole = {int(r.address, 16): int(r.balance) for r in V.balances(stored, EVENT).collect()}
    assert whole == BALANCES
    assert V.state(stored).first().last_processed_block == 24
    assert [r.dead_reason for r in M.dead_letters(stored).collect()] == [M.MALFORMED]
    literal = {int(r.address, 16): int(r.balance) for r in V.balances(stored, EVENT, include_orphaned=True).collect()}
    assert literal == {1: 30 + 2**256, 2: 5 + 6 + 7, 3: 1}


def test_balances_with_arrival_order(spark):
    source, changelog, sums = (scratch_path(spark, n) for n in ("in", "log", "sums"))
    order = T.DecimalType(38, 0)
    for number, batch in enumerate(BATCHES):
        folder = f"{source}-{number}"
        land(spark, folder, batch, number)
        decoded = M.decode(topics.read_files(spark, folder, stream=False), M.arrival_order())
        jobs.store_batch(decoded, number, changelog)
        jobs.refresh_balances(spark, changelog, number, sums, EVENT)
    stored = jobs.read_changelog(spark, changelog, order)
    assert {int(r.address, 16): int(r.balance) for r in V.balances(stored, EVENT).collect()} == balances(spark, sums)


def test_last_batch_of_metrics(spark):
    source, changelog = scratch_path(spark, "in"), scratch_path(spark, "log")
    for number, batch in enumerate(BATCHES[:2]):
        folder = f"{source}-{number}"
        land(spark, folder, batch, number)
        jobs.store_batch(M.decode(topics.read_files(spark, folder, stream=False)), number, changelog)
    stored = jobs.read_changelog(spark, changelog)
    heads = spark.createDataFrame([], "chain_id bigint, latest_block bigint")
    now = F.lit("2030-01-01").cast("timestamp")
    found = {r.metric: r.value for r in queries.metrics(stored, V.state(stored), heads, now, now).collect() if r.topic is None}
    last = stored.where("kind = 'log' and batch_id = 1").agg(F.min("block_number"), F.max("block_number"), F.count("*")).first()
    assert (found["last_batch_from"], found["last_batch_to"], found["last_batch_count"]) == tuple(last)
    assert found["logs_total"] == stored.where("kind = 'log'").count()


def test_replay_from_the_start_gives_the_same_tables(spark):
    source = scratch_path(spark, "in")
    for number, batch in enumerate(BATCHES):
        land(spark, source, batch, number)
    seen = []
    for name in ("one", "two"):
        changelog, sums = scratch_path(spark, name), scratch_path(spark, "sums")
        run(spark, source, changelog, scratch_path(spark, "offsets"),
            lambda s, b: jobs.refresh_balances(s, changelog, b, sums, EVENT, width=10))
        seen.append((balances(spark, sums), sorted(map(str, V.logs(jobs.read_changelog(spark, changelog)).collect()))))
    assert seen[0] == seen[1] and seen[0][0] == BALANCES


def test_running_a_batch_again_replaces_it(spark):
    changelog = scratch_path(spark, "log")
    source = scratch_path(spark, "in")
    land(spark, source, BATCHES[0], 0)
    decoded = M.decode(topics.read_files(spark, source, stream=False))
    for _ in range(2):
        jobs.store_batch(decoded, 4, changelog)
    stored = jobs.read_changelog(spark, changelog)
    assert stored.count() == len(BATCHES[0])
    again = V.replayed(stored, 1, 2)
    assert again.count() == 2
    views = [sorted(map(str, V.logs(df).collect())) for df in (stored, stored.unionByName(again))]
    assert views[0] == views[1]


def test_stored_changelog_prunes_by_kind(spark):
    changelog, source = scratch_path(spark, "log"), scratch_path(spark, "in")
    land(spark, source, BATCHES[0] + BATCHES[2], 0)
    jobs.store_batch(M.decode(topics.read_files(spark, source, stream=False)), 0, changelog)
    plan = V.R.markers(jobs.read_changelog(spark, changelog))._jdf.queryExecution().executedPlan().toString()
    assert "kind" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "ReadSchema: struct<seq:bigint,from_block:bigint>" in plan


def test_stream_dedupe(spark):
    source = scratch_path(spark, "in")
    land(spark, source, BATCHES[0], 0)
    land(spark, source, BATCHES[1], 1)
    stream = M.to_logs(M.decode(topics.read_files(spark, source)), "message_time")
    query = (
        jobs.dedupe_stream(stream, "1 hour").writeStream.format("memory").queryName("deduped")
        .option("checkpointLocation", scratch_path(spark, "offsets")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.table("deduped").select(*S.LOG_KEY).collect()
    assert len(rows) == len(set(rows)) == 5


def test_state_of_a_stream_lies_on_disk_in_bounded_partitions(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    source = str(tmp_path / "source")
    spark.range(20).selectExpr(
        "1L as chain_id", "'a' as block_hash", "id % 3 as block_number", "'t' as tx_hash", "0L as log_index", "timestamp_seconds(id) as message_time"
    ).write.parquet(source)
    stream = jobs.dedupe_stream(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), "1 hour")
    with jobs.large_state(spark, (int(before) + 3) * jobs.KEYS_PER_PARTITION - 1):
        job = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "offsets"))
        job.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    kept = json.loads((tmp_path / "offsets" / "offsets" / "0").read_text().splitlines()[1])["conf"]
    assert kept["spark.sql.streaming.stateStore.providerClass"].endswith("RocksDBStateStoreProvider")
    assert kept["spark.sql.shuffle.partitions"] == str(int(before) + 3)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_counters_see_failures(spark):
    counters = ProgressCounters()
    spark.streams.addListener(counters)
    try:
        source = scratch_path(spark, "in")
        land(spark, source, BATCHES[0], 0)

        def fail(session, batch_id):
            raise RuntimeError("store is down")

        with pytest.raises(StreamingQueryException):
            run(spark, source, scratch_path(spark, "log"), scratch_path(spark, "offsets"), fail)
        for _ in range(100):
            if counters.commit_errors:
                break
            spark.range(1).count()
    finally:
        spark.streams.removeListener(counters)
    assert (counters.commit_errors, counters.fetch_errors) == (1, 0)


def test_kafka_source_needs_only_options(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        topics.read_kafka(spark, "nowhere:9092", [1, 2])
