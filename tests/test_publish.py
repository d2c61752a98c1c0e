"""The ordering job: a crash at each step repeats the same messages, watermarks follow what the sink holds."""

import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.operators import messages as M
from ledgerloom.session import scratch_path
from ledgerloom.streaming import manifest, publish


def chain_tables(spark, until=30):
    """Chains 1 and 2: a block has one transaction with its receipt and two logs; chain 2 lacks the receipt of block 17."""
    blocks = spark.range(until).selectExpr("explode(array(1L, 2L)) as chain_id", "id as block_number")
    place = blocks.selectExpr("chain_id", "block_number", "concat('0xb', chain_id, block_number) as block_hash", "concat('0xt', chain_id, block_number) as tx_hash")

    def shaped(df, schema, **given):
        return df.select(*[given[f.name].alias(f.name) if f.name in given else (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    logs = place.withColumn("log_index", F.explode(F.expr("array(0L, 1L)")))
    return {
        "blocks": shaped(place, S.BLOCKS, tx_count=one, parent_hash=F.lit("0x")),
        "transactions": shaped(place, S.TRANSACTIONS, tx_index=zero, from_addr=F.lit("0xf")),
        "receipts": shaped(place.where("not (chain_id = 2 and block_number = 17)"), S.RECEIPTS, tx_index=zero, status=one),
        "logs": shaped(logs, S.LOGS, address=F.lit("0xa"), data=F.lit("0x1"), topics=F.array(F.lit("0x2")), removed=F.lit(False)),
    }


def heads(spark, *rows):
    return spark.createDataFrame(list(rows), "chain_id bigint, latest_block bigint")


def written(spark, path):
    return sorted((r.run, r.topic, r.value) for r in spark.read.parquet(path).select("run", "topic", "value").collect())


def state(spark, root):
    return {r[0]: r[1] for r in publish.watermarks(spark, root).collect()}


def test_ranges_follow_one_another_and_wait_until_they_are_whole(spark):
    root, out = scratch_path(spark, "state"), scratch_path(spark, "sent")
    tables, sink = chain_tables(spark), publish.file_sink(out)

    def go():
        return publish.run(spark, root, sink, heads(spark, (1, 25), (2, 25)), tables, "t", start_block=5, confirmations=2, batch_size=10)

    assert go() == 0 and state(spark, root) == {1: 14, 2: 14}
    # block 17 of chain 2 lacks a receipt: its range waits
    assert go() == 1 and state(spark, root) == {1: 23, 2: 14}
    assert go() == -1 and state(spark, root) == {1: 23, 2: 14}
    found = M.decode(spark.read.parquet(out).select(
        F.col("topic"), F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"), F.current_timestamp().alias("timestamp"), F.col("value").cast("binary").alias("value")
    ))
    counts = {(r.chain_id, r.kind): r["count"] for r in found.groupBy("chain_id", "kind").count().collect()}
    assert counts == {(c, k): n * m for c, n in ((1, 19), (2, 10)) for k, m in (("block", 1), ("transaction", 1), ("receipt", 1), ("log", 2))}
    publish.rewind(spark, root, 1, 20)
    assert state(spark, root) == {1: 19, 2: 14} and go() == 3 and state(spark, root) == {1: 23, 2: 14}
    publish.rewind(spark, root, 2, 0)
    assert state(spark, root) == {1: 23}


@pytest.mark.parametrize("step", ["intent", "sink", "commit"])
def test_a_crash_at_each_step_repeats_the_same_messages(spark, step, monkeypatch):
    tables = chain_tables(spark)

    def go(root, out, latest, sink=None):
        return publish.run(spark, root, sink or publish.file_sink(out), heads(spark, (1, latest)), tables, "t", batch_size=8)

    smooth, smooth_out = scratch_path(spark, "state"), scratch_path(spark, "sent")
    go(smooth, smooth_out, 9), go(smooth, smooth_out, 9)
    root, out = scratch_path(spark, "state"), scratch_path(spark, "sent")
    go(root, out, 9)

    def lost(*_):
        raise RuntimeError("lost")

    def half_written(messages, run):
        publish.file_sink(out)(messages.limit(3), run)
        lost()

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        if step == "intent":
            go(root, out, 9, sink=lost)
        elif step == "sink":
            go(root, out, 9, sink=half_written)
        else:
            m.setattr(manifest, "commit", lost)
            go(root, out, 9)
    assert state(spark, root) == {1: 7}
    with pytest.raises(RuntimeError):
        publish.rewind(spark, root, 1, 3)
    # the chain has grown meanwhile; the intended range is published, not a longer one
    assert go(root, out, 20) == 1
    assert state(spark, root) == state(spark, smooth) == {1: 9}
    assert written(spark, out) == written(spark, smooth_out)


def test_a_reorg_publishes_its_marker_and_moves_back(spark):
    root, out = scratch_path(spark, "state"), scratch_path(spark, "sent")
    tables = chain_tables(spark)
    args = (heads(spark, (1, 20), (2, 12)), tables, "t")
    publish.run(spark, root, publish.file_sink(out), *args, batch_size=10)
    detected = spark.createDataFrame([(1, 9, "reorg", 6, 5), (2, 9, "ok", None, 9)], "chain_id bigint, tip bigint, status string, from_block bigint, last_processed_block bigint")
    assert publish.run(spark, root, publish.file_sink(out), *args, detected=detected, batch_size=10) == 1
    assert state(spark, root) == {1: 5, 2: 12}
    sent = [v for r, t, v in written(spark, out) if r == 1 and t == "t-1"]
    assert len(sent) == 1 and '"type":"reorg"' in sent[0] and '"from_block":6' in sent[0]
    nothing_left = spark.createDataFrame([(1, 5, "reorg", 0, None)], detected.schema)
    publish.run(spark, root, publish.file_sink(out), *args, detected=nothing_left, batch_size=10)
    assert state(spark, root) == {2: 12}
