from pyspark.sql import functions as F

from ledgerloom.operators import aggregates as A
from ledgerloom.operators import metrics as K
from ledgerloom.operators import messages as M
from ledgerloom.plans import queries as P


def state(spark, *rows):
    return spark.createDataFrame(list(rows), "chain_id bigint, last_processed_block bigint")


def blocks(spark, *rows):
    return spark.createDataFrame(list(rows), "chain_id bigint, block_number bigint")


def test_state_lists_every_configured_chain(spark):
    rows = P.state(state(spark, (1, 0), (9, 5)), P.chains(spark, [1, 2])).orderBy("chain_id").collect()
    assert [tuple(r) for r in rows] == [(1, 0, True), (2, 0, False)]


def test_blocks(spark):
    table, marks = blocks(spark, (1, 5), (1, 9), (2, 7)), state(spark, (1, 9))
    assert tuple(P.blocks(table, marks, 1).first()) == (1, 5, 9, True, 9, True)
    assert tuple(P.blocks(table, marks, 3).first()) == (3, 0, 0, False, 0, False)
    assert tuple(P.blocks(table, marks).first()) == (None, 5, 9, True, 0, False)
    assert tuple(A.block_range(table, 2).first()) == (7, 7, True)


def test_reindex(spark):
    marks = state(spark, (1, 9), (2, 4))
    assert sorted(map(tuple, P.reindex(marks, 1, 5).collect())) == [(1, 4), (2, 4)]
    assert sorted(map(tuple, P.reindex(marks, 1, 0).collect())) == [(2, 4)]
    assert sorted(map(tuple, P.reindex(marks, 3, 1).collect())) == [(1, 9), (2, 4), (3, 0)]


def test_block_lag(spark):
    def lag(latest, *marks):
        head = spark.createDataFrame([(latest,)], "latest_block bigint")
        return K.block_lag(head, state(spark, *marks)).first().block_lag

    assert lag(10, (1, 4)) == 6
    assert lag(10) == 0
    assert lag(10, (1, 0)) == 0
    assert lag(3, (1, 4)) == 0


def test_last_processed(spark):
    assert A.last_processed(state(spark, (1, 4), (2, 9)), [1]).first()[0] == 4
    assert A.last_processed(state(spark), [1]).first()[0] == 0


def test_metrics_of_an_empty_changelog(spark):
    raw = spark.createDataFrame([], "topic string, partition int, offset bigint, timestamp timestamp, value string")
    head = spark.createDataFrame([(7,)], "latest_block bigint")
    now = F.lit("2024-01-01 00:00:10").cast("timestamp")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = {r.metric: r.value for r in P.metrics(M.decode(raw), state(spark), head, now, start, 2, 3).collect()}
    assert got["uptime_seconds"] == 10 and got["latest_block"] == 7 and got["block_lag"] == 0
    assert got["commit_errors_total"] == 2 and got["fetch_errors_total"] == 3
    assert "max_lag_seconds" not in got and "last_topic" not in got
    assert got["last_partition"] == got["last_offset"] == got["last_bytes"] == got["messages_total"] == 0
