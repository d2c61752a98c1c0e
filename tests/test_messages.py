import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.operators import aggregates as A
from ledgerloom.operators import messages as M
from ledgerloom.plans import changelog as V


def raw(spark, values, partition=0):
    rows = [("t-1", partition, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "topic string, partition int, offset bigint, value string").withColumn(
        "timestamp", F.timestamp_seconds(F.col("offset"))
    )


@pytest.mark.parametrize(
    "text, reason",
    [
        ('{"type":"log"', M.MALFORMED),
        ("", M.MALFORMED),
        (None, M.MALFORMED),
        ("null", M.MALFORMED),
        ('[{"type":"log","chain_id":1}]', M.MALFORMED),
        ('{"type":"log","chain_id":1} x', M.MALFORMED),
        ('{"type":"log","chain_id":1}{}', M.MALFORMED),
        ('{"type":"log","chain_id":1}}', M.MALFORMED),
        ('{"type":"log","chain_id":1},{"type":"log","chain_id":1}', M.MALFORMED),
        ('{"type":"log","chain_id":1}],[{}', M.MALFORMED),
        ('{"type":"log","chain_id":1,"x":{}', M.MALFORMED),
        ('{"type":"log","chain_id":1,"x":{}} y', M.MALFORMED),
        ('{"type":"log","chain_id":"1","x":{}}', M.BAD_FIELD),
        ('{"type":"log","chain_id":{"chain_id":1}}', M.BAD_FIELD),
        ('{"type":"log","chain_id":1,"x":{},"nonce":1.0}', M.BAD_FIELD),
        ('{"type":"log","chain_id":1,"x":{},"nonce":-1}', M.BAD_FIELD),
        ('{"type":"log","chain_id":1,"x":{},"nonce":1e2}', M.BAD_FIELD),
        ('{"type":"log","chain_id":1,"x":{},"removed":"true"}', M.BAD_FIELD),
        ('{"type":"log","chain_id":1,"topics":["a",{"b":1}]}', M.BAD_FIELD),
        ('{"x":{},"type":"block","chain_id":1,"block_number":18446744073709551615}', M.OUT_OF_RANGE),
        ('{"x":{"type":"log"},"chain_id":1}', M.MISSING_TYPE),
        ('{"type":"log","x":{"chain_id":1}}', M.MISSING_CHAIN),
        ('{"chain_id":1}', M.MISSING_TYPE),
        ('{"type":"","chain_id":1}', M.MISSING_TYPE),
        ('{"type":"log"}', M.MISSING_CHAIN),
        ('{"type":"log","chain_id":0}', M.MISSING_CHAIN),
        ('{"type":"log","chain_id":"1"}', M.BAD_FIELD),
        ('{"type":"log","chain_id":1,"block_number":1.5}', M.BAD_FIELD),
        ('{"type":"log","chain_id":1,"block_number":-1}', M.BAD_FIELD),
        ('{"type":"log","chain_id":1,"data":5}', M.BAD_FIELD),
        ('{"type":"log","chain_id":1,"removed":"true"}', M.BAD_FIELD),
        ('{"type":"log","chain_id":1,"topics":["a",5]}', M.BAD_FIELD),
        ('{"type":"log","chain_id":1,"topics":"a"}', M.BAD_FIELD),
        ('{"type":"block","chain_id":1,"block_number":18446744073709551615}', M.OUT_OF_RANGE),
        ('{"type":"uncle","chain_id":1}', M.UNKNOWN_TYPE),
    ],
)
def test_dead_letters(spark, text, reason):
    row = M.decode(raw(spark, [text])).first()
    assert (row.kind, row.dead_reason, row.raw) == ("dead_letter", reason, text)
    assert row.dead_stage == ("apply" if reason == M.UNKNOWN_TYPE else "decode")
    assert row.chain_id == 0 and row.block_number == 0


@pytest.mark.parametrize(
    "text",
    [
        '{"type":"log","chain_id":1}',
        ' { "type" : "log" , "chain_id" : 1 , "topics" : [ ] } ',
        '{"type":"log","chain_id":1,"block_number":null,"data":null,"topics":null,"removed":null}',
        '{"type":"log","chain_id":1,"reason":"\\"chain_id\\":\\"x\\"","topics":["a\\"b",null,"c"]}',
        '{"type":"log","chain_id":1,"something_else":{"a":[1]}}',
        '{"type":"log","chain_id":1,"block_number":0,"meta":{"status":"ok","type":5,"topics":7}}',
        '{"meta":[{"chain_id":"x"},{"removed":"y"}],"type":"log","chain_id":1,"data":"}{","topics":["a",null]} ',
        '{"type":"log","chain_id":1,"data":"} x","reason":"{\\"type\\":5}{}"}',
    ],
)
def test_accepted_messages(spark, text):
    row = M.decode(raw(spark, [text])).first()
    assert (row.kind, row.dead_reason, row.chain_id, row.block_number) == ("log", None, 1, 0)


def test_absent_fields_are_zero(spark):
    row = M.decode(raw(spark, ['{"type":"receipt","chain_id":9}'])).first().asDict()
    assert row["status"] == 0 and row["logs_bloom"] == "" and row["topics"] == [] and row["removed"] is False


def test_largest_bigint_is_exact(spark):
    text = json.dumps({"type": "block", "chain_id": 1, "block_number": 2**63 - 1})
    assert M.decode(raw(spark, [text])).first().block_number == 2**63 - 1


def test_encode_drops_zero_values_and_refuses_chain_zero(spark):
    blocks = spark.sql(
        "select 7L chain_id, 0L block_number, '0xab' block_hash, '' parent_hash, 0L timestamp, "
        "1L gas_limit, 0L gas_used, 0L tx_count"
    )
    row = M.encode_blocks(blocks, "p").first()
    assert (row.topic, row.key) == ("p-7", "block:0")
    assert json.loads(row.value) == {"type": "block", "chain_id": 7, "block_hash": "0xab", "block_gas_limit": 1}
    with pytest.raises(PySparkException):
        M.encode_blocks(blocks.withColumn("chain_id", F.lit(0)), "p").collect()


def test_reorg_from_block_zero_round_trip(spark):
    reorgs = spark.sql("select 3L chain_id, 0L from_block, 'reorg' reason")
    encoded = M.encode_reorgs(reorgs, "p")
    assert encoded.first().value == '{"type":"reorg","chain_id":3,"reason":"reorg"}'
    back = M.decode(raw(spark, [encoded.first().value])).first()
    assert (back.kind, back.from_block, back.chain_id) == ("reorg", 0, 3)


def test_batch_of_a_log_and_a_block(spark):
    """A log at block 100 and a block at 101: one of each, watermark 101, two messages."""
    batch = M.decode(raw(spark, [
        '{"type":"log","chain_id":1,"block_number":100,"tx_hash":"0x1","address":"0xAddr"}',
        '{"type":"block","chain_id":1,"block_number":101,"block_hash":"0xBlock"}',
    ]))
    counts = A.batch_counts(batch).first()
    assert (counts.messages, counts.logs, counts.blocks) == (2, 1, 1)
    assert V.state(batch).first().last_processed_block == 101
    assert A.batch_max_block(batch).first().max_block == 101
    span = A.offset_range(batch).first()
    assert (span.min_offset, span.max_offset) == (0, 1)
    assert V.logs(batch).first().address == "0xaddr"


def test_block_zero_never_registers_as_batch_maximum(spark):
    batch = M.decode(raw(spark, ['{"type":"block","chain_id":1}']))
    assert A.batch_max_block(batch).count() == 0
    assert V.state(batch).first().last_processed_block == 0


def test_chain_mismatch_is_only_flagged(spark):
    batch = M.decode(raw(spark, ['{"type":"log","chain_id":1}', '{"type":"log","chain_id":2}']))
    flags = [r.chain_mismatch for r in M.chain_mismatch(M.accepted(batch), "t").orderBy("seq").collect()]
    assert flags == [False, True]


def test_arrival_order_over_partitions(spark):
    text = '{"type":"log","chain_id":1}'
    both = raw(spark, [text] * 2, partition=1).unionByName(raw(spark, [text] * 2, partition=0))
    rows = M.decode(both, M.arrival_order()).orderBy("seq").collect()
    assert [(r.offset, r.partition) for r in rows] == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_filters_on_decoded_fields_parse_once(spark):
    logs = V.M.to_logs(M.decode(raw(spark, ['{"type":"log","chain_id":1}'])))
    plan = logs.where("block_number > 5")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


@pytest.mark.parametrize(
    "text, reason",
    [
        ('{"type":"block","chain_id":1,"block_number":9223372036854775807}', None),
        ('{"type":"block","chain_id":1,"block_number":9223372036854775808}', M.OUT_OF_RANGE),
        ('{"type":"block","chain_id":1,"nonce": 99999999999999999999 }', M.OUT_OF_RANGE),
        ('{"type":"block","chain_id":1,"nonce":100000000000000000000}', M.MALFORMED),
        ('{"type":"block","chain_id":1,"nonce":18446744073709551615,"gas":100000000000000000000}', M.OUT_OF_RANGE),
        ('{"type":"block","chain_id":1,"nonce":18446744073709551615,"gas":007}', M.MALFORMED),
        ('{"type":"block","chain_id":1,"nonce":007}', M.MALFORMED),
        ('{"type":"block","chain_id":1,"reason":"\\"nonce\\":18446744073709551615"}', None),
        ('{"type":"block","chain_id":1,"other":18446744073709551615}', None),
        ('{"type" : "block" , "chain_id" : "1"}', M.BAD_FIELD),
    ],
)
def test_numbers_at_the_edge_of_bigint(spark, text, reason):
    assert M.decode(raw(spark, [text])).first().dead_reason == reason


def test_numbers_are_parsed_without_decimals(spark):
    plan = M.decode(raw(spark, ['{"type":"log","chain_id":1}']))._jdf.queryExecution().executedPlan().toString()
    assert "DecimalType(20,0)" not in plan
