import json

import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.functions import hexnum
from ledgerloom.operators import completeness as C
from ledgerloom.operators import filters as Q
from ledgerloom.plans import ingest as I
from ledgerloom.session import scratch_path
from ledgerloom.sources import rpc, tables, topics

BLOCK = {
    "hash": "0xAB", "parentHash": "0xCD", "number": "0x10", "timestamp": "0x5", "gasLimit": "0x1c9c380", "gasUsed": "0x0",
    "transactions": [],
}


def landed(spark, *responses):
    rows = [(5, r if isinstance(r, str) else json.dumps({"jsonrpc": "2.0", "id": 1, **r})) for r in responses]
    return spark.createDataFrame(rows, rpc.LANDED)


def test_envelope_status(spark):
    df = landed(
        spark,
        {"result": BLOCK},
        {"result": None},
        {"result": {**BLOCK, "hash": ""}},
        {},
        {"error": {"code": -32000, "message": "busy"}, "result": BLOCK},
        "not json",
    )
    found = [r.status for r in rpc.envelope(df, S.RPC_BLOCK, "hash").collect()]
    assert found == ["ok", "unavailable", "unavailable", "failed", "failed", "failed"]
    assert rpc.envelope(df, S.RPC_BLOCK, "hash").where("error = 'busy'").count() == 1


def test_blocks_and_transactions(spark):
    tx = {"hash": "0xT1", "blockHash": "0xother", "blockNumber": "0x99", "from": "0xF", "to": None,
          "value": "0xde0b6b3a7640000", "input": "0xAb"}
    df = landed(spark, {"result": {**BLOCK, "transactions": [tx, {**tx, "hash": "0xT2", "value": "0x" + "f" * 64}]}},
                {"result": BLOCK})
    blocks = rpc.valid(rpc.blocks(df)).orderBy("tx_count").collect()
    assert [(b.block_number, b.block_hash, b.gas_limit, b.tx_count) for b in blocks] == [
        (16, "0xab", 30000000, 0), (16, "0xab", 30000000, 2)]
    first, second = rpc.valid(rpc.transactions(df)).orderBy("tx_hash").collect()
    # number and hash come from the enclosing block; absent numbers are zero
    assert (first.block_number, first.block_hash, first.tx_index, first.nonce) == (16, "0xab", 0, 0)
    assert (first.to_addr, first.value, first.gas_price, first.input) == ("", str(10**18), "0", "0xAb")
    assert second.value == str(2**256 - 1)


def test_light_blocks_list_hashes_only(spark):
    light = {**BLOCK, "transactions": ["0xT1", "0xT2"]}
    df = landed(spark, {"result": light}, {"result": None}, {"result": {**light, "number": "0x"}}, "not json")
    rows = rpc.valid(rpc.light_blocks(df)).collect()
    assert [tuple(r) for r in rows] == [(5, 16, "0xab", "0xcd")]


def test_heads_take_the_highest_answer(spark):
    df = landed(spark, {"result": "0x10"}, {"result": "0x1f"}, {"result": ""}, {"result": None}, {},
                {"error": {"code": -32000, "message": "busy"}})
    assert [tuple(r) for r in rpc.heads(df).collect()] == [(5, 31)]
    assert rpc.heads(landed(spark, {})).count() == 0


@pytest.mark.parametrize("bounds", [{}, {"from_block": 10}, {"from_block": 9, "to_block": 20}, {"to_block": 9}])
def test_bucket_bounds_keep_the_rows_of_a_filter(spark, tmp_path, bounds):
    logs = spark.range(31).selectExpr(
        "1L as chain_id", "id as block_number", "'0xb' as block_hash", "'0xt' as tx_hash", "id as log_index",
        "'0xc' as address", "'0x' as data", "array('0xe') as topics", "false as removed")
    path = str(tmp_path / "logs")
    tables.append(logs, path, "log_index", width=10)
    stored = tables.stored(spark, path, S.LOGS)
    numbers = {r.block_number for r in Q.LogFilter(bucket_width=10, **bounds).apply(stored).collect()}
    assert numbers == set(range(bounds.get("from_block", 0), bounds.get("to_block", 30) + 1))
    page = Q.logs_after(stored, 1, 20, 20, bucket_width=10).collect()
    assert [r.block_number for r in page] == list(range(21, 31))


def test_bad_numbers_are_set_aside(spark):
    df = landed(spark, {"result": {**BLOCK, "gasUsed": ""}}, {"result": {**BLOCK, "timestamp": "0x8000000000000000"}},
                {"result": BLOCK})
    assert rpc.valid(rpc.blocks(df)).count() == 1
    assert rpc.invalid(rpc.blocks(df)).count() == 2


def test_receipts(spark):
    full = {"transactionHash": "0xT", "blockNumber": "0x2", "status": "0x1", "contractAddress": None}
    row = rpc.receipts(landed(spark, {"result": full}, {"result": {**full, "transactionHash": ""}})).collect()
    assert len(row) == 1
    assert (row[0].tx_hash, row[0].status, row[0].gas_used, row[0].contract_address) == ("0xt", 1, 0, "")


def test_logs(spark):
    log = {"address": "0xA", "topics": ["0x1"], "data": "0x", "blockNumber": "0x1", "blockHash": "0xB",
           "transactionHash": "0xT", "logIndex": "0x0", "removed": True}
    df = landed(spark, {"result": [log]}, {"result": [log, {**log, "logIndex": ""}, None]}, {"result": []})
    assert rpc.logs(df).count() == rpc.valid(rpc.logs(df)).count() == 1
    refused = rpc.refused_logs(df).collect()
    assert [(r.status, r.bad_parts, len(r.result)) for r in refused] == [("invalid", 2, 3)]
    assert rpc.envelope(df, S.RPC_LOGS, None).where("status = 'ok'").count() == 3


@pytest.mark.parametrize("field, bad", [
    ("nonce", "0xzz"), ("gas", "0x8000000000000000"), ("value", "0x" + "f" * 65), ("gasPrice", "12g"), ("type", "0x"),
    ("transactionIndex", "-1"),
])
def test_a_bad_transaction_refuses_its_block(spark, field, bad):
    sound = {"hash": "0xT", "from": "0xF", "to": None, "value": "0x1", "nonce": "0x0", "gas": "0x5208", "gasPrice": "0x"}
    df = landed(spark, {"result": {**BLOCK, "transactions": [sound]}}, {"result": {**BLOCK, "transactions": [sound, {**sound, field: bad}, sound]}})
    assert rpc.blocks(df).count() == 1
    assert rpc.transactions(df).count() == rpc.valid(rpc.transactions(df)).count() == 1
    assert [(r.bad_parts, len(r.result.transactions)) for r in rpc.refused_blocks(df).collect()] == [(1, 3)]


def test_a_block_with_bad_numbers_gives_no_transactions(spark):
    df = landed(spark, {"result": {**BLOCK, "number": ""}}, {"result": {**BLOCK, "gasUsed": "x", "transactions": None}})
    assert rpc.transactions(df).count() == 0 and rpc.invalid(rpc.blocks(df)).count() == 2
    assert [r.bad_parts for r in rpc.refused_blocks(df).collect()] == [1, 1]


def test_fitting_hex_is_what_parses(spark):
    texts = [None, "", "0x", "0", "0x0", "0x00ff", "7" + "f" * 15, "8" + "0" * 15, "0x" + "f" * 64, "f" * 65, "0X1", " 1", "g"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(
        *(f"{fits} = ({value} is not null) as c{i}" for i, (fits, value) in enumerate([
            (hexnum.fits_bigint_sql("t"), hexnum.hex_to_bigint_sql("t")),
            (hexnum.fits_bigint_sql("t", optional=True), hexnum.hex_to_bigint_sql("t", optional=True)),
            (hexnum.fits_decimal_sql("t"), hexnum.hex_to_decimal_sql("t")),
        ])))
    assert all(all(r) for r in rows.collect())


def test_parses_once(spark):
    plan = rpc.valid(rpc.transactions(landed(spark, {"result": BLOCK})))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


LOG_ROWS = "chain_id bigint, block_number bigint, block_hash string, tx_hash string, log_index bigint, " \
           "address string, data string, topics array<string>, removed boolean"


def some_logs(spark, n=400):
    return spark.range(n).selectExpr(
        "id % 2 + 1 as chain_id", "id * 10 as block_number", "'0xh' as block_hash",
        "concat('0x', id) as tx_hash", "id as log_index", "concat('0xa', id % 5) as address", "'0x' as data",
        "array('0x1') as topics", "false as removed",
    )


def test_table_scan_prunes_chains_and_buckets(spark):
    path = scratch_path(spark, "logs")
    tables.append(some_logs(spark), path, "log_index", width=1000)
    found = tables.scan(spark, path, S.LOGS, chain_id=2, from_block=1000, to_block=1999, width=1000)
    assert found.schema.fieldNames() == S.LOGS.fieldNames()
    assert found.count() == 50
    plan = found.select("tx_hash")._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):]
    assert "chain_id" in filters and "block_bucket" in filters.split("PushedFilters")[0]
    assert "GreaterThanOrEqual(block_number,1000)" in plan
    assert "ReadSchema: struct<block_number:bigint,tx_hash:string>" in plan


def test_one_hot_block_is_spread_over_writers(spark):
    """A block holding a third of the rows is split by position, not given to one task."""
    hot = some_logs(spark, 3000).withColumn(
        "block_number", F.when(F.col("log_index") % 3 == 0, F.lit(7)).otherwise(F.col("block_number"))
    ).withColumn("chain_id", F.lit(1).cast("bigint"))
    sizes = tables.sort_for_ingest(hot, "log_index", partitions=8).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 1000


def test_filters_reach_the_scan(spark):
    path = scratch_path(spark, "pushed")
    tables.append(some_logs(spark), path, "log_index")
    wanted = Q.LogFilter(address="0xA3", chain_id=2, from_block=100, limit=5)
    df = Q.top_logs(wanted.apply(tables.scan(spark, path, S.LOGS)), wanted.limit)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=5" in plan
    assert "EqualTo(address,0xa3)" in plan and "GreaterThanOrEqual(block_number,100)" in plan
    assert "chain_id" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert df.count() == 5


@pytest.mark.parametrize("given, want", [(0, 100), (1, 1), (1000, 1000), (1001, 100), (-1, 100)])
def test_limits(given, want):
    assert Q.effective_limit(given) == want


@pytest.mark.parametrize("given, want", [(0, 1000), (5000, 5000), (5001, 1000), (1, 1)])
def test_page_limits(given, want):
    assert Q.effective_limit(given, S.DEFAULT_PAGE, S.MAX_PAGE) == want


def test_arguments_are_checked():
    for bad in ({"limit": -1}, {"chain_id": -1}, {"from_block": "5"}, {"to_block": 1.5}, {"limit": True}):
        with pytest.raises(ValueError):
            Q.LogFilter(**bad)
    with pytest.raises(ValueError):
        Q.BalanceFilter(chain_id=-2)


def test_empty_range_and_keyset_page(spark):
    logs = some_logs(spark)
    assert Q.LogFilter(from_block=50, to_block=40).apply(logs).count() == 0
    page = Q.logs_after(logs, 1, 20, 2, limit=3).collect()
    assert [(r.block_number, r.log_index) for r in page] == [(40, 4), (60, 6), (80, 8)]
    everything, after = [], (-1, -1)
    while True:
        rows = Q.logs_after(logs, 1, *after, limit=77).collect()
        if not rows:
            break
        everything += [r.log_index for r in rows]
        after = (rows[-1].block_number, rows[-1].log_index)
    assert everything == list(range(0, 400, 2))


def test_ingest_filter_checks_hex(spark):
    with pytest.raises(ValueError):
        Q.ingest_filter(some_logs(spark), address="0x12")
    with pytest.raises(ValueError):
        Q.ingest_filter(some_logs(spark), event_id="0x" + "g" * 64)


def test_topic_list():
    assert topics.topic_list([1, 56], "p") == "p-1,p-56"


# --- ingest ------------------------------------------------------------------------------------


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in columns.split()))


def test_next_ranges(spark):
    heads = frame(spark, [(1, 100), (2, 100), (3, 5), (4, 100), (5, 100)], "chain_id latest_block")
    state = frame(spark, [(2, 50), (4, 88), (5, 70)], "chain_id last_processed_block")
    ranges = I.next_ranges(heads, state, start_block=3, confirmations=12, batch_size=20)
    got = {r.chain_id: (r.from_block, r.to_block) for r in ranges.collect()}
    assert got == {1: (3, 22), 2: (51, 70), 5: (71, 88)}
    young = I.next_ranges(heads, state, start_block=0, confirmations=12, batch_size=20)
    assert (3, 0, 0) in [tuple(r) for r in young.collect()]
    strict = I.next_ranges(heads, state, start_block=0, confirmations=12, batch_size=20, strict=True)
    assert 3 not in [r.chain_id for r in strict.collect()]


def test_ranges_wait_until_whole(spark):
    """2 lacks a block, 3 a receipt, 4 all transactions of a block, 5 one of two; 6 holds those of a fork only."""
    ranges = frame(spark, [(c, 1, 3 if c == 1 else 2) for c in range(1, 7)], "chain_id from_block to_block")
    counts = {(1, 1): 0, (1, 2): 1, (1, 3): 0, (2, 1): 0, (3, 1): 1, (3, 2): 0, (4, 1): 5, (4, 2): 0,
              (5, 1): 0, (5, 2): 2, (6, 1): 1, (6, 2): 0}
    blocks = spark.createDataFrame(
        [(c, n, "0xh", count) for (c, n), count in counts.items()],
        "chain_id bigint, block_number bigint, block_hash string, tx_count bigint",
    )
    txs = spark.createDataFrame(
        [(1, 2, "0xh", "a"), (3, 1, "0xh", "b"), (5, 2, "0xh", "c"), (6, 1, "0xold", "d")],
        "chain_id bigint, block_number bigint, block_hash string, tx_hash string",
    )
    receipts = txs.where("chain_id <> 3")
    ready = I.available(ranges, blocks, txs, receipts)
    assert [r.chain_id for r in ready.collect()] == [1]


def test_coverage_gaps_of_long_ranges(spark):
    ranges = frame(spark, [(1, 0, 20000), (2, 5, 4)], "chain_id from_block to_block")
    blocks = spark.range(0, 20001).where("id % 5000 <> 3").selectExpr("1L as chain_id", "id as block_number")
    gaps = sorted(r.block_number for r in C.coverage_gaps(ranges, blocks).collect())
    assert gaps == [3, 5003, 10003, 15003]


def test_published_order(spark):
    h = "'0xh' as block_hash"
    blocks = spark.sql(f"select 1L chain_id, 1L block_number, {h}")
    txs = spark.sql(f"select 1L chain_id, 1L block_number, {h}, '0xt' tx_hash, id as tx_index from range(2)")
    logs = some_logs(spark, 2).withColumn("chain_id", F.lit(1).cast("bigint")).withColumn("block_number", F.lit(1))
    rows = I.publish(blocks, txs, txs, logs, "p").collect()
    kinds = [json.loads(r.value)["type"] for r in rows]
    assert kinds == ["block", "transaction", "transaction", "receipt", "receipt", "log", "log"]
