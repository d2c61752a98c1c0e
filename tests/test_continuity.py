"""Links and running sums against plain loops, with breaks at the edges of ranges; the reorg check from the tip."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import continuity as N
from ledgerloom.operators import reorg as R
from ledgerloom.plans import reorg_search
from ledgerloom.sources import tables
from ledgerloom import schemas as S

HASHES = "chain_id bigint, block_number bigint, block_hash string"
STATE = "chain_id bigint, last_processed_block bigint"


@pytest.mark.parametrize("width", [1, 2, 10, 4096])
def test_links_with_breaks_at_range_edges(spark, width):
    rows, want = [], {}
    for chain in (1, 2):
        for n in range(40):
            if chain == 2 and n in (10, 19, 21):
                continue  # holes at and inside edges
            parent = "0xBAD" if n in (10, 20, 29, 33) else f"0xA{n - 1}"
            rows.append((chain, n, f"0xa{n}", None if n == 35 else parent, 7))
            stored = n > 0 and not (chain == 2 and n - 1 in (10, 19, 21))
            want[chain, n] = (parent != "0xBAD") if stored and n != 35 else None
    blocks = spark.createDataFrame(rows, "chain_id bigint, block_number bigint, block_hash string, parent_hash string, linked int").repartition(5)
    assert {(r.chain_id, r.block_number): r.linked for r in N.parent_links(blocks, width).collect()} == want
    assert N.parent_links(blocks.limit(0)).count() == 0


@pytest.mark.parametrize("width", [1, 3, 1024])
def test_running_gas(spark, width):
    rng = random.Random(3)
    rows, want = [], {}
    for chain, block, n in ((1, 1, 50), (1, 2, 1), (2, 1, 7), (2, 9, 200)):
        total = 0
        for i in range(n):
            gas = rng.randint(1, 9)
            total += gas
            stated = total + (i in (3, 6, 11))
            rows.append((chain, block, i, f"0x{i}", gas, None if i == 5 else stated, "clash"))
            want[chain, block, i] = (total, None if i == 5 else i not in (3, 6, 11))
    receipts = spark.createDataFrame(rows, "chain_id bigint, block_number bigint, tx_index bigint, tx_hash string, gas_used bigint, cumulative_gas_used bigint, gas_sum string")
    found = N.cumulative_gas(receipts.repartition(4), width).collect()
    assert {(r.chain_id, r.block_number, r.tx_index): (r.gas_sum, r.agrees) for r in found} == want
    assert N.cumulative_gas(receipts.limit(0), width).count() == 0


def test_search_from_the_tip_decides_as_the_whole_comparison(spark):
    rng = random.Random(9)
    stored, node, state = [], [], []
    for chain in range(1, 60):
        height = rng.randint(0, 60)
        fork = rng.randint(-1, height) if rng.random() < 0.8 else height
        for n in range(height + 1):
            if rng.random() < 0.95:
                stored.append((chain, n, f"0xa{n}"))
            if rng.random() < 0.97:
                node.append((chain, n, f"0xA{n}" if n <= fork or rng.random() < 0.1 else f"0xb{n}"))
        state.append((chain, height - rng.choice([0, 0, 0, 2]) if rng.random() < 0.95 else height + 1))
    stored, node = spark.createDataFrame(stored + stored[:20], HASHES), spark.createDataFrame(node, HASHES)
    state = spark.createDataFrame(state, STATE).where("last_processed_block >= 0")
    want = sorted(R.detect(stored, node, state).collect())
    assert {r.status for r in want} == {"ok", "reorg", "unavailable", "unchecked"}
    key = lambda r: r.chain_id
    for first in (1, 3, 64):
        found = reorg_search.detect_from_tip(reorg_search.reader(stored), reorg_search.reader(node), state, first).collect()
        assert sorted(found, key=key) == sorted(want, key=key)
    nothing = reorg_search.detect_from_tip(reorg_search.reader(stored), reorg_search.reader(node), state.limit(0))
    assert nothing.count() == 0 and nothing.columns == R.detect(stored, node, state).columns


def test_an_equal_tip_opens_one_folder(spark, tmp_path):
    rows = [(c, n, f"0x{c}{n}", f"0x{c}{n - 1}", n, 0, 0, 0) for c in (1, 2) for n in range(100)]
    blocks = spark.createDataFrame(rows, S.BLOCKS)
    path = str(tmp_path / "blocks")
    tables.append(blocks, path, "block_hash", 10)
    stored = tables.stored(spark, path, S.BLOCKS)
    node = blocks.withColumn("block_hash", F.when(F.expr("chain_id = 2 and block_number > 83"), "0xother").otherwise(F.col("block_hash")))
    asked = []

    def read(spans):
        asked.append(dict(spans))
        found = reorg_search.rows_within(stored, 10, spans)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*block_bucket", plan)
        return found

    state = spark.createDataFrame([(1, 99), (2, 99)], STATE)
    found = {r.chain_id: tuple(r)[2:] for r in reorg_search.detect_from_tip(read, reorg_search.reader(node), state, first=4).collect()}
    assert found == {1: ("ok", None, 99), 2: ("reorg", 84, 83)}
    assert asked == [{1: (99, 99), 2: (99, 99)}, {2: (95, 98)}, {2: (87, 94)}, {2: (71, 86)}]
    one = reorg_search.rows_within(stored, 10, {1: (99, 99)})
    one.collect()
    metrics = one._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    assert metrics.apply("numFiles").value() == 1
