"""Plans of the registered queries on the smallest tables."""

import os
import re

import pytest

from ledgerloom.catalog import QUERIES
from ledgerloom.oracle import ORACLE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plan(spark, key):
    return QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", [k for k in QUERIES if not k.startswith(("src_", "st_apply", "st_balance"))])
def test_no_cross_join_python_or_single_partition_window(spark, key):
    text = plan(spark, key)
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython",
                   "MapInPandas", "FlatMapGroupsInPandas"):
        assert banned not in text
    # A window prints its partition list and then its order list.
    for line in text.splitlines():
        if re.search(r"\bWindow \[", line):
            assert re.search(r"\], \[[^\]]+\], \[[^\]]+\]$", line), line


@pytest.mark.parametrize("key", ["win_last_writer", "win_first_writer", "snk_blocks_upsert"])
def test_writers_reduce_before_the_shuffle(spark, key):
    before = plan(spark, key).split("Exchange hashpartitioning")[1]
    assert "partial_max_by" in before or "partial_min_by" in before


@pytest.mark.parametrize("key", ["top_logs", "top_transactions", "top_balances", "q_logs", "flt_logs_after"])
def test_limited_sorts_are_top_k(spark, key):
    assert "TakeOrderedAndProject" in plan(spark, key)


def test_transaction_address_filter_is_pushed(spark):
    assert "Or(EqualTo(from_addr" in plan(spark, "flt_transactions")


@pytest.mark.parametrize("key", ["flt_logs", "flt_logs_after", "q_logs", "flt_transactions"])
def test_block_bounds_prune_folders(spark, key):
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan(spark, key))
    assert any(re.search(r"block_bucket#\d+L [><]= \d", f) for f in filters), filters


def test_block_range_reads_one_column(spark):
    assert "ReadSchema: struct<block_number:bigint>" in plan(spark, "agg_block_range")
