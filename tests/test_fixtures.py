"""How the driver's tables are landed: only narrow rows are moved, and landed text is compressed in bounded files."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom import fixtures as X
from ledgerloom import schemas as S
from ledgerloom.sources import rpc, tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def test_landed_responses_are_compressed_in_bounded_files(spark, monkeypatch):
    monkeypatch.setattr(X, "LINES_PER_FILE", 100)
    monkeypatch.setattr(X, "_LANDED", {})
    fx = X.Fixtures(spark, SF)
    path = fx.land_blocks()
    files = list(Path(path).rglob("part-*"))
    assert files and all(f.suffix == ".gz" for f in files)
    landed = rpc.read_landed(spark, path)
    assert landed.count() == fx.table("orders").count()
    assert landed.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 100


def test_lines_meet_before_they_are_collected(spark):
    plan = X.Fixtures(spark, SF)._orders_with_lines()._jdf.queryExecution().sparkPlan().toString()
    moved = plan[plan.index("ObjectHashAggregate"):]
    assert moved.count("collect_list") and "RepartitionByExpression" not in plan
    assert re.search(r"partial_collect_list[\s\S]*Exchange hashpartitioning\(l_orderkey", moved)


def test_rows_are_spread_before_hashes_are_made(spark):
    fx = X.Fixtures(spark, SF)
    assert not {"tx_hash", "block_hash", "to_addr"} & set(fx.placed_lines.columns)


def test_append_finishes_rows_in_place(spark, tmp_path):
    rows = spark.range(1000).selectExpr("1 + id % 3 as chain_id", "id % 50 as block_number", "id as log_index")

    def finish(df):
        return df.selectExpr(*[f"{e} as {n}" if e != n else n for n, e in (
            ("chain_id", "chain_id"), ("block_number", "block_number"), ("log_index", "log_index"),
            ("tx_hash", "sha2(concat('t', log_index), 256)"), ("block_bucket", "block_bucket"),
        )])

    path = str(tmp_path / "t")
    tables.append(rows, path, "log_index", 10, finish=finish)
    found = tables.scan(spark, path, S.LOGS, width=10).select("chain_id", "block_number", "log_index", "tx_hash")
    want = finish(tables.with_bucket(rows, 10)).drop("block_bucket")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    for file in Path(path).rglob("*.parquet"):
        kept = [(r.block_number, r.log_index) for r in spark.read.parquet(str(file)).collect()]
        assert kept == sorted(kept)


@pytest.mark.parametrize(("rows", "files", "a_batch"), [(7, 3, 1), (10, 4, 2), (31, 11, 4)])
def test_messages_come_in_bounded_files_and_three_batches(spark, monkeypatch, rows, files, a_batch):
    monkeypatch.setattr(X, "MESSAGES_PER_FILE", 3)
    monkeypatch.setattr(X.Fixtures, "table", lambda fx, name: fx.spark.range(rows).withColumnRenamed("id", "event_id"))
    fx = X.Fixtures(spark, SF)
    assert fx.message_files == files
    assert -(-fx.message_files // fx.files_per_batch) <= 3 and fx.files_per_batch == a_batch


@pytest.mark.parametrize("height", [0, 199, 6399, 6400, 60_000, 3_600_000])
def test_the_number_of_folders_does_not_grow_with_the_chain(height):
    width = tables.fitting_width(height, 200)
    assert height // width < 32
    assert width == 200 or height // (width // 2) >= 32
