from ledgerloom.plans import ingest as I


def test_rows_in_ranges_are_not_dealt_by_chain(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = spark.range(100).selectExpr("1 + id % 2 as chain_id", "id as block_number")
    ranges = spark.createDataFrame([(1, 10, 20), (2, 95, 200)], "chain_id bigint, from_block bigint, to_block bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = I.in_ranges(rows, ranges)
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.block_number for r in found.collect()) == [10, 12, 14, 16, 18, 20, 95, 97, 99]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
