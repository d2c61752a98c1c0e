from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.operators import writers as W


def receipts(spark, rows):
    """(tx_hash, seq, bloom) as receipts of chain 1."""
    df = spark.createDataFrame(rows, "tx_hash string, seq bigint, logs_bloom string").withColumn("chain_id", F.lit(1).cast("bigint"))
    for field in S.RECEIPTS.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.select(*S.RECEIPTS.fieldNames(), "seq")


def test_wide_upsert_gives_the_same_rows(spark):
    rows = [("0xA", 1, "x"), ("0xa", 3, "y"), ("0xa", 3, "y"), ("0xb", 2, "z"), (None, 5, "n"), (None, 4, "m"), ("0xc", None, "q")]
    versions = receipts(spark, rows)
    found = {wide: sorted(map(str, W.upsert_receipts(versions, wide=wide).collect())) for wide in (False, True)}
    assert found[True] == found[False]
    assert len(found[True]) == 4


def test_wide_upsert_sorts_only_what_the_join_leaves(spark, tmp_path):
    receipts(spark, [("0xa", 1, "x")]).write.parquet(str(tmp_path / "t"))
    plan = W.upsert_receipts(spark.read.parquet(str(tmp_path / "t")), wide=True)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("ShuffledHashJoin", 1)
    assert "Sort [" in above and "Sort [" not in below
