import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.operators import balances as B

EVENT = "0x" + "ab" * 32


def word(n):
    return f"{n:064x}"


def topic(n):
    return "0x" + f"{n:040x}".rjust(64, "0")


def logs(spark, rows):
    full = [(1, i, "0xh", "0xt", i, "0xc", data, topics, removed) for i, (topics, data, removed) in enumerate(rows)]
    return spark.createDataFrame(full, S.LOGS)


def test_amounts_and_reasons(spark):
    rows = [
        ([EVENT.upper().replace("X", "x"), topic(1)], "0x" + word(2**256 - 1), False),
        ([EVENT, topic(1)], "0x" + word(2**256 - 1) + "ff" * 40, True),
        ([EVENT, topic(1)], word(2), False),
        ([EVENT, topic(2)], "0x" + word(0), False),
        ([EVENT], "0x" + word(1), False),
        ([EVENT, "0x12"], "0x" + word(1), False),
        ([EVENT, topic(3)], "0x12", False),
        ([EVENT, topic(3)], "0x" + "zz" * 32, False),
        ([EVENT, topic(3)], "0x" + "-" + "1" * 63, False),
        ([], "0x" + word(1), False),
        (["0x" + "cd" * 32, topic(4)], "0x" + word(1), False),
        ([EVENT, topic(0xABCDEF).upper().replace("X", "x")], "0x" + word(5), False),
    ]
    table = logs(spark, rows)
    got = {r.address: r.balance for r in B.balances(table, EVENT).collect()}
    assert got == {
        "0x" + f"{1:040x}": str(2 * (2**256 - 1) + 2),
        "0x" + f"{0xABCDEF:040x}": "5",
    }
    kept = {r.address: r.balance for r in B.balances(table, EVENT, skip_removed=True).collect()}
    assert kept["0x" + f"{1:040x}"] == str(2**256 + 1)
    reasons = [r.bad_reason for r in B.undecodable(table, EVENT).orderBy("block_number").collect()]
    assert reasons == [B.NO_ADDRESS, B.BAD_ADDRESS, B.BAD_AMOUNT, B.BAD_AMOUNT, B.BAD_AMOUNT]


def test_empty_event_id_gives_no_balances(spark):
    assert B.balances(logs(spark, [([EVENT, topic(1)], "0x" + word(1), False)]), "").count() == 0


def test_deltas_add_up_over_batches(spark):
    first = logs(spark, [([EVENT, topic(1)], "0x" + word(2**255), False)] * 3)
    second = logs(spark, [([EVENT, topic(1)], "0x" + word(7), False), ([EVENT, topic(2)], "0x" + word(9), False)])
    stored = B.partial_sums(B.credits(first, EVENT))
    total = B.to_balances(B.add_deltas(stored, B.credits(second, EVENT)))
    assert {int(r.address, 16): int(r.balance) for r in total.collect()} == {1: 3 * 2**255 + 7, 2: 9}


def test_reset_and_rebuild(spark):
    table = spark.createDataFrame([(1, "0xa", "1"), (2, "0xb", "2")], "chain_id bigint, address string, balance string")
    assert [r.chain_id for r in B.reset(table, 1).collect()] == [2]
    rebuilt = B.rebuild(table, logs(spark, [([EVENT, topic(5)], "0x" + word(3), False)]), EVENT, 1)
    assert sorted((r.chain_id, r.balance) for r in rebuilt.collect()) == [(1, "3"), (2, "2")]


def test_hot_address_is_combined_before_the_shuffle(spark):
    plan = B.balances(logs(spark, [([EVENT, topic(1)], "0x" + word(1), False)]), EVENT)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in text and text.count("Exchange") == 1
    assert "SortAggregate" not in text


@pytest.mark.parametrize("count", [1, 1000])
def test_many_equal_amounts(spark, count):
    table = logs(spark, [([EVENT, topic(1)], "0x" + word(2**200 + 1), False)]).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("n")
    ).drop("n")
    assert B.balances(table, EVENT).first().balance == str(count * (2**200 + 1))
