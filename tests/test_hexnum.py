import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import hexnum as H

EDGE = [0, 1, 2**63 - 1, 2**63, 2**64 - 1, 2**64, 2**120 - 1, 2**120, 2**128, 2**255, 2**256 - 1]


def test_hex_to_decimal_is_exact(spark):
    rng = random.Random(7)
    values = EDGE + [rng.getrandbits(rng.randint(1, 256)) for _ in range(200)]
    df = spark.createDataFrame([(f"0x{v:x}", str(v)) for v in values], "h string, want string")
    assert df.where(~F.expr(H.hex_to_decimal_sql("h")).eqNullSafe(F.col("want"))).count() == 0


@pytest.mark.parametrize(
    "text, bigint, optional, decimal",
    [
        ("0x", None, None, "0"),
        ("", None, 0, "0"),
        (None, None, 0, "0"),
        ("0x0", 0, 0, "0"),
        ("ff", 255, 255, "255"),
        ("0xFf", 255, 255, "255"),
        ("0x12zz", None, None, None),
        ("0X12", None, None, None),
        ("-1", None, None, None),
        ("0x7fffffffffffffff", 2**63 - 1, 2**63 - 1, str(2**63 - 1)),
        ("0x8000000000000000", None, None, str(2**63)),
        ("0x00000000000000000000000001", 1, 1, "1"),
        ("0x" + "f" * 65, None, None, None),
    ],
)
def test_hex_edges(spark, text, bigint, optional, decimal):
    row = spark.createDataFrame([(text,)], "h string").select(
        F.expr(H.hex_to_bigint_sql("h")).alias("a"),
        F.expr(H.hex_to_bigint_sql("h", optional=True)).alias("b"),
        F.expr(H.hex_to_decimal_sql("h")).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (bigint, optional, decimal)


def test_uint_to_hex_round_trip(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 255, 2**63 - 1)], "n bigint")
    back = df.select("n", F.expr(H.hex_to_bigint_sql(H.uint_to_hex_sql("n"))).alias("m"))
    assert all(r.n == r.m for r in back.collect())


def test_limb_sums_are_exact(spark):
    rng = random.Random(3)
    rows = [(g, v) for g in range(5) for v in EDGE + [2**256 - 1] * 3]
    rows += [(rng.randrange(5), rng.getrandbits(256)) for _ in range(300)]
    df = spark.createDataFrame([(g, f"{v:064x}") for g, v in rows], "g int, w string")
    sums = H.limbs_to_text(H.with_limbs(df, "w").groupBy("g").agg(*H.sum_limbs()), "total")
    want = {}
    for g, v in rows:
        want[g] = want.get(g, 0) + v
    assert {r.g: r.total for r in sums.collect()} == {g: str(v) for g, v in want.items()}


def test_limb_sums_of_largest_longs(spark):
    """Every limb sum at the top of BIGINT still converts exactly."""
    top = 2**63 - 1
    columns = ", ".join(f"{top}L as limb_{k}" for k in range(H.LIMBS))
    df = H.limbs_to_text(spark.sql(f"select 1 as g, {columns}"), "total")
    assert df.first().total == str(sum(top << (24 * k) for k in range(H.LIMBS)))


def test_fixed_hex():
    assert H.is_fixed_hex("0x" + "aB" * 20, 42)
    assert not H.is_fixed_hex("0x" + "ag" * 20, 42)
    assert not H.is_fixed_hex("aB" * 21, 42)


@pytest.mark.parametrize("shift", [95, 96, 97, 119, 120, 121, 123, 124, 125, 126, 127])
def test_sums_around_the_decimal_bound(spark, shift):
    value = (1 << shift) - 1
    df = spark.createDataFrame([(1, f"{value:064x}")] * 40, "g int, w string")
    total = H.limbs_to_text(H.with_limbs(df, "w").groupBy("g").agg(*H.sum_limbs()), "total")
    assert total.first().total == str(40 * value)
