"""Landed node responses: one JSON response per line, numbers as hex text.

The chain of a response is not part of it; the landing folder or a column names it.
A response is taken or refused as a whole: one with a part that cannot be read gives no
transaction or log, and :func:`refused_blocks` or :func:`refused_logs` lists it, so nothing
vanishes unseen. Rows of blocks and receipts are told apart by :func:`valid` and :func:`invalid`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schemas as S
from ledgerloom.functions.once import compute_once
from ledgerloom.functions.hexnum import fits_bigint_sql, fits_decimal_sql, hex_to_bigint_sql, hex_to_decimal_sql

# --- fixed values: response status ---------------------------------------------------------
OK = "ok"
FAILED = "failed"
UNAVAILABLE = "unavailable"
INVALID = "invalid"

LANDED = T.StructType(
    [T.StructField("chain_id", T.LongType()), T.StructField("value", T.StringType())]
)


def read_landed(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(chain_id, value) lines below ``path/chain_id=<n>/``."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(LANDED).text(path)


def envelope(landed: DataFrame, result: T.DataType, probe: str | None) -> DataFrame:
    """Responses with their parsed ``result`` and a ``status``.

    An error or a missing result failed; a null result, or a blank ``probe`` field in it,
    means the node does not have the item yet.
    """
    shape = T.StructType(
        [
            T.StructField("result", result),
            T.StructField(
                "error",
                T.StructType(
                    [T.StructField("code", T.LongType()), T.StructField("message", T.StringType())]
                ),
            ),
            T.StructField("_corrupt", T.StringType()),
        ]
    )
    parsed = compute_once(
        landed,
        ["*"],
        [
            F.from_json("value", shape, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"),
            # from_json does not tell a null result from a missing one; the raw text does.
            F.col("value").rlike(r'"result"\s*+:\s*+null').alias("null_result"),
        ],
    )
    absent = F.col("r.result").isNull()
    if probe:
        absent = absent | (F.coalesce(F.col(f"r.result.{probe}"), F.lit("")) == "")
    status = (
        F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), FAILED)
        .when(F.col("r.error").isNotNull(), FAILED)
        .when(F.col("r.result").isNull() & ~F.col("null_result"), FAILED)
        .when(absent, UNAVAILABLE)
        .otherwise(OK)
    )
    kept = [c for c in landed.columns if c != "value"]
    return parsed.select(
        *kept,
        status.alias("status"),
        F.when(F.col("r.error").isNotNull(), F.col("r.error.message")).alias("error"),
        F.col("r.result").alias("result"),
    )


def _uint(path: str, name: str) -> Column:
    return F.expr(hex_to_bigint_sql(path)).alias(name)


def _uint_or_zero(path: str, name: str) -> Column:
    return F.expr(hex_to_bigint_sql(path, optional=True)).alias(name)


def _decimal(path: str, name: str) -> Column:
    return F.expr(hex_to_decimal_sql(path)).alias(name)


def _lower(path: str, name: str) -> Column:
    return F.lower(F.coalesce(F.col(path), F.lit(""))).alias(name)


def _text(path: str, name: str) -> Column:
    return F.coalesce(F.col(path), F.lit("")).alias(name)


def _ready(landed: DataFrame, result: T.DataType, probe: str | None) -> DataFrame:
    return envelope(landed, result, probe).where(F.col("status") == OK)


def _whole(landed: DataFrame, result: T.DataType, probe: str | None, bad_parts: str) -> DataFrame:
    """Usable responses without bad parts.

    ``bad_parts`` counts them inside the response, so no row carries an id back to it and
    nothing is shuffled or joined; a part's numbers are matched here and parsed once later.
    """
    return _ready(landed, result, probe).where(F.expr(bad_parts) == 0)


def _bad(parts: str, unfit: list[str]) -> str:
    """How many elements of an array fail one of the tests on ``x``; null elements are bad."""
    return f"size(filter(coalesce({parts}, array()), x -> x is null or not ({' and '.join(unfit)})))"


_TX_FITS = [
    *[fits_bigint_sql(f"x.{n}", optional=True) for n in ("transactionIndex", "nonce", "gas", "type")],
    *[fits_decimal_sql(f"x.{n}") for n in ("value", "gasPrice")],
]
_BLOCK_FITS = [fits_bigint_sql(f"result.{n}") for n in ("number", "timestamp", "gasLimit", "gasUsed")]
BAD_TRANSACTIONS = _bad("result.transactions", _TX_FITS)
BAD_IN_BLOCK = f"({BAD_TRANSACTIONS} + if({' and '.join(_BLOCK_FITS)}, 0, 1))"
BAD_IN_LOGS = _bad("result", [fits_bigint_sql("x.blockNumber"), fits_bigint_sql("x.logIndex")])


def refused_blocks(landed: DataFrame) -> DataFrame:
    """(chain_id, status, bad_parts, result) of block responses with bad parts, the block's own numbers as one."""
    return _refused(landed, S.RPC_BLOCK, "hash", BAD_IN_BLOCK)


def refused_logs(landed: DataFrame) -> DataFrame:
    """The same of log responses, for :func:`logs`."""
    return _refused(landed, S.RPC_LOGS, None, BAD_IN_LOGS)


def _refused(landed: DataFrame, result: T.DataType, probe: str | None, bad_parts: str) -> DataFrame:
    counted = compute_once(
        _ready(landed, result, probe), ["chain_id", "result"], [F.expr(bad_parts).alias("bad_parts")]
    )
    return counted.where("bad_parts > 0").select(
        "chain_id", F.lit(INVALID).alias("status"), F.col("bad_parts").cast("bigint"), "result"
    )


def _rows(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Parsed columns beside the chain; hex is parsed once even when rows are filtered on it."""
    return compute_once(df, ["chain_id"], columns)


def blocks(landed: DataFrame) -> DataFrame:
    """Block rows of responses whose transactions are all sound. ``tx_count`` is the length of the transaction array.

    A block whose own numbers are bad stays a row of :func:`invalid`; its transactions are refused.
    """
    return _rows(
        _whole(landed, S.RPC_BLOCK, "hash", BAD_TRANSACTIONS),
        [
            _uint("result.number", "block_number"),
            _lower("result.hash", "block_hash"),
            _lower("result.parentHash", "parent_hash"),
            _uint("result.timestamp", "timestamp"),
            _uint("result.gasLimit", "gas_limit"),
            _uint("result.gasUsed", "gas_used"),
            F.coalesce(F.size("result.transactions"), F.lit(0)).cast("bigint").alias("tx_count"),
        ],
    )


def light_blocks(landed: DataFrame) -> DataFrame:
    """Number and hashes of block responses that list their transactions as hashes only.

    Blocks the node does not have give no row; ``reorg.detect`` then knows them as missing.
    """
    return _rows(
        _ready(landed, S.RPC_LIGHT_BLOCK, "hash"),
        [
            _uint("result.number", "block_number"),
            _lower("result.hash", "block_hash"),
            _lower("result.parentHash", "parent_hash"),
        ],
    )


def heads(landed: DataFrame) -> DataFrame:
    """(chain_id, latest_block): the highest head among the answers of each chain's node."""
    answers = _rows(_ready(landed, T.StringType(), None), [_uint("result", "latest_block")])
    return valid(answers).groupBy("chain_id").agg(F.max("latest_block").alias("latest_block"))


def transactions(landed: DataFrame) -> DataFrame:
    """Transaction rows of whole responses; number and hash of the block come from the enclosing block."""
    exploded = _whole(landed, S.RPC_BLOCK, "hash", BAD_IN_BLOCK).select(
        "chain_id",
        F.col("result.number").alias("number"),
        F.col("result.hash").alias("block"),
        F.explode("result.transactions").alias("t"),
    )
    return _rows(
        exploded,
        [
            _lower("t.hash", "tx_hash"),
            _uint("number", "block_number"),
            _lower("block", "block_hash"),
            _uint_or_zero("t.transactionIndex", "tx_index"),
            _lower("t.from", "from_addr"),
            _lower("t.to", "to_addr"),
            _decimal("t.value", "value"),
            _uint_or_zero("t.nonce", "nonce"),
            _uint_or_zero("t.gas", "gas"),
            _decimal("t.gasPrice", "gas_price"),
            _text("t.input", "input"),
            _uint_or_zero("t.type", "tx_type"),
        ],
    )


def receipts(landed: DataFrame) -> DataFrame:
    return _rows(
        _ready(landed, S.RPC_RECEIPT, "transactionHash"),
        [
            _lower("result.transactionHash", "tx_hash"),
            _uint_or_zero("result.blockNumber", "block_number"),
            _lower("result.blockHash", "block_hash"),
            _uint_or_zero("result.transactionIndex", "tx_index"),
            _uint_or_zero("result.status", "status"),
            _uint_or_zero("result.cumulativeGasUsed", "cumulative_gas_used"),
            _uint_or_zero("result.gasUsed", "gas_used"),
            _lower("result.contractAddress", "contract_address"),
            _text("result.logsBloom", "logs_bloom"),
            _decimal("result.effectiveGasPrice", "effective_gas_price"),
        ],
    )


def logs(landed: DataFrame) -> DataFrame:
    """Log rows of whole array responses; block number and index are mandatory."""
    exploded = _whole(landed, S.RPC_LOGS, None, BAD_IN_LOGS).select("chain_id", F.explode("result").alias("l"))
    return _rows(
        exploded,
        [
            _uint("l.blockNumber", "block_number"),
            _lower("l.blockHash", "block_hash"),
            _lower("l.transactionHash", "tx_hash"),
            _uint("l.logIndex", "log_index"),
            _lower("l.address", "address"),
            _text("l.data", "data"),
            F.coalesce(F.col("l.topics"), F.array().cast("array<string>")).alias("topics"),
            F.coalesce(F.col("l.removed"), F.lit(False)).alias("removed"),
        ],
    )


def valid(rows: DataFrame) -> DataFrame:
    """Rows whose numbers all parsed."""
    return rows.where(~_invalid(rows))


def invalid(rows: DataFrame) -> DataFrame:
    """Rows with an empty, malformed or too wide number, for the dead-letter table."""
    return rows.where(_invalid(rows)).withColumn("status", F.lit(INVALID))


def _invalid(rows: DataFrame) -> Column:
    bad = F.lit(False)
    for field in rows.schema.fields:
        if isinstance(field.dataType, T.LongType) or field.name in (
            "value", "gas_price", "effective_gas_price",
        ):
            bad = bad | F.col(field.name).isNull()
    return bad
