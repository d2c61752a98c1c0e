"""Schemas, keys and limits shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: message types, in the order they are published -----------------
BLOCK = "block"
TRANSACTION = "transaction"
RECEIPT = "receipt"
LOG = "log"
REORG = "reorg"
MESSAGE_TYPES = (BLOCK, TRANSACTION, RECEIPT, LOG, REORG)

# --- fixed values: result limits ----------------------------------------------------
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
DEFAULT_PAGE = 1000
MAX_PAGE = 5000

# --- fixed values: integer bounds ---------------------------------------------------
MAX_BIGINT = 2**63 - 1

DEAD_LETTER = "dead_letter"

LOG_KEY = ["chain_id", "block_hash", "block_number", "tx_hash", "log_index"]
BLOCK_KEY = ["chain_id", "block_number"]
TX_KEY = ["chain_id", "tx_hash"]
BALANCE_KEY = ["chain_id", "address"]
STATE_KEY = ["chain_id"]

_BIGINT = T.LongType()
_STRING = T.StringType()
_UINT64 = T.DecimalType(20, 0)  # wide enough for 2^64-1; narrowed after the range check


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


RAW_MESSAGE = _struct(
    ("topic", _STRING),
    ("partition", T.IntegerType()),
    ("offset", _BIGINT),
    ("timestamp", T.TimestampType()),
    ("key", T.BinaryType()),
    ("value", T.BinaryType()),
)

# One wide, sparse message for all five types. An absent field means zero, '' or false.
ENVELOPE_FIELDS: list[tuple[str, str]] = [
    ("type", "string"),
    ("chain_id", "uint"),
    ("trace_id", "string"),
    ("block_number", "uint"),
    ("block_hash", "string"),
    ("parent_hash", "string"),
    ("timestamp", "uint"),
    ("block_gas_limit", "uint"),
    ("block_gas_used", "uint"),
    ("tx_count", "uint"),
    ("tx_hash", "string"),
    ("log_index", "uint"),
    ("address", "string"),
    ("data", "string"),
    ("topics", "array"),
    ("removed", "bool"),
    ("tx_index", "uint"),
    ("from", "string"),
    ("to", "string"),
    ("value", "string"),
    ("nonce", "uint"),
    ("gas", "uint"),
    ("gas_price", "string"),
    ("input", "string"),
    ("tx_type", "uint"),
    ("status", "uint"),
    ("cumulative_gas_used", "uint"),
    ("receipt_gas_used", "uint"),
    ("contract_address", "string"),
    ("logs_bloom", "string"),
    ("effective_gas_price", "string"),
    ("from_block", "uint"),
    ("reason", "string"),
]

_ENVELOPE_TYPES = {
    "string": _STRING,
    "uint": _UINT64,
    "array": T.ArrayType(_STRING),
    "bool": T.BooleanType(),
}

ENVELOPE = _struct(*[(n, _ENVELOPE_TYPES[k]) for n, k in ENVELOPE_FIELDS])


def envelope_fields(kind: str) -> list[str]:
    return [name for name, k in ENVELOPE_FIELDS if k == kind]


LOGS = _struct(
    ("chain_id", _BIGINT),
    ("block_number", _BIGINT),
    ("block_hash", _STRING),
    ("tx_hash", _STRING),
    ("log_index", _BIGINT),
    ("address", _STRING),
    ("data", _STRING),
    ("topics", T.ArrayType(_STRING)),
    ("removed", T.BooleanType()),
)

BLOCKS = _struct(
    ("chain_id", _BIGINT),
    ("block_number", _BIGINT),
    ("block_hash", _STRING),
    ("parent_hash", _STRING),
    ("timestamp", _BIGINT),
    ("gas_limit", _BIGINT),
    ("gas_used", _BIGINT),
    ("tx_count", _BIGINT),
)

TRANSACTIONS = _struct(
    ("chain_id", _BIGINT),
    ("tx_hash", _STRING),
    ("block_number", _BIGINT),
    ("block_hash", _STRING),
    ("tx_index", _BIGINT),
    ("from_addr", _STRING),
    ("to_addr", _STRING),
    ("value", _STRING),
    ("nonce", _BIGINT),
    ("gas", _BIGINT),
    ("gas_price", _STRING),
    ("input", _STRING),
    ("tx_type", _BIGINT),
)

RECEIPTS = _struct(
    ("chain_id", _BIGINT),
    ("tx_hash", _STRING),
    ("block_number", _BIGINT),
    ("block_hash", _STRING),
    ("tx_index", _BIGINT),
    ("status", _BIGINT),
    ("cumulative_gas_used", _BIGINT),
    ("gas_used", _BIGINT),
    ("contract_address", _STRING),
    ("logs_bloom", _STRING),
    ("effective_gas_price", _STRING),
)

# --- landed node responses: every number is hex text ---------------------------------
RPC_TRANSACTION = _struct(
    *[
        (name, _STRING)
        for name in (
            "hash", "blockHash", "blockNumber", "transactionIndex", "from", "to",
            "value", "nonce", "gas", "gasPrice", "input", "type",
        )
    ]
)
RPC_BLOCK = _struct(
    *[
        (name, _STRING)
        for name in ("hash", "parentHash", "number", "timestamp", "gasLimit", "gasUsed")
    ],
    ("transactions", T.ArrayType(RPC_TRANSACTION)),
)
RPC_LIGHT_BLOCK = _struct(*[(name, _STRING) for name in ("hash", "parentHash", "number")])
RPC_RECEIPT = _struct(
    *[
        (name, _STRING)
        for name in (
            "transactionHash", "blockHash", "blockNumber", "transactionIndex", "status",
            "cumulativeGasUsed", "gasUsed", "contractAddress", "logsBloom",
            "effectiveGasPrice",
        )
    ]
)
RPC_LOG = _struct(
    ("address", _STRING),
    ("topics", T.ArrayType(_STRING)),
    *[
        (name, _STRING)
        for name in ("data", "blockNumber", "blockHash", "transactionHash", "logIndex")
    ],
    ("removed", T.BooleanType()),
)
RPC_LOGS = T.ArrayType(RPC_LOG)
