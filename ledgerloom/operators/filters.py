"""Optional filters, limits and keyset pages over the tables.

Stored hashes and addresses are lower case, so a filter lowers its literal and compares
the bare column: the predicate reaches the Parquet scan. On a table read with its
``block_bucket`` column, ``bucket_width`` turns block bounds into bounds on directories.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.functions.hexnum import is_fixed_hex
from ledgerloom.sources.tables import bucket_bounds

LOG_ORDER = ["block_number", "log_index", "chain_id", "tx_hash", "block_hash"]
TRANSACTION_ORDER = ["block_number", "tx_index", "chain_id", "tx_hash"]
BALANCE_ORDER = ["chain_id", "address"]
SUMMARY_ORDER = ["block_number", "chain_id", "tx_hash"]


def effective_limit(limit: int, default: int = S.DEFAULT_LIMIT, maximum: int = S.MAX_LIMIT) -> int:
    """A limit out of range falls back to the default; it is not clamped."""
    return limit if 0 < limit <= maximum else default


def check_unsigned(name: str, value: int | None) -> int | None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
        raise ValueError(f"invalid {name}")
    return value


@dataclass(frozen=True)
class LogFilter:
    chain_id: int | None = None
    address: str = ""
    tx_hash: str = ""
    from_block: int | None = None
    to_block: int | None = None
    limit: int = S.DEFAULT_LIMIT
    bucket_width: int | None = None

    def __post_init__(self) -> None:
        for name in ("chain_id", "from_block", "to_block", "limit"):
            check_unsigned(name, getattr(self, name))

    def _address(self) -> Column:
        return F.col("address") == self.address.lower()

    def predicates(self) -> list[Column]:
        found = []
        if self.address:
            found.append(self._address())
        if self.chain_id is not None:
            found.append(F.col("chain_id") == self.chain_id)
        if self.tx_hash:
            found.append(F.col("tx_hash") == self.tx_hash.lower())
        if self.from_block is not None:
            found.append(F.col("block_number") >= self.from_block)
        if self.to_block is not None:
            found.append(F.col("block_number") <= self.to_block)
        if self.bucket_width:
            found += bucket_bounds(self.from_block, self.to_block, self.bucket_width)
        return found

    def apply(self, table: DataFrame) -> DataFrame:
        for predicate in self.predicates():
            table = table.where(predicate)
        return table


@dataclass(frozen=True)
class TransactionFilter(LogFilter):
    """Same filters; the address is the sender or the recipient."""

    def _address(self) -> Column:
        address = self.address.lower()
        return (F.col("from_addr") == address) | (F.col("to_addr") == address)


@dataclass(frozen=True)
class BalanceFilter:
    chain_id: int | None = None
    address: str = ""
    limit: int = S.DEFAULT_LIMIT

    def __post_init__(self) -> None:
        check_unsigned("chain_id", self.chain_id)
        check_unsigned("limit", self.limit)

    def apply(self, table: DataFrame) -> DataFrame:
        if self.address:
            table = table.where(F.col("address") == self.address.lower())
        if self.chain_id is not None:
            table = table.where(F.col("chain_id") == self.chain_id)
        return table


def top(table: DataFrame, order: list[str], limit: int) -> DataFrame:
    """First rows in a total order; plans as TakeOrderedAndProject."""
    return table.orderBy(*order).limit(effective_limit(limit))


def top_logs(logs: DataFrame, limit: int = S.DEFAULT_LIMIT) -> DataFrame:
    return top(logs, LOG_ORDER, limit)


def top_transactions(transactions: DataFrame, limit: int = S.DEFAULT_LIMIT) -> DataFrame:
    return top(transactions, TRANSACTION_ORDER, limit)


def top_balances(balances: DataFrame, limit: int = S.DEFAULT_LIMIT) -> DataFrame:
    return top(balances, BALANCE_ORDER, limit)


def logs_after(
    logs: DataFrame, chain_id: int, block: int, log_index: int, limit: int = 0, bucket_width: int | None = None
) -> DataFrame:
    """Keyset page: the logs of a chain after (block, log_index), in order.

    ``block_number >= block`` is implied; stated on its own it reaches the scan.
    """
    later = (F.col("block_number") > block) | (
        (F.col("block_number") == block) & (F.col("log_index") > log_index)
    )
    page = logs.where(F.col("chain_id") == chain_id).where(F.col("block_number") >= block).where(later)
    if bucket_width:
        for bound in bucket_bounds(block, None, bucket_width):
            page = page.where(bound)
    return page.orderBy(*LOG_ORDER).limit(effective_limit(limit, S.DEFAULT_PAGE, S.MAX_PAGE))


def block_hashes(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored hashes of many (chain_id, block_number); absent blocks have no row."""
    return wanted.select(*S.BLOCK_KEY).distinct().join(
        blocks.select(*S.BLOCK_KEY, "block_hash"), S.BLOCK_KEY
    )


def ingest_filter(logs: DataFrame, address: str = "", event_id: str = "") -> DataFrame:
    """Logs of one contract and/or one event. Blocks, transactions and receipts stay whole."""
    if address and not is_fixed_hex(address, 42):
        raise ValueError("contract address must be 0x and 40 hex digits")
    if event_id and not is_fixed_hex(event_id, 66):
        raise ValueError("event id must be 0x and 64 hex digits")
    if address:
        logs = logs.where(F.col("address") == address.lower())
    if event_id:
        logs = logs.where(F.lower(F.get("topics", F.lit(0))) == event_id.lower())
    return logs
