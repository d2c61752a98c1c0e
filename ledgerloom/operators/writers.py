"""Writer rules as set operations over rows that carry an order column.

A table that replaces rows on a duplicate key is the *last* writer per key, a table
that ignores duplicates is the *first* writer per key. Both are aggregates, so a key
delivered a billion times is reduced to one row per map task before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.functions.fields import blank_to_null, blank_to_zero


def _pick(df: DataFrame, key: list[str], order: str, choose) -> DataFrame:
    rest = [c for c in df.columns if c not in key and c != order]
    picked = df.groupBy(*key).agg(choose(F.struct(order, *rest), F.col(order)).alias("_row"))
    return picked.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def last_writer(df: DataFrame, key: list[str], order: str = "seq", wide: bool = False) -> DataFrame:
    """Last row per key. ``wide`` is for rows with long texts and many versions, see ``_latest_only``."""
    return _pick(_latest_only(df, key, order) if wide else df, key, order, F.max_by)


def _latest_only(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows with the highest order of their key; several where a row was delivered again.

    A pick over text sorts all rows that a task reads, whole. Here the highest order is found by a hash aggregate over the
    narrow columns, and rows pass a hash join by key and order unsorted, so versions of one key are spread: only what is left
    is sorted, at the size of a shuffle partition. Every version is shuffled once, which is the price.
    """
    both = [*key, order]
    latest = df.groupBy(*key).agg(F.max(order).alias(order)).select(*[F.col(c).alias(f"_{c}") for c in both])
    # NULLs are values here, as they are to a group-by
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in both])
    return df.join(latest.hint("shuffle_hash"), same, "left_semi")


def first_writer(df: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    return _pick(df, key, order, F.min_by)


def not_stored(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is absent from the stored table."""
    return incoming.join(stored.select(*key), key, "left_anti")


def insert_ignore(stored: DataFrame, incoming: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """Rows an insert that ignores duplicates adds: first per key, not stored yet.

    Duplicates are reduced before the join, so the join sees each key once per side.
    """
    return not_stored(first_writer(incoming, key, order), stored, key)


# --- normalisation on write --------------------------------------------------------------


def _normalise(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.select(*[rules.get(c, F.col(c)) for c in df.columns])


def _lower(*names: str) -> dict[str, Column]:
    return {n: F.lower(n).alias(n) for n in names}


def normalise_logs(logs: DataFrame) -> DataFrame:
    return _normalise(logs, _lower("block_hash", "tx_hash", "address"))


def normalise_transactions(transactions: DataFrame) -> DataFrame:
    rules = _lower("tx_hash", "block_hash", "from_addr")
    rules["to_addr"] = blank_to_null("to_addr")
    rules["value"] = blank_to_zero("value")
    rules["gas_price"] = blank_to_zero("gas_price")
    return _normalise(transactions, rules)


def normalise_receipts(receipts: DataFrame) -> DataFrame:
    rules = _lower("tx_hash", "block_hash")
    rules["contract_address"] = blank_to_null("contract_address")
    rules["effective_gas_price"] = blank_to_zero("effective_gas_price")
    return _normalise(receipts, rules)


def upsert_blocks(versions: DataFrame, order: str = "seq") -> DataFrame:
    return last_writer(versions, S.BLOCK_KEY, order)


def upsert_transactions(versions: DataFrame, order: str = "seq") -> DataFrame:
    return last_writer(normalise_transactions(versions), S.TX_KEY, order)


def upsert_receipts(versions: DataFrame, order: str = "seq", wide: bool = False) -> DataFrame:
    return last_writer(normalise_receipts(versions), S.TX_KEY, order, wide)


# --- deletes and state -------------------------------------------------------------------


def delete_from(table: DataFrame, chain_id: int, from_block: int) -> DataFrame:
    """Rows that survive deleting a chain from a block upwards."""
    return table.where(~((F.col("chain_id") == chain_id) & (F.col("block_number") >= from_block)))


def set_state(updates: DataFrame, order: str = "seq") -> DataFrame:
    """Watermark per chain from ordered (chain_id, last_processed_block) updates."""
    # Single columns, not a row: fixed-width buffers stay in a hash aggregate.
    return updates.groupBy(*S.STATE_KEY).agg(
        F.max_by("last_processed_block", order).alias("last_processed_block"),
        F.max(order).alias(order),
    )


def clear_state(state: DataFrame, chain_ids: list[int]) -> DataFrame:
    return state.where(~F.col("chain_id").isin(*chain_ids))


# --- evolution ---------------------------------------------------------------------------


def evolve(df: DataFrame, column: str, data_type: str, default) -> DataFrame:
    """Add a column with a default when it is missing; an existing column is left alone."""
    if column in df.columns:
        return df
    return df.withColumn(column, F.lit(default).cast(data_type))


def union_evolved(old: DataFrame, new: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Old and new files together; columns only one side has take their default."""
    merged = old.unionByName(new, allowMissingColumns=True)
    return merged.select(
        *[
            F.coalesce(F.col(c), F.lit(defaults[c]).cast(merged.schema[c].dataType)).alias(c)
            if c in defaults
            else F.col(c)
            for c in merged.columns
        ]
    )
