"""Exact 256-bit balances per (chain, address).

The balance of an address is the sum of the amounts of all logs of one event that name
it in their second topic. It only grows: there is no debit side, and logs flagged
``removed`` count unless asked otherwise. Partial sums are kept as limb columns, which
add up across batches; text is made once per address at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.functions.fields import (
    data_word_sql,
    event_matches,
    has_word_sql,
    is_address_topic_sql,
    topic_address_sql,
)
from ledgerloom.functions.hexnum import LIMB_COLUMNS, limbs_to_text, sum_limbs, with_limbs

_ZERO_WORD = "0" * 64

# --- fixed values: why a matching log credits nobody ------------------------------------
NO_ADDRESS = "missing indexed address topic"
BAD_ADDRESS = "invalid topic address"
BAD_AMOUNT = "invalid amount data"


_TOPIC = "get(topics, 1)"
_HAS_TOPIC = "size(topics) >= 2"
_IS_ADDRESS = is_address_topic_sql(_TOPIC)
_HAS_AMOUNT = has_word_sql("data")


def matching(logs: DataFrame, event_id: str, skip_removed: bool = False) -> DataFrame:
    """Logs of the event. An empty event id switches balances off: the frame is empty."""
    if not event_id:
        return logs.where(F.lit(False))
    found = logs.where(event_matches(event_id))
    return found.where(~F.col("removed")) if skip_removed else found


def undecodable(logs: DataFrame, event_id: str) -> DataFrame:
    """Matching logs that credit nobody, with ``bad_reason``."""
    reason = (
        f"case when not {_HAS_TOPIC} then '{NO_ADDRESS}' when not {_IS_ADDRESS} then '{BAD_ADDRESS}' "
        f"when not {_HAS_AMOUNT} then '{BAD_AMOUNT}' end"
    )
    return matching(logs, event_id).withColumn("bad_reason", F.expr(reason)).where("bad_reason is not null")


def credits(logs: DataFrame, event_id: str, skip_removed: bool = False, extra: tuple = ()) -> DataFrame:
    """(chain_id, address, *extra, limbs) of every non-zero credit."""
    word = data_word_sql("data")
    good = (
        matching(logs, event_id, skip_removed)
        .where(f"{_HAS_TOPIC} and {_IS_ADDRESS}")
        .where(_HAS_AMOUNT)
        .where(f"{word} <> '{_ZERO_WORD}'")
    )
    named = good.select(
        "chain_id", F.expr(topic_address_sql(_TOPIC)).alias("address"), *extra, F.expr(word).alias("word")
    )
    return with_limbs(named, "word").drop("word")


def partial_sums(limbs: DataFrame, *keys: str) -> DataFrame:
    """Limb sums per (chain, address, *keys); adding partial sums is the same operation."""
    return limbs.groupBy(*S.BALANCE_KEY, *keys).agg(*sum_limbs())


def to_balances(sums: DataFrame) -> DataFrame:
    return limbs_to_text(sums, "balance")


def balances(logs: DataFrame, event_id: str, skip_removed: bool = False) -> DataFrame:
    """Balances of a log table without duplicate keys."""
    return to_balances(partial_sums(credits(logs, event_id, skip_removed)))


def add_deltas(stored_sums: DataFrame, deltas: DataFrame) -> DataFrame:
    """Stored limb sums plus new credits, reduced per batch before they meet."""
    new = partial_sums(deltas.withColumn("address", F.lower("address")))
    columns = [*S.BALANCE_KEY, *LIMB_COLUMNS]
    return partial_sums(stored_sums.select(*columns).unionByName(new.select(*columns)))


def reset(table: DataFrame, chain_id: int) -> DataFrame:
    """Everything but the balances of one chain."""
    return table.where(F.col("chain_id") != chain_id)


def rebuild(table: DataFrame, logs: DataFrame, event_id: str, chain_id: int) -> DataFrame:
    """Balances with one chain recomputed from its surviving logs."""
    fresh = balances(logs.where(F.col("chain_id") == chain_id), event_id)
    return reset(table, chain_id).unionByName(fresh)
