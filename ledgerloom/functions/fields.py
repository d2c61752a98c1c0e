"""Small column rules used by the jobs: blanks, lower-casing, event words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.hexnum import WORD_DIGITS, strip_0x_sql


def blank_to_null(name: str) -> Column:
    return F.nullif(F.lower(name), F.lit("")).alias(name)


def blank_to_zero(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("0")).alias(name)


def null_to_blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def event_matches(event_id: str) -> Column:
    """First topic equals the event id, ignoring case; no topics never match."""
    return F.lower(F.get("topics", F.lit(0))).eqNullSafe(F.lit(event_id.lower()))


def is_address_topic_sql(topic: str) -> str:
    """A 32-byte topic, whose low 20 bytes hold an address."""
    return f"(startswith({topic}, '0x') and length({topic}) = 66)"


def topic_address_sql(topic: str) -> str:
    return f"concat('0x', lower(substring({topic}, 27)))"


def has_word_sql(data: str) -> str:
    """Data that starts with 64 hex digits. Later bytes are ignored."""
    return f"({data} rlike '^(0x)?[0-9a-fA-F]{{{WORD_DIGITS}}}')"


def data_word_sql(data: str) -> str:
    """First 64 digits of the data; meaningful where ``has_word_sql`` holds."""
    return f"substring({strip_0x_sql(data)}, 1, {WORD_DIGITS})"
