"""Hex text and 256-bit integers as built-in SQL expressions.

Everything here *builds* SQL text or Columns; nothing runs per row in Python.

A 256-bit word is 64 hex digits. Two splits of it are used:

* six **chunks** of 48 bits (12 digits, the top one 4 digits), lowest first. A chunk
  is one ``conv`` and always fits a BIGINT;
* eleven **limbs** of 24 bits, lowest first, two per chunk. A BIGINT sum of limbs is
  exact for 2^39 (5.5e11) rows per group, and ANSI mode raises instead of wrapping
  beyond that. Sums stay in hash aggregates with fixed-width buffers, so a hot
  address is reduced on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_DIGITS = 64
CHUNK_DIGITS = 12
CHUNKS = 6
LIMB_BITS = 24
LIMBS = 11
_LIMB_MASK = (1 << LIMB_BITS) - 1
BIGINT_DIGITS = "[0-7][0-9a-fA-F]{15}|[0-9a-fA-F]{1,15}"

LIMB_COLUMNS = [f"limb_{k}" for k in range(LIMBS)]
CHUNK_COLUMNS = [f"chunk_{j}" for j in range(CHUNKS)]


def strip_0x_sql(text: str) -> str:
    return f"(case when startswith({text}, '0x') then substring({text}, 3) else {text} end)"


def is_fixed_hex(value: str, length: int) -> bool:
    """Plan-time check of a configured address (42) or event id (66)."""
    return (
        value.startswith("0x")
        and len(value) == length
        and all(c in "0123456789abcdefABCDEF" for c in value[2:])
    )


def has_digits_sql(text: str, digits: str) -> str:
    """Hex text whose significant part matches ``digits``, after an optional 0x and zeros."""
    return f"({text} rlike '^(0x)?0*({digits})$')"


def fits_bigint_sql(text: str, optional: bool = False) -> str:
    """Whether :func:`hex_to_bigint_sql` has a value; never NULL."""
    fits = f"coalesce({has_digits_sql(text, BIGINT_DIGITS)}, false)"
    return f"(coalesce({text}, '') = '' or {fits})" if optional else fits


def hex_to_bigint_sql(text: str, optional: bool = False) -> str:
    """BIGINT value; NULL when empty, malformed or above 2^63-1. ``optional`` maps ''/NULL to 0."""
    fits = has_digits_sql(text, BIGINT_DIGITS)
    zero = f"when coalesce({text}, '') = '' then 0L " if optional else ""
    return f"(case {zero}when {fits} then cast(conv({strip_0x_sql(text)}, 16, 10) as bigint) end)"


def uint_to_hex_sql(number: str) -> str:
    return f"concat('0x', lower(hex({number})))"


def chunk_sqls(word: str) -> list[str]:
    """Six BIGINT chunks, lowest first, of a 64-digit hex word (no prefix)."""
    chunks = []
    for j in range(CHUNKS):
        end = WORD_DIGITS - CHUNK_DIGITS * j
        start = max(end - CHUNK_DIGITS, 0)
        chunks.append(
            f"cast(conv(substring({word}, {start + 1}, {end - start}), 16, 10) as bigint)"
        )
    return chunks


def limb_sqls(chunks: list[str]) -> list[str]:
    """Eleven 24-bit limbs, lowest first, of six 48-bit chunks."""
    limbs = []
    for chunk in chunks:
        limbs += [f"({chunk} & {_LIMB_MASK}L)", f"shiftright({chunk}, {LIMB_BITS})"]
    return limbs[:LIMBS]  # the top chunk has 16 bits only


def horner_text_sql(places: str) -> str:
    """Decimal text of an array of base-2^24 places, highest first, each below 2^40.

    Horner's rule over eleven base-10^9 digits (99 decimal digits, above any sum of
    BIGINT limbs). Compact and exact for any width, but interpreted: used only where
    DECIMAL(38,0) is too narrow.
    """
    step = f"digit * {1 << LIMB_BITS}L + state.carry"
    return (
        f"coalesce(nullif(aggregate({places}, array_repeat(0L, 11), "
        "(digits, place) -> aggregate(digits, "
        "named_struct('carry', place, 'out', cast(array() as array<bigint>)), "
        f"(state, digit) -> named_struct('carry', ({step}) div 1000000000L, "
        f"'out', concat(state.out, array(({step}) % 1000000000L))), "
        "state -> state.out), "
        "digits -> ltrim('0', array_join(transform(reverse(digits), "
        "digit -> lpad(cast(digit as string), 9, '0')), ''))), ''), '0')"
    )


def fits_decimal_sql(text: str) -> str:
    """Whether :func:`hex_to_decimal_sql` has a value; never NULL."""
    fits = has_digits_sql(text, "[0-9a-fA-F]{1,64}")
    return f"(coalesce({text}, '') in ('', '0x') or coalesce({fits}, false))"


def hex_to_decimal_sql(text: str) -> str:
    """Decimal text of a hex number up to 256 bits; NULL/''/'0x' give '0', malformed gives NULL.

    Up to 64 bits ``conv`` does it alone, up to 120 bits two of them in a DECIMAL,
    beyond that Horner's rule.
    """
    digits = strip_0x_sql(text)
    padded = f"lpad(ltrim('0', {digits}), {LIMBS * 6}, '0')"
    high, low = (
        f"cast(conv(substring({padded}, {p}, 15), 16, 10) as decimal(20,0))" for p in (37, 52)
    )
    places = (
        f"transform(sequence(1, {LIMBS * 6}, 6), "
        f"p -> cast(conv(substring({padded}, p, 6), 16, 10) as bigint))"
    )
    return (
        f"(case when coalesce({text}, '') in ('', '0x') then '0' "
        f"when {has_digits_sql(text, '[0-9a-fA-F]{1,16}')} then conv({digits}, 16, 10) "
        f"when {has_digits_sql(text, '[0-9a-fA-F]{1,30}')} then cast({high} * {1 << 60}BD + {low} as string) "
        f"when {has_digits_sql(text, '[0-9a-fA-F]{1,64}')} then {horner_text_sql(places)} end)"
    )


def with_limbs(df: DataFrame, word: str) -> DataFrame:
    """Add the eleven limb columns of the hex word expression ``word``."""
    chunked = df.select("*", *[F.expr(c).alias(n) for n, c in zip(CHUNK_COLUMNS, chunk_sqls(word))])
    limbs = [F.expr(x).alias(n) for n, x in zip(LIMB_COLUMNS, limb_sqls(CHUNK_COLUMNS))]
    return chunked.select(*df.columns, *limbs)


def sum_limbs() -> list[Column]:
    return [F.sum(name).alias(name) for name in LIMB_COLUMNS]


def limbs_to_text(df: DataFrame, out: str) -> DataFrame:
    """Replace summed limb columns by the exact decimal text of their value.

    Bits 24..62 of each sum are moved to the next place first, which leaves every
    place below 2^40. Sums below 2^120, and somewhat above, then fit a DECIMAL(38,0).
    """
    kept = [c for c in df.columns if c not in LIMB_COLUMNS]
    names = [f"place_{k}" for k in range(LIMBS + 1)]
    places = []
    for k, name in enumerate(names):
        own = f"(limb_{k} & {_LIMB_MASK}L)" if k < LIMBS else "0L"
        carried = f"shiftright(limb_{k - 1}, {LIMB_BITS})" if k else "0L"
        places.append(F.expr(f"{own} + {carried}").alias(name))
    staged = df.select(*kept, *places)
    narrow = " + ".join(f"{n} * {1 << (LIMB_BITS * k)}BD" for k, n in enumerate(names[:5]))
    is_narrow = f"place_4 < {1 << 28}L and " + " and ".join(f"{n} = 0" for n in names[5:])
    wide = horner_text_sql(f"array({', '.join(reversed(names))})")
    text = f"case when {is_narrow} then cast({narrow} as string) else {wide} end"
    return staged.select(*kept, F.expr(text).alias(out))
