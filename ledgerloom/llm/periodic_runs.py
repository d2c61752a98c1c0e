"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q that is at least ``least`` words and ``exponent`` periods long and that
no neighbouring word extends. The words of a batch of texts lie in one array. For every block size b = 2, 4, 8, ...:

* a run whose period p has b / 2 <= p < b holds a whole aligned block of b words at some s, and the same b words again at
  s + p or at s - p. All starts of such occurrences less than b away on one side form one arithmetic progression, and p is
  the distance to its first term; a nearer occurrence would give the run a smaller period.
* so each block asks for the occurrences of its words next to it. Equal blocks are an interval of the suffix array (sorted
  by prefix doubling, whose ranks after each round are these intervals), and the nearest greater and smaller start in an
  interval are range successor and predecessor queries to a wavelet matrix over the suffix array.

The distances are candidate periods. Each is extended to both sides by binary search over prefix hashes, and what is long
enough is compared word by word, so that hashes never decide. Only stretches where each word occurs again within b words,
for 3 p words or more, can hold a run of that size; no others enter the suffix array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import mixed, slices

LEAST = 6
EXPONENT = 4
BASE = 0x9E3779B97F4A7C15


@dataclass
class Bits:
    """A bit array that counts its ones before any place."""

    words: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(words).astype(np.int32)
        return cls(words, np.cumsum(ones, dtype=np.int32) - ones)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """Values of slots, asked for their order within ranges of slots. All queries are arrays."""

    def __init__(self, values: np.ndarray):
        self.depth = max(int(values.max(initial=0)).bit_length(), 1)
        self.levels, self.zeros = [], []
        for bit in reversed(range(self.depth)):
            ones = (values >> bit) & 1 == 1
            self.levels.append(Bits.of(ones))
            self.zeros.append(int(len(values) - ones.sum()))
            values = np.concatenate([values[~ones], values[ones]])

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many slots of [low, high) hold less than value."""
        total = np.zeros(len(low), np.int64)
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            a, b = bits.rank(low), bits.rank(high)
            one = (value >> (self.depth - 1 - k)) & 1 == 1
            total += np.where(one, (high - b) - (low - a), 0)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return total

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value with n smaller ones in [low, high)."""
        value = np.zeros(len(low), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            a, b = bits.rank(low), bits.rank(high)
            small = (high - b) - (low - a)
            one = n >= small
            n = np.where(one, n - small, n)
            value = value * 2 + one
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return value


def suffix_array(text: np.ndarray, visit) -> np.ndarray:
    """Start places in the order of their suffixes. Every text part ends in a symbol of its own.

    Prefix doubling: ``visit(b, rank, heads)`` is called for b = 1, 2, 4, ... with the first slot of the interval of all
    suffixes that share their first b symbols with the suffix at a place, and the first slots of all intervals.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    head = np.r_[True, text[order][1:] != text[order][:-1]]
    rank = np.empty(n, np.int64)
    b = 1
    while True:
        heads = np.flatnonzero(head)
        sizes = np.diff(np.r_[heads, n])
        rank[order] = np.repeat(heads, sizes)
        visit(b, rank, heads)
        shared = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(shared):
            return order
        at = order[shared]
        key = rank[at] * n + rank[np.minimum(at + b, n - 1)]
        by = np.argsort(key, kind="stable")
        order[shared], key = at[by], key[by]
        head[shared] = np.r_[True, key[1:] != key[:-1]]
        b *= 2


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] places, then those of starts[1], and so on."""
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))


def repeated_stretches(word: np.ndarray, text: np.ndarray, ends: np.ndarray, least: int, exponent: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(b, starts, ends) of the stretches that hold all runs with a period from b / 2 to b - 1."""
    n = len(word)
    order = np.lexsort((np.arange(n), word, text))
    next_at = np.full(n, 2 * n, np.int64)
    same = (word[order][1:] == word[order][:-1]) & (text[order][1:] == text[order][:-1])
    next_at[order[:-1][same]] = np.diff(order)[same]
    out, b = [], 2
    while exponent * (b // 2) <= np.diff(np.r_[0, ends]).max(initial=0):
        near = np.r_[False, next_at < b, False]
        edges = np.flatnonzero(near[1:] != near[:-1])
        start, end = edges[::2], edges[1::2]
        long = end - start >= max((exponent - 1) * (b // 2), least - (b - 1))
        start, end = start[long], end[long]
        if len(start):
            out.append((b, start, np.minimum(end + b, ends[text[start]])))
        b *= 2
    return out


def longest(symbols: np.ndarray, least: int, exponent: int, regions: list) -> np.ndarray:
    """Rows (start, end, period) of all runs of the symbols; ``regions`` as from :func:`repeated_stretches`."""
    n = len(symbols)
    asked: list[tuple[np.ndarray, ...]] = []
    by_size = dict((b, (x, y)) for b, x, y in regions)

    def visit(b, rank, heads):
        if b in by_size:
            x, y = by_size[b]
            first = -(-x // b)
            at = spread(first, np.maximum(y // b - first, 0)) * b
            low = rank[at]
            asked.append((np.full(len(at), b), at, low, np.r_[heads, n][np.searchsorted(heads, low, side="right")]))

    order = suffix_array(symbols, visit)
    if not asked:
        return np.zeros((0, 3), np.int64)
    b, at, low, high = (np.concatenate(x) for x in zip(*asked))
    several = high - low > 1
    b, at, low, high = b[several], at[several], low[several], high[several]
    tree = WaveletMatrix(order)
    own = tree.below(low, high, at)
    after, before = own + 1 < high - low, own > 0
    following = tree.nth(low[after], high[after], own[after] + 1)
    preceding = tree.nth(low[before], high[before], own[before] - 1)
    left = np.concatenate([at[after], preceding])
    period = np.concatenate([following - at[after], at[before] - preceding])
    size = np.concatenate([b[after], b[before]])
    fit = (period < size) & (2 * period >= size)
    pairs = np.unique(np.stack([left[fit], period[fit]], 1), axis=0)
    return extended(symbols, pairs[:, 0], pairs[:, 1], least, exponent)


def extended(symbols: np.ndarray, at: np.ndarray, period: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Rows (start, end, smallest period) of the long enough stretches with ``period`` around ``at``."""
    n = len(symbols)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)], dtype=np.uint64)
        back = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        prefix = np.r_[np.uint64(0), np.cumsum(mixed(symbols.astype(np.uint64) + np.uint64(1)) * back[1:], dtype=np.uint64)]

        def same(a, length):
            return prefix[a + length] - prefix[a] == (prefix[a + period + length] - prefix[a + period]) * power[period]

        left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k in reversed(range(max(n, 1).bit_length())):
            step = right + (1 << k)
            inside = np.flatnonzero(at + period + step <= n)
            ok = np.zeros(len(at), bool)
            ok[inside] = same(at, np.minimum(step, n - at - period))[inside]
            right = np.where(ok, step, right)
            step = left + (1 << k)
            inside = step <= at
            ok = same(np.maximum(at - step, 0), np.minimum(step, at)) & inside
            left = np.where(ok, step, left)
    start, end = at - left, at + period + right
    found = np.unique(np.stack([start, end, period], 1)[end - start >= np.maximum(least, exponent * period)], axis=0)
    # a hash may call unlike words alike, never like words unlike: compare, and mend what differs
    length = found[:, 1] - found[:, 0] - found[:, 2]
    places = spread(found[:, 0], length)
    unlike = symbols[places] != symbols[places + np.repeat(found[:, 2], length)]
    wrong = np.unique(np.repeat(np.arange(len(found)), length)[unlike])
    if len(wrong):
        mended = [m for a, b, p in found[wrong].tolist() for m in compared(symbols, a, b, p, max(least, exponent * p))]
        found = np.unique(np.concatenate([np.delete(found, wrong, 0), np.array(mended, np.int64).reshape(-1, 3)]), axis=0)
    # sorted by start, end, period: of equal stretches the smallest period
    return found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(1)][: len(found)]]


def compared(symbols: np.ndarray, start: int, end: int, period: int, least: int) -> list[tuple[int, int, int]]:
    """The true stretches of ``period`` within [start, end), by comparing words."""
    same = np.r_[False, symbols[start : end - period] == symbols[start + period : end], False]
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(start + a, start + b + period, period) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b + period - a >= least]


def runs(word: np.ndarray, counts: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """(text, rows of start, length, period) of all runs, by text, start and period.

    ``word`` numbers the words of all texts one after another; ``counts`` has the words of each text.
    """
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    regions = repeated_stretches(word, text, ends, least, exponent)
    if not regions:
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    start, end = np.concatenate([x for _, x, _ in regions]), np.concatenate([y for _, _, y in regions])
    order = np.lexsort((end, start))
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, (start[1:] > end[:-1]) | (text[start[1:]] != text[start[:-1]])]
    start, end = start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]
    # parts one after another, each closed by a symbol of its own
    length = end - start
    to = np.cumsum(length + 1) - length - 1
    symbols = np.empty(int((length + 1).sum()), np.int64)
    symbols[spread(to, length)] = word[spread(start, length)]
    symbols[to + length] = int(word.max()) + 1 + np.arange(len(start))

    def moved(x, y):
        part = np.searchsorted(start, x, side="right") - 1
        return x + to[part] - start[part], y + to[part] - start[part]

    found = longest(symbols, least, exponent, [(b, *moved(x, y)) for b, x, y in regions])
    part = np.searchsorted(to, found[:, 0], side="right") - 1
    begin = found[:, 0] - to[part] + start[part]
    of = text[begin]
    rows = np.stack([begin - (ends - counts)[of], found[:, 1] - found[:, 0], found[:, 2]], 1)
    order = np.lexsort((rows[:, 2], rows[:, 0], of))
    return of[order], rows[order]


def periodic_runs(df: DataFrame, key: str, text: str, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(key, n_words, runs, collapsed) of each row: its runs by start and period, and its words without repeats.

    Words are separated by ASCII white space. ``runs`` holds (start, length, period) in words, numbered from 0.
    ``collapsed`` joins by one blank the words that no run contains after its first period. A NULL text counts as empty: no
    words, no runs, the empty text. Rows with equal or NULL keys stay separate rows; other columns are passed over. A task
    holds the words of about 4 MB of text, or those of one longer text, with some 100 bytes for each of them that stands
    in a repeated stretch.
    """
    kind = dict(df.dtypes)[key]

    def task(batches):
        for batch in slices(batches, "text"):
            lists = pc.ascii_split_whitespace(batch.column("text").fill_null(""))
            values = lists.flatten()
            full = pc.greater(pc.binary_length(values), 0)
            row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
            counts = np.bincount(row[np.asarray(full)], minlength=len(lists))
            values = values.filter(full)
            number = np.asarray(values.dictionary_encode().indices, dtype=np.int64)
            of, found = runs(number, counts, least, exponent)
            first = np.cumsum(counts) - counts
            edge = np.zeros(len(number) + 1, np.int64)
            np.add.at(edge, first[of] + found[:, 0] + found[:, 2], 1)
            np.add.at(edge, first[of] + found[:, 0] + found[:, 1], -1)
            keep = np.cumsum(edge)[:-1] == 0
            kept = np.bincount(row[np.asarray(full)][keep], minlength=len(lists)) if len(number) else counts
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)].astype(np.int32)), values.filter(pa.array(keep))), " ")
            fields = [pa.array(found[:, k]) for k in range(3)]
            cuts = np.r_[0, np.cumsum(np.bincount(of, minlength=len(lists)))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(counts, pa.int64()), lists, joined], [key, "n_words", "runs", "collapsed"])

    schema = f"`{key}` {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(task, schema)


def digests(found: DataFrame, key: str) -> DataFrame:
    """(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of :func:`periodic_runs`.

    The four numbers are those of the longest run (ties: smallest start, then period), NULL without runs.
    """
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    made = found.select(
        key, F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), "collapsed",
        F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))).alias("lines"),
    )
    return made.select(
        key, "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) where every tenth document by the crc32 of its key repeats a passage from some word to its end."""
    hashed = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn(
        "h", F.crc32(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary"))
    )
    words = hashed.selectExpr("key", "text", "h div 10 as g", r"if(h % 10 = 0, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0), null) as w")
    sized = words.selectExpr("key", "text", "w", "g", "coalesce(size(w), 0) as n").selectExpr("*", "if(n > 0, cast(g % n as int), 0) as a")
    placed = sized.selectExpr("*", "cast(1 + (n - a) div (3 + g % 8) as int) as p")
    planted = "array_join(slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast((n - a + p - 1) div p as int)))), 1, n), ' ')"
    return placed.selectExpr(f"key as `{key}`", f"if(n > 0, {planted}, text) as `{text}`")
