"""Benchmark decontamination by greedy string tiling.

A pair of a document and a benchmark item is a candidate if it shares seeds: runs of ``seed`` words. Documents are
screened against a bit table of all seed hashes (its size is fixed, whatever the benchmark's), and the seeds that pass are
joined with the benchmark's in Spark. Seeds that an item shares with a document bound what tiles can cover of the item;
pairs whose bound is below the threshold go no further. For the rest, running Karp-Rabin finds the longest common run of
words that is not marked yet, marks it in both texts, and goes on until none of ``seed`` words is left. The share of the
item's words in tiles is its coverage, in whatever order the passages stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Rows, WordIndex, landed, letters_only, slices, split_words

SEED = 5
COVERAGE = 0.5
TABLE_BITS = 24
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Hasher:
    """Words of texts as 64-bit hashes: lower-cased, letters alone; keeps those it has seen, up to a bound."""

    def __init__(self):
        self.reset()
        self.index = WordIndex(self.add, self.reset)

    def reset(self) -> None:
        self.hashes = Rows(np.uint64)

    def add(self, words: list[str]) -> None:
        plain = ["".join(letters_only(w).split()) for w in words]
        # 0 marks what holds no letter
        self.hashes.append(np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 if w else 0 for w in plain), np.uint64, len(words)))

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, where each text starts; one more entry than texts)."""
        count, distinct, number = split_words(pc.utf8_split_whitespace(texts))
        number = self.index.numbers(distinct)[number]
        hashed = self.hashes.data[number]
        full = hashed != 0
        text = np.repeat(np.arange(len(texts)), count)[full]
        return hashed[full], np.r_[0, np.cumsum(np.bincount(text, minlength=len(texts)))]


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every run of n words, rolled over all runs at once: prefix sums, each window scaled by its place."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    if n <= 8:
        total = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            total = total * BASE + words[k : k + len(total)]
        return total
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(words), BASE)], dtype=np.uint64)
    # prefix[i + n] - prefix[i] * BASE ** n
    back = np.cumprod(np.r_[np.uint64(1), np.full(len(words), INVERSE)], dtype=np.uint64)
    prefix = np.r_[np.uint64(0), np.cumsum(words * back[1:], dtype=np.uint64)]
    return (prefix[n:] - prefix[:-n]) * powers[n:]


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of greedy string tiling, longest first; ties: first in the item, then in the text.

    Where no common run of n words is unmarked there is none of more, so the next length is found by halving. Windows are
    found by Karp-Rabin hashes and confirmed word by word. Within a length, a place in the item takes the first place in the
    text that is still free; places that are not are passed over for good.
    """
    out = []
    free_item, free_text = np.ones(len(item), bool), np.isin(text, item)

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts in the item, their hashes, starts in the text, their hashes) of free windows of n words found in both."""
        a, b = windows(item, n), windows(text, n)
        a_free, b_free = run_starts(free_item, n), run_starts(free_text, n)
        b_free = b_free[np.isin(b[b_free], a[a_free])]
        a_free = a_free[np.isin(a[a_free], b[b_free])]
        return a_free, a[a_free], b_free, b[b_free]

    most = min(len(item), longest_run(free_text))
    while most >= least:
        low, high, found = least - 1, most, None
        while low < high:  # the longest n with a common window
            n = (low + high + 1) // 2
            some = common(n)
            if len(some[0]):
                low, found = n, some
            else:
                high = n - 1
        if not found:
            break
        n = low
        a_at, a_hash, b_at, b_hash = found
        order = np.argsort(b_hash, kind="stable")
        b_at, b_hash = b_at[order].tolist(), b_hash[order]
        begin, end = np.searchsorted(b_hash, a_hash).tolist(), np.searchsorted(b_hash, a_hash, side="right").tolist()
        passed = {}  # first place of a hash's group that may still be free
        for i, first, stop in zip(a_at.tolist(), begin, end):
            # tiles of this round have n words too, so one that meets a window meets one of its ends
            if not (free_item[i] and free_item[i + n - 1]):
                continue
            k = passed.get(first, first)
            while k < stop and not (free_text[b_at[k]] and free_text[b_at[k] + n - 1]):
                k += 1
            passed[first] = k
            for k in range(k, stop):
                j = b_at[k]
                if free_text[j] and free_text[j + n - 1] and (item[i : i + n] == text[j : j + n]).all():
                    out.append((i, j, n))
                    free_item[i : i + n] = free_text[j : j + n] = False
                    break
        most = min(n - 1, longest_run(free_item), longest_run(free_text))
    return out


def run_starts(free: np.ndarray, n: int) -> np.ndarray:
    """Where runs of n free places start."""
    if len(free) < n:
        return np.zeros(0, np.int64)
    total = np.r_[0, np.cumsum(free)]
    return np.flatnonzero(total[n:] - total[:-n] == n)


def longest_run(free: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def seeds_of(df: DataFrame, seed: int) -> DataFrame:
    """(item, seed, at, words) of benchmark rows (item, text); an item shorter than a seed is a single shorter one."""

    def task(batches):
        hasher = Hasher()
        for batch in slices(batches, "text", 1 << 20):
            words, starts = hasher.words(batch.column("text").fill_null(""))
            items = batch.column("item").to_pylist()
            out = [], [], [], []
            for k, item in enumerate(items):
                own = words[starts[k] : starts[k + 1]]
                for at, h in enumerate(windows(own, min(seed, max(len(own), 1))).tolist()):
                    for column, value in zip(out, (item, np.uint64(h).astype(np.int64), at, len(own))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["item", "seed", "at", "words"])

    return df.mapInArrow(task, "item bigint, seed bigint, at bigint, words bigint")


def contaminated(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", seed: int = SEED, coverage: float = COVERAGE
) -> DataFrame:
    """(key, item, item_words, n_tiles, covered, coverage) of every document and item covered by ``coverage`` or more.

    Words are runs between white space, lower-cased, letters alone; others are passed over. Items without words match
    nothing; items shorter than a seed must occur whole. NULL texts are empty. NULL keys and items take no part. Rows that
    share a key are compared one by one and the best coverage counts.
    """
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("bigint").alias("item"), F.col(item_text).cast("string").alias("text"))
    seeds = landed(seeds_of(items, seed), "benchmark-seeds")
    # a bit for every seed hash: at most 2 ** TABLE_BITS numbers reach the driver
    bits = seeds.select(F.expr(f"shiftrightunsigned(seed, {64 - TABLE_BITS})").alias("b"), F.least("words", F.lit(seed)).cast("int").alias("n")).distinct()
    lengths = sorted(r[0] for r in bits.select("n").distinct().collect() if r[0])
    screen = np.zeros((1 << TABLE_BITS) // 8, np.uint8)
    for r in bits.select("b").distinct().toLocalIterator():
        screen[r.b >> 3] |= 1 << (r.b & 7)

    def find(batches):
        hasher = Hasher()
        for batch in slices(batches, "text"):
            words, starts = hasher.words(batch.column("text").fill_null(""))
            rows, places = [], []
            for n in lengths:
                h = windows(words, n)
                b = h >> np.uint64(64 - TABLE_BITS)
                hit = np.flatnonzero((screen[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1)
                row = np.searchsorted(starts, hit, side="right") - 1
                inside = hit + n <= starts[row + 1]
                rows.append(row[inside])
                places.append(h[hit[inside]])
            row, seen = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*places, np.zeros(0, np.uint64)])
            order = np.lexsort((seen, row))
            row, seen = row[order], seen[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (seen[1:] != seen[:-1])][: len(row)]
            row, seen = row[new], seen[new]
            some = np.unique(row)
            cuts = np.r_[np.searchsorted(row, some), len(row)].astype(np.int32)
            chosen = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays(
                [chosen.column("id"), chosen.column("text"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(seen.view(np.int64)))], ["id", "text", "seeds"]
            )

    docs = documents.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    screened = landed(docs.mapInArrow(find, "id bigint, text string, seeds array<bigint>"), "screened")
    screened = screened.withColumn("row", F.xxhash64("id", "text"))
    hits = screened.select("id", "row", F.explode("seeds").alias("seed")).join(seeds, "seed").select("id", "row", "item", "words", "at").distinct()
    covered = F.aggregate(
        F.sort_array(F.collect_list("at")),
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("end")),
        lambda a, x: F.struct((a["sum"] + x + seed - F.greatest(a["end"], x)).alias("sum"), (x + seed).alias("end")),
        lambda a: a["sum"],
    )
    candidates = hits.groupBy("id", "row", "item", "words").agg(covered.alias("bound")).where(F.least("bound", "words") >= coverage * F.col("words"))
    pairs = candidates.join(screened.select("id", "row", "text").dropDuplicates(["id", "row"]), ["id", "row"]).join(items.select("item", F.col("text").alias("item_text")), "item")

    def tile(batches):
        hasher = Hasher()
        for batch in slices(batches, "text"):
            a, a_at = hasher.words(batch.column("item_text").fill_null(""))
            b, b_at = hasher.words(batch.column("text").fill_null(""))
            n_words, n_tiles, cover = [], [], []
            for k in range(batch.num_rows):
                own = a[a_at[k] : a_at[k + 1]]
                found = tiles(own, b[b_at[k] : b_at[k + 1]], min(seed, max(len(own), 1)))
                n_words.append(len(own))
                n_tiles.append(len(found))
                cover.append(sum(t[2] for t in found))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("item"), *(pa.array(x, pa.int64()) for x in (n_words, n_tiles, cover))], ["id", "item", "item_words", "n_tiles", "covered"])

    tiled = pairs.select("id", "item", "text", "item_text").mapInArrow(tile, "id bigint, item bigint, item_words bigint, n_tiles bigint, covered bigint")
    best = tiled.groupBy("id", "item").agg(F.max(F.struct("covered", "n_tiles", "item_words")).alias("t"))
    out = best.select(F.col("id").cast(dict(documents.dtypes)[key]).alias(key), F.col("item").cast(dict(benchmark.dtypes)[item]).alias(item), "t.item_words", "t.n_tiles", "t.covered")
    return out.withColumn("coverage", F.col("covered") / F.col("item_words")).where(F.col("coverage") >= coverage)
