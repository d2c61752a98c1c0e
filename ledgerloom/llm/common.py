"""Helpers shared by the text operators: reading tables, written intermediates, Arrow batches, word n-grams."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import scratch_path

LETTERS = re.compile(r"[^\W\d_]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, name: str, with_path: bool = False) -> DataFrame | tuple[DataFrame, str]:
    """Write df below the shared folder and read it back: later stages do not depend on executors that made it."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    return (made, path) if with_path else made


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`landed` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def crc_bucket(key: str, n: int) -> Column:
    """crc32 of an integer column's decimal text, modulo n. NULL keys count as the text ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def sampled(df: DataFrame, key: str, have: int, bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of the key: the same rows in every run."""
    if have <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 24)) < int((1 << 24) * bound / have))


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one hold about ``size`` bytes (a single longer text is one slice)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pa.compute.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
        slot = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, text: str) -> DataFrame:
    """mapInArrow over slices of bounded size. ``make`` builds one function for each task, with its own caches."""

    def task(batches):
        step = make()
        for batch in slices(batches, text):
            yield step(batch)
        step = None
        # the worker process lives on and serves other stages
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, schema)


def split_words(lists: pa.ListArray) -> tuple[np.ndarray, list, np.ndarray]:
    """Non-empty words of split texts: (words of each text, distinct words, number of each word among them)."""
    values = lists.flatten()
    full = np.asarray(pa.compute.binary_length(values), dtype=np.int64) > 0
    text = np.repeat(np.arange(len(lists)), np.asarray(pa.compute.list_value_length(lists), dtype=np.int64))
    encoded = values.filter(pa.array(full)).dictionary_encode()
    return np.bincount(text[full], minlength=len(lists)), encoded.dictionary.to_pylist(), np.asarray(encoded.indices, dtype=np.int64)


class WordIndex:
    """Numbers words as they are first seen and calls ``add(new_words)`` for them. Forgets all beyond ``most``.

    New words go to ``add`` in parts of ``part``: their n-grams need far more memory than the words.
    """

    def __init__(self, add: Callable[[list], None], reset: Callable[[], None], most: int = 125_000, part: int = 10_000):
        self.add, self.reset, self.most, self.part, self.known = add, reset, most, part, {}

    def numbers(self, words: list) -> np.ndarray:
        """``words`` are distinct."""
        if len(self.known) > self.most:
            self.known = {}
            self.reset()
        found = [self.known.get(w, -1) for w in words]
        if -1 in found:
            new = [w for w, k in zip(words, found) if k < 0]
            start = len(self.known)
            self.known.update(zip(new, range(start, start + len(new))))
            for i in range(0, len(new), self.part):
                self.add(new[i : i + self.part])
            found = [self.known[w] for w in words]
        return np.array(found, np.int64)


class Rows:
    """An array that grows by whole blocks of rows."""

    def __init__(self, dtype, *shape: int):
        self.data, self.used = np.zeros((1 << 12, *shape), dtype), 0

    def append(self, block: np.ndarray) -> None:
        if self.used + len(block) > len(self.data):
            grown = np.zeros((2 * (self.used + len(block)), *self.data.shape[1:]), self.data.dtype)
            grown[: self.used] = self.data[: self.used]
            self.data = grown
        self.data[self.used : self.used + len(block)] = block
        self.used += len(block)


def ngrams(words: list[str], orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, 64-bit hash, order) of every character n-gram of the words, padded by one blank on either side.

    Order 0 stands for the whole padded word. Grams of blanks alone are left out; a word without letters has none.
    """
    flat = "".join(f" {w} " for w in words)
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(code))
    out_word, out_hash, out_order = [], [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(orders) + 1):
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in orders:
            ok = at[: len(h)] + n <= ends[: len(h)]
            if n == 1:
                ok &= code != 32
            out_word.append(word[: len(h)][ok])
            out_hash.append(mixed(h[ok] + np.uint64(n)))
            out_order.append(np.full(int(ok.sum()), n, np.int8))
    if 0 in orders and len(code):
        power = mixed(code + mixed(at.astype(np.uint64) - (ends - lengths.repeat(lengths)).astype(np.uint64)))
        starts = np.cumsum(lengths) - lengths
        out_word.append(np.arange(len(words)))
        out_hash.append(mixed(np.add.reduceat(power, starts)))
        out_order.append(np.zeros(len(words), np.int8))
    if not out_word:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
    return np.concatenate(out_word), np.concatenate(out_hash), np.concatenate(out_order)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalising mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letters_only(word: str) -> str:
    """Runs of letters (Unicode category L) in lower case, joined by blanks; numbers like ² or ½ are no letters."""
    found = " ".join(LETTERS.findall(word.lower()))
    if found.isascii() or found.replace(" ", "").isalpha():
        return found
    return " ".join("".join(c if c.isalpha() else " " for c in found).split())
