"""Best-fit packing of token pieces into sequences under several capacities.

A sequence has a capacity of tokens, of documents, and of attention cost (the sum of squared piece lengths, as attention
stays within a piece). A piece needs a share of each. Pieces are taken by decreasing need; each goes to the open sequence
that holds it under every capacity and whose residual fits best: by the least weighted norm of what would be left, or by
the greatest weighted dot product of need and residual. Without such a sequence it opens a new one.

Pieces are packed in blocks of a fixed number, wherever they lie: a block knows nothing of others. What a block leaves in
sequences with room is packed again in blocks of its own, so that every block costs at most a few sequences.
"""

from __future__ import annotations

import functools
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Rows, WordIndex, landed, slices, split_words

TOKENS = 2048
BLOCK = 16_384
#: share of its tokens that a sequence may lack without being packed again
SLACK = 1 / 256


@functools.lru_cache(1)
def tokenizer(definition: str):
    import tokenizers

    # a task is one thread: Spark spreads the work
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return tokenizers.Tokenizer.from_str(definition)


class Encoder:
    """Token ids of texts, word by word, by a lower-casing vocabulary that drops white space; keeps those of words it has seen."""

    def __init__(self, definition: str):
        self.tokenizer = tokenizer(definition)
        self.reset()
        self.index = WordIndex(self.add, self.reset, most=400_000)

    def reset(self) -> None:
        self.flat, self.starts = Rows(np.uint32), Rows(np.int64)
        self.starts.append(np.zeros(1, np.int64))

    def add(self, words: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self.starts.append(np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) + self.flat.used)
        self.flat.append(np.fromiter((i for x in ids for i in x), np.uint32))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end_id``, and where each starts (one more entry than texts)."""
        counts, distinct, number = split_words(pc.ascii_split_whitespace(alike(texts)))
        number = self.index.numbers(distinct)[number]
        start = self.starts.data[number]
        length = self.starts.data[number + 1] - start
        text = np.repeat(np.arange(len(texts)), counts)
        starts = np.r_[0, np.cumsum(np.bincount(text, length, len(texts)).astype(np.int64) + 1)]
        ids = np.full(int(starts[-1]), end_id, np.uint32)
        first = np.cumsum(length) - length
        at = np.arange(int(length.sum()))
        ids[np.repeat(text, length) + at] = self.flat.data[np.repeat(start - first, length) + at]
        return ids, starts


def alike(texts: pa.Array) -> pa.Array:
    """Texts with the same tokens and fewer distinct words: points and commas after letters stand alone, ASCII is lower-cased.

    A special token's string counts only as it is written, so texts with its opening keep their case.
    """
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.ascii_lower(texts)
    return pc.replace_substring_regex(texts, "([A-Za-z])([.,])", r"\1 \2")


def white_space_separates(definition: str) -> None:
    """Raises where a vocabulary's tokens of a text are not those of its words one after another."""
    made = tokenizer(definition)
    words = ["It's", "a<|endoftext|>b", "1,234.5", "é́x", "ΣΑΣ", "<|startoftext|>", "don't!!", "日本 語"]
    apart = [i for w in words for i in made.encode(w, add_special_tokens=False).ids]
    same = [made.encode(s.join(words), add_special_tokens=False).ids == apart for s in (" ", "\n", " \t\r\n\x0b\x0c ")]
    same += [made.encode("It'S, a.B.", add_special_tokens=False).ids == made.encode("it's , a .b .", add_special_tokens=False).ids]
    if not all(same):
        raise ValueError("only lower-casing vocabularies that drop white space and join nothing across it are covered")


def pieces(df: DataFrame, key: str, text: str, tokenizer_file: str, end_id: int = 0, most: int = TOKENS, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of each row's token ids and an end id, cut only where over ``most``.

    A NULL or empty text is the end id alone. Rows with equal or NULL keys stay documents of their own. ``ids`` holds
    unsigned 32-bit integers, little endian. The driver reads the vocabulary's file; it has a fixed size and travels with
    the task.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    white_space_separates(definition)
    names = [key, "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]

    def task(batches):
        encoder = Encoder(definition)
        for batch in slices(batches, "text", 4 << 20):
            ids, starts = encoder.encode(batch.column("text").fill_null(""), end_id)
            size = np.diff(starts)
            parts = -(-size // most)
            row = np.repeat(np.arange(len(size)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * most
            length = np.minimum(size[row] - start, most)
            packed = memoryview(ids.astype("<u4").tobytes())
            cuts = [packed[a : a + n] for a, n in zip((4 * (starts[row] + start)).tolist(), (4 * length).tolist())]
            columns = [batch.column("key").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(map(zlib.crc32, cuts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(map(bytes, cuts), pa.binary())] * with_ids, names)

    schema = f"`{key}` {dict(df.dtypes)[key]}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(task, schema)


def needs(length: np.ndarray) -> np.ndarray:
    """What pieces need of tokens, documents and attention cost."""
    length = length.astype(np.int64)
    return np.stack([length, np.ones(len(length), np.int64), length * length])


def best_fit(need: np.ndarray, capacity: tuple[int, ...], weights: tuple[float, ...], by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence of each piece from 0, what each sequence has left of each capacity). ``need`` has a row for each capacity."""
    if by not in ("norm", "dot"):
        raise ValueError(f"unknown measure: {by}")
    limit = np.array(capacity, np.int64)
    if (need > limit[:, None]).any():
        raise ValueError("a piece needs more than a sequence has")
    factor = np.array(weights, np.float64)[:, None] / limit[:, None].astype(np.float64) ** 2
    chosen = np.zeros(need.shape[1], np.int64)
    left = np.zeros((len(limit), max(need.shape[1], 1)), np.int64)  # of all sequences
    room, name, n_open, n_all = left.copy(), np.zeros(left.shape[1], np.int64), 0, 0  # of the open ones
    least = need.min(1) if need.shape[1] else limit
    order = np.argsort(-((np.array(weights)[:, None] * need / limit[:, None]).sum(0)), kind="stable")
    for i in order.tolist():
        x = need[:, i]
        fits = np.flatnonzero((room[:, :n_open] >= x[:, None]).all(0))
        if len(fits):
            after = room[:, fits] - x[:, None]
            if by == "norm":
                at = fits[np.argmin((factor * after * after.astype(np.float64)).sum(0))]
            else:
                at = fits[np.argmax((factor * x[:, None] * room[:, fits].astype(np.float64)).sum(0))]
        else:
            at, name[n_open], room[:, n_open] = n_open, n_all, limit
            n_open, n_all = n_open + 1, n_all + 1
        room[:, at] -= x
        chosen[i] = name[at]
        left[:, name[at]] = room[:, at]
        if (room[:, at] < least).any():
            # nothing more fits: the last open sequence takes its place
            n_open -= 1
            name[at], room[:, at] = name[n_open], room[:, n_open]
    return chosen, left[:, :n_all]


def packed(df: DataFrame, level: int, capacity: tuple[int, ...], weights: tuple[float, ...], by: str, block: int) -> DataFrame:
    """The rows of df, which have a column ``length``, with sequence_id, offset and _room, the tokens their sequence lacks."""

    def task(batches):
        first = (level << 56) | (TaskContext.get().partitionId() << 32)

        def close(rows):
            nonlocal first
            table = pa.Table.from_batches(rows).combine_chunks()
            length = np.asarray(table.column("length"), dtype=np.int64)
            chosen, left = best_fit(needs(length), capacity, weights, by)
            order = np.argsort(chosen, kind="stable")
            ends = np.cumsum(length[order])
            heads = np.searchsorted(chosen[order], chosen[order])
            offset = np.empty(len(length), np.int64)
            offset[order] = ends - length[order] - np.r_[0, ends][heads]
            for name, column in (("sequence_id", first + chosen), ("offset", offset), ("_room", left[0][chosen])):
                table = table.append_column(name, pa.array(column, pa.int64()))
            first += left.shape[1]
            yield from table.to_batches()

        rows, held = [], 0
        for batch in batches:
            while batch.num_rows:
                rows.append(batch.slice(0, block - held))
                batch = batch.slice(block - held)
                held += rows[-1].num_rows
                if held == block:
                    yield from close(rows)
                    rows, held = [], 0
        if held:
            yield from close(rows)

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(task, f"{fields}, sequence_id bigint, offset bigint, _room bigint")


def pack(
    df: DataFrame, tokens: int = TOKENS, documents: int = TOKENS, attention: int = TOKENS**2, weights: tuple[float, ...] = (1.0, 1 / 64, 1 / 64), by: str = "norm", block: int = BLOCK
) -> DataFrame:
    """The rows of :func:`pieces` with ``sequence_id`` and ``offset``, the place of a piece in its sequence.

    No sequence goes over ``tokens``, ``documents`` or ``attention``; a single piece over one of them raises. With the
    default capacities tokens alone decide, since they imply the other two. All columns of df but sequence_id, offset and
    _room stay. A task holds ``block`` pieces at a time. An empty table gives an empty one.
    """
    capacity = (tokens, documents, attention)
    rows = landed(df.drop("sequence_id", "offset", "_room"), "pieces")
    once = landed(packed(rows, 0, capacity, weights, by, block), "packed")
    roomy = F.col("_room") > math.floor(tokens * SLACK)
    again = once.where(roomy)
    blocks = math.ceil(again.count() / block)
    more = packed(again.select(rows.columns).repartition(max(blocks, 1)), 1, capacity, weights, by, block)
    return once.where(~roomy).unionByName(more).drop("_room")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, n_pieces, ids) of packed pieces made ``with_ids``; at most one sequence's ids in a row."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    return parts.select("sequence_id", F.size("parts").alias("n_pieces"), joined).withColumn("n_tokens", F.expr("length(ids) div 4"))
