"""Encoding and decoding with a SentencePiece BPE vocabulary by vectorised merge rounds.

The words of a batch lie in one flat numpy array of symbols. Each round looks up the rank of every adjacent pair, takes
the least rank of each word (a segmented minimum), merges its occurrences from the left in all words at once, and
compacts the array, until no pair of a word is in the vocabulary.

Merging all occurrences of the best pair at once equals merging them one by one only if the merged symbol cannot open a
pair that is as good or better. That is checked for each rank of the vocabulary; where it does not hold (runs of blanks,
whose pieces all have one score), only the leftmost occurrence is merged in a round.

A long word takes part in a round with many pairs, not with its best ones alone: a pair that is better than all pairs up
to ``reach`` symbols to its left, and as good as all up to ``reach`` to its right, is merged as well. ``reach`` is twice the
length of the longest piece. A symbol that grows into this stretch from outside ends in its outer half before the pair's
own turn, and what follows from merging the pair stays in the inner half, so neither meets the other. The rounds of a word
thus do not grow with its length, but for a word full of one pair whose merges follow from each other.

The vocabulary's file is a parameter. The driver reads it once; its tables have a fixed size and travel with the task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Rows, WordIndex, slices, split_words

SPACE = "▁"
WORD = re.compile(r" *[^ ]+| +")
NONE = np.int32(2**31 - 1)
CHARS = 0x110000
TABLE_BITS = 19


@dataclass
class Vocabulary:
    """Lookup tables of a BPE model with byte fallback. Symbols below ``size`` are pieces, above it single characters."""

    size: int
    bos: int
    eos: int
    char_symbol: np.ndarray
    pair_key: np.ndarray  # an open hash table: a key lies at its slot or one of the next ``probes``
    pair_rank: np.ndarray
    pair_to: np.ndarray
    probes: int
    careful: np.ndarray
    byte_id: np.ndarray
    piece_bytes: np.ndarray
    piece_start: np.ndarray
    spaces_split: bool
    reach: int  # twice the characters of the longest piece

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank NONE if it is no piece."""
        key = left.astype(np.int64) * (self.size + CHARS) + right
        slot = slot_of(key)
        rank, to = np.full(len(key), NONE, np.int32), np.zeros(len(key), np.int32)
        for k in range(self.probes):
            hit = np.flatnonzero(self.pair_key[slot + k] == key)
            rank[hit], to[hit] = self.pair_rank[slot[hit] + k], self.pair_to[slot[hit] + k]
        return rank, to


def slot_of(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def hash_table(key: np.ndarray, *values: np.ndarray) -> tuple:
    """Place distinct keys in their slots or behind them: (keys, values..., greatest distance + 1)."""
    slot = slot_of(key)
    order = np.argsort(slot, kind="stable")
    # each key goes to the first free place at or after its slot
    place = np.maximum.accumulate(slot[order] - np.arange(len(key))) + np.arange(len(key))
    probes = int((place - slot[order]).max(initial=0)) + 1
    out = [np.full((1 << TABLE_BITS) + len(key) + probes, -1, np.int64)]
    out[0][place] = key[order]
    for x in values:
        out.append(np.zeros(len(out[0]), np.int32))
        out[-1][place] = x[order]
    return (*out, probes)


def load_vocabulary(model_file: str) -> Vocabulary:
    """Read the pieces and scores of a model file. Raises where a model has parts that this encoder does not cover."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.vocab_size()
    kinds = [(model.is_control(i) or model.is_unknown(i), model.is_byte(i), model.is_unused(i)) for i in range(n)]
    if any(k[2] for k in kinds) or sum(k[1] for k in kinds) != 256:
        raise ValueError("only models with byte fallback and without unused pieces are covered")
    if model.encode("a  b", out_type=str) != model.encode(f"a{SPACE} b", out_type=str) or model.decode(model.encode(" a ")) != " a ":
        raise ValueError("only models without normalisation and with a leading blank are covered")
    texts = {model.id_to_piece(i): i for i in range(n) if not (kinds[i][0] or kinds[i][1])}
    score = {p: model.get_score(i) for p, i in texts.items()}
    rank_of = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
    symbol = dict(texts)
    for piece in texts:
        for c in piece:
            symbol.setdefault(c, n + ord(c))
    key, rank, to = [], [], []
    for piece, i in texts.items():
        for k in range(1, len(piece)):
            left, right = symbol.get(piece[:k]), symbol.get(piece[k:])
            if left is not None and right is not None:
                key.append(left * (n + CHARS) + right)
                rank.append(rank_of[score[piece]])
                to.append(i)
    key, rank, to = np.array(key, np.int64), np.array(rank, np.int32), np.array(to, np.int32)
    made = np.full(n + CHARS, -1, np.int32)
    for piece, i in texts.items():
        made[i] = rank_of[score[piece]]
    left, right = key // (n + CHARS), key % (n + CHARS)
    careful = np.zeros(len(rank_of) + 1, bool)
    careful[made[left][(made[left] >= rank)]] = True
    careful[made[right][(made[right] >= rank)]] = True
    char_symbol = np.arange(n, n + CHARS, dtype=np.int32)
    for piece, i in texts.items():
        if len(piece) == 1:
            char_symbol[ord(piece)] = i
    byte_id = np.zeros(256, np.uint32)
    pieces = []
    for i in range(n):
        text = model.id_to_piece(i)
        if kinds[i][1]:
            byte_id[int(text[1:-1], 16)] = i
            pieces.append(bytes([int(text[1:-1], 16)]))
        else:
            pieces.append(b"" if kinds[i][0] else text.replace(SPACE, " ").encode())
    return Vocabulary(
        n, model.bos_id(), model.eos_id(), char_symbol, *hash_table(key, rank, to), careful, byte_id,
        np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)]),
        not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in texts), 2 * max(map(len, texts)),
    )


def least_of_next(x: np.ndarray, n: int) -> np.ndarray:
    """The least of the ``n`` entries that follow each one; NONE stands behind the last."""
    size, least, done = 1, np.r_[x[1:], NONE], 1
    while done < n:
        size = min(done, n - done)
        least = np.minimum(least, np.r_[least[size:], np.full(min(size, len(x)), NONE, np.int32)][: len(x)])
        done += size
    return least


def merge_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words in one array, and where each word starts in it (one more entry than words)."""
    long = np.fromiter(map(len, words), np.int64, len(words)) > 2 * v.reach
    if not long.any() or long.all():
        return merge_rounds(words, v, bool(long.any()))
    parts = [merge_rounds([w for w, own in zip(words, long) if own == which], v, which) for which in (False, True)]
    count = np.zeros(len(words), np.int64)
    for which, (_, starts) in zip((False, True), parts):
        count[long == which] = np.diff(starts)
    symbols = np.empty(int(count.sum()), parts[0][0].dtype)
    is_long = np.repeat(long, count)
    symbols[~is_long], symbols[is_long] = parts[0][0], parts[1][0]
    return symbols, np.r_[0, np.cumsum(count)]


def merge_rounds(words: list[str], v: Vocabulary, many_a_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rounds of :func:`merge_words`; ``many_a_word`` merges the locally best pairs too, with the same result."""
    flat = "".join(words).replace(" ", SPACE)
    symbols = v.char_symbol[np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)]
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    done_symbols, done_words = [], []
    rank, to = np.full(len(symbols), NONE, np.int32), np.zeros(len(symbols), np.int32)
    fresh = np.ones(len(symbols), bool)  # pairs to look up, by their left symbol
    while len(symbols):
        last = np.r_[word[:-1] != word[1:], True]
        at = np.flatnonzero(fresh & ~last)
        rank[fresh] = NONE
        rank[at], to[at] = v.pairs(symbols[at], symbols[at + 1])
        starts = np.flatnonzero(np.r_[True, last[:-1]])
        least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbols)]))
        over = least == NONE
        chosen = (rank == least) & ~over
        # of neighbouring occurrences every second one counts, from the left
        take = chosen & ~np.r_[False, chosen[:-1]]
        if take.sum() < chosen.sum():
            position = np.arange(len(symbols))
            take = chosen & ((position - np.maximum.accumulate(np.where(take, position, 0))) % 2 == 0)
        careful = chosen & v.careful[np.where(over, len(v.careful) - 1, least)]
        if careful.any():
            hits = np.flatnonzero(careful)
            _, leftmost = np.unique(word[hits], return_index=True)
            take &= ~careful
            take[hits[leftmost]] = True
        if many_a_word:
            # the end of a word holds NONE, so stretches that go over it only see more pairs than need be
            left, right = least_of_next(rank[::-1], v.reach)[::-1], least_of_next(rank, v.reach)
            take |= (rank < left) & (rank <= right) & (rank != NONE) & ~chosen
        symbols = np.where(take, to, symbols)
        if over.any():
            done_symbols.append(symbols[over])
            done_words.append(word[over])
        keep = ~(np.r_[False, take[:-1]] | over)
        fresh = take | np.r_[take[1:], False] | np.r_[take[2:], False, False][: len(take)]
        symbols, word, rank, to, fresh = symbols[keep], word[keep], rank[keep], to[keep], fresh[keep]
    if not done_words:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]


def fall_back(symbols: np.ndarray, starts: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of symbols; a character without a piece becomes the ids of its UTF-8 bytes."""
    rare = np.flatnonzero(symbols >= v.size)
    if not len(rare):
        return symbols.astype(np.uint32), starts
    encoded = [chr(c - v.size).encode("utf-8", "replace") for c in symbols[rare].tolist()]
    count = np.ones(len(symbols), np.int64)
    count[rare] = [len(b) for b in encoded]
    first = np.cumsum(count) - count
    ids = np.zeros(int(count.sum()), np.uint32)
    plain = symbols < v.size
    ids[first[plain]] = symbols[plain]
    for i, b in zip(rare.tolist(), encoded):
        ids[first[i] : first[i] + len(b)] = v.byte_id[list(b)]
    return ids, np.r_[first, len(ids)][starts]


class Encoder:
    """Encodes texts; keeps the ids of words it has seen, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()
        self.index = WordIndex(self.add, self.reset)

    def reset(self) -> None:
        self.flat, self.starts = Rows(np.uint32), Rows(np.int64)
        self.starts.append(np.zeros(1, np.int64))

    def add(self, words: list[str]) -> None:
        ids, starts = fall_back(*merge_words(words, self.v), self.v)
        self.starts.append(starts[1:] + self.flat.used)
        self.flat.append(ids)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Words with their leading blanks: words of each text, distinct words, number of each word among them.

        A text whose blanks stand alone and between words is split by Arrow; others by a pattern.
        """
        odd = np.asarray(pa.compute.match_substring_regex(texts, f"^ | $|  |{SPACE}"))
        if not self.v.spaces_split:
            odd[:] = True
        lists = pa.compute.split_pattern(texts.filter(pa.array(~odd)), " ")
        count, distinct, number = split_words(lists)
        if not odd.any():
            return count, [" " + w for w in distinct], number
        slow = [self.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        place = {w: i for i, w in enumerate(dict.fromkeys([" " + w for w in distinct] + [w for ws in slow for w in ws]))}
        counts = np.zeros(len(texts), np.int64)
        counts[~odd], counts[odd] = count, list(map(len, slow))
        numbers = np.zeros(int(counts.sum()), np.int64)
        is_slow = np.repeat(odd, counts)
        numbers[~is_slow], numbers[is_slow] = number, [place[w] for ws in slow for w in ws]
        return counts, list(place), numbers

    def split(self, text: str) -> list[str]:
        text = " " + text.replace(SPACE, " ") if text else ""
        return WORD.findall(text) if self.v.spaces_split else [text] * bool(text)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with begin and end ids, and where each text starts (one more entry than texts)."""
        counts, distinct, number = self.words(texts)
        number = self.index.numbers(distinct)[number]
        start = self.starts.data[number]
        length = self.starts.data[number + 1] - start
        text_of = np.repeat(np.arange(len(texts)), counts)
        total = np.bincount(text_of, length, len(texts)).astype(np.int64) + 2
        starts = np.r_[0, np.cumsum(total)]
        ids = np.empty(int(starts[-1]), np.uint32)
        ids[starts[:-1]], ids[starts[1:] - 1] = self.v.bos, self.v.eos
        first = np.cumsum(length) - length
        to = np.repeat(start - first, length) + np.arange(int(length.sum()))
        ids[np.repeat(2 * text_of + 1, length) + np.arange(len(to))] = self.flat.data[to]
        return ids, starts


def decode_ids(ids: np.ndarray, starts: np.ndarray, v: Vocabulary) -> list[str]:
    """Texts of ids: pieces in order, without control ids and the leading blank; bytes that are no UTF-8 become U+FFFD."""
    length = np.diff(v.piece_start)[ids]
    first = np.cumsum(length) - length
    flat = v.piece_bytes[np.repeat(v.piece_start[ids] - first, length) + np.arange(int(length.sum()))].tobytes()
    cuts = np.r_[first, len(flat)][starts].tolist()
    return [flat[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def round_trip(df: DataFrame, key: str, text: str, model_file: str) -> DataFrame:
    """Encode ``text`` and decode the ids again: (key, ids, decoded), one row for each row of df.

    ``ids`` is the binary form of the ids, 4 bytes each, little endian; :func:`unpacked` makes an array of it. A NULL text
    counts as empty: begin and end ids alone, and the empty text. Rows with equal keys stay separate rows.
    """
    vocabulary = load_vocabulary(model_file)
    schema = f"{key} {dict(df.dtypes)[key]}, ids binary, decoded string"

    def task(batches):
        encoder = Encoder(vocabulary)
        for batch in slices(batches, "text"):
            ids, starts = encoder.encode(batch.column("text").fill_null(""))
            packed = ids.astype("<u4").tobytes()
            cuts = (starts * 4).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([packed[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array(decode_ids(ids, starts, vocabulary), pa.string())],
                [key, "ids", "decoded"],
            )

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(task, schema)


def unpacked(ids: str = "ids"):
    """The packed ids as an array of integers."""
    return F.expr(f"transform(sequence(1, greatest(length({ids}) div 4, 1)), i -> cast(conv(hex(reverse(substring({ids}, 4 * i - 3, 4))), 16, 10) as bigint))")


def digests(df: DataFrame, key: str, text: str, model_file: str) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of :func:`round_trip`."""
    made = round_trip(df, key, text, model_file)
    return made.select(
        key,
        F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
