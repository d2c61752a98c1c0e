"""Language of texts and of spans within them: script ranges, word scores, Viterbi with a switching penalty.

Training counts hashed character n-grams (orders 1 to 4 and the whole word) of each language over a bounded sample of
labelled rows; the scripts a language is written in come from the same rows. A word's score for a language is its log
likelihood ratio over its n-grams. Only languages that use the script of a word are candidates for it. The best labelling
of a text's words pays ``switch_penalty`` for every change of language; equal labels in a row are a span.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Rows, WordIndex, arrow_map, crc_bucket, letters_only, ngrams, slices, split_words

ORDERS = (0, 1, 2, 3, 4)
BITS = 15
UNDETERMINED = "und"
# First and last code point of the blocks of a script (Unicode block ranges).
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "han": ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
OTHER = len(SCRIPTS)


def script_table() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.int8)
    for number, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            out[first : last + 1] = number
    return out


def word_features(words: list[str], scripts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word of each n-gram, its bucket, script of each word, letters of each word). Words hold letters and inner blanks."""
    word, hashed, order = ngrams(words, ORDERS)
    bucket = (hashed >> np.uint64(64 - BITS)).astype(np.int64) + (order.astype(np.int64) << BITS)
    letters = np.array([len(w) - w.count(" ") for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    inked = code != 32
    votes = np.bincount(of[inked] * (OTHER + 1) + scripts[code[inked]], minlength=len(words) * (OTHER + 1))
    return word, bucket, votes.reshape(len(words), OTHER + 1).argmax(1).astype(np.int8), letters


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # n-gram bucket x language
    uses: np.ndarray  # script x language
    prior: int  # the most frequent language


def train(labelled: DataFrame, text: str, lang: str, key: str, max_rows: int = 8_000, max_languages: int = 256) -> Model:
    """Fit a model on rows with a language, a sample of about ``max_rows`` of them if there are more.

    At most ``max_languages`` languages are learned, the most frequent ones (ties: in order of their names); a model and its
    counts take 1.3 MB for each. A warning tells when there are more, as a dirty column may hold.

    The sample takes an equal share for each language, and all rows of a language that has fewer. Rows with a NULL text or language are left out. Without any row the model knows no language.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    most = rows.groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).collect()
    if len(most) > max_languages:
        warnings.warn(f"more than {max_languages} languages: those with {most[-1]['count']} rows or fewer are not learned", stacklevel=2)
    per_language = {r["lang"]: r["count"] for r in most[:max_languages]}
    if len(most) > max_languages:
        rows = rows.where(F.col(lang).isin(sorted(per_language)))
    languages = sorted(per_language)
    if not languages:
        return Model([], np.zeros((len(ORDERS) << BITS, 0), np.float32), np.zeros((OTHER + 1, 0), bool), 0)
    number = {x: i for i, x in enumerate(languages)}
    width = (len(ORDERS) << BITS) + OTHER + 1

    def task(batches):
        scripts, totals = script_table(), np.zeros((len(languages), width), np.int64)
        for batch in slices(batches, "text", 2 << 20):
            count, distinct, index = split_words(pc.utf8_split_whitespace(batch.column("text")))
            words = [letters_only(w) for w in distinct]
            word, bucket, script, letters = word_features(words, scripts)
            label = np.repeat([number[x] for x in batch.column("lang").to_pylist()], count)
            for k in set(label.tolist()):
                times = np.bincount(index[label == k], minlength=len(words))
                totals[k, : len(ORDERS) << BITS] += np.bincount(bucket, times[word], len(ORDERS) << BITS).astype(np.int64)
                totals[k, len(ORDERS) << BITS :] += np.bincount(script, times * letters, OTHER + 1).astype(np.int64)
        at, place = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(totals[at, place])], ["k", "at", "n"])

    sample = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    if sum(per_language.values()) > max_rows:
        bound = max(1, max_rows // len(languages))
        limit = {x: int((1 << 24) * bound / n) for x, n in per_language.items() if n > bound}
        limits = F.create_map(*(F.lit(y) for pair in limit.items() for y in pair))[F.col("lang")]
        sample = sample.where(F.pmod(F.xxhash64(F.lit(7), F.col("key")), F.lit(1 << 24)) < F.coalesce(limits, F.lit(1 << 24)))
    counted = sample.select("text", "lang").mapInArrow(task, "k int, at int, n bigint").groupBy("k", "at").agg(F.sum("n").alias("n"))
    counts = np.zeros((width, len(languages)))
    for r in counted.toLocalIterator():  # languages x buckets at most
        counts[r.at, r.k] = r.n
    grams, scripts = counts[: len(ORDERS) << BITS].reshape(len(ORDERS), 1 << BITS, -1), counts[len(ORDERS) << BITS :]
    share = (grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * (1 << BITS))
    logs = np.log(share)
    weights = (logs - logs.mean(2, keepdims=True)).reshape(len(ORDERS) << BITS, -1)
    uses = scripts >= 0.005 * np.maximum(scripts.sum(0, keepdims=True), 1)
    prior = max(range(len(languages)), key=lambda k: (per_language[languages[k]], -k))
    return Model(languages, weights.astype(np.float32), uses & (scripts > 0), prior)


class Labeller:
    """Labels the words of batches of texts; keeps the scores of words it has seen, up to a bound."""

    def __init__(self, model: Model, switch_penalty: float, gram_weight: float):
        self.m, self.penalty, self.gram_weight = model, switch_penalty, gram_weight
        self.scripts = script_table()
        self.reset()
        self.index = WordIndex(self.add, self.reset)

    def reset(self) -> None:
        self.scores, self.letters, self.known = Rows(np.float32, len(self.m.languages)), Rows(np.int32), Rows(bool)

    def add(self, tokens: list[str]) -> None:
        words = [letters_only(w) for w in tokens]
        word, bucket, script, letters = word_features(words, self.scripts)
        total = np.stack([np.bincount(word, self.m.weights[bucket, k], len(words)) for k in range(len(self.m.languages))], 1)
        total *= self.gram_weight
        fits = self.m.uses[script]
        known = fits.any(1) & (letters > 0)
        total = np.where(known[:, None], np.where(fits, total - total.max(1, keepdims=True, initial=-1e9), -50.0), 0.0)
        self.scores.append(np.maximum(total, -50.0).astype(np.float32))
        self.letters.append(letters)
        self.known.append(known)

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, language of each word, its letters, whether some language uses its script)."""
        count, distinct, number = split_words(pc.utf8_split_whitespace(texts))
        number = self.index.numbers(distinct)[number]
        letters = self.letters.data[number]
        inked = letters > 0
        text = np.repeat(np.arange(len(texts)), count)[inked]
        count = np.bincount(text, minlength=len(texts))
        number = number[inked]
        return count, viterbi(self.scores.data[number], count, self.penalty), letters[inked], self.known.data[number]


def viterbi(scores: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; texts are runs of ``count`` rows of scores. All texts of a batch advance together."""
    n, k = scores.shape
    order = np.argsort(-count, kind="stable")
    start = (np.cumsum(count) - count)[order]
    active = np.searchsorted(-count[order], -np.arange(count.max(initial=0)), side="left")
    stay = np.zeros((n, k), bool)
    jump = np.zeros(n, np.int8 if k < 128 else np.int32)
    value = np.zeros((len(count), k), np.float32)
    end = np.zeros(len(count), np.int64)
    for t, m in enumerate(active.tolist()):
        at = start[:m] + t
        v = value[:m]
        best = v.max(1, keepdims=True)
        jump[at] = v.argmax(1)
        moved = best - penalty
        stay[at] = v >= moved
        value[:m] = np.maximum(v, moved) + scores[at] - best
    end = value.argmax(1)
    label = np.zeros(n, jump.dtype)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = start[:m] + t
        label[at] = end[:m]
        end[:m] = np.where(stay[at, end[:m]], end[:m], jump[at])
    return label


def label_spans(df: DataFrame, key: str, text: str, model: Model, switch_penalty: float = 6.0, gram_weight: float = 0.35, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, lang_pred, score, spans) for each row of df, with spans of (lang, first_word, n_words).

    Words are runs between white space that hold a letter. ``lang_pred`` is the language with most letters (ties: the first
    by name), ``score`` its share of all letters. A text that is NULL or has no letters gets ``und``, score 0 and no spans;
    so does every text if the model knows no language. A text only in scripts that no language uses gets the most frequent
    language and score 0. Equal keys stay separate rows.
    """
    if not model.languages:
        return df.select(key, *carry, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.expr("cast(array() as array<struct<lang string, first_word int, n_words int>>)").alias("spans"))
    names = np.array([*model.languages, UNDETERMINED], object)
    span = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])

    def make():
        labeller = Labeller(model, switch_penalty, gram_weight)

        def step(batch):
            count, label, letters, known = labeller.label(batch.column("_text").fill_null(""))
            rows = len(count)
            of = np.repeat(np.arange(rows), count)
            total = np.bincount(of * len(model.languages) + label, letters * known, rows * len(model.languages)).reshape(rows, -1)
            ink = np.bincount(of, letters, rows)
            best = np.where(total.any(1), total.argmax(1), np.where(ink > 0, model.prior, len(model.languages)))
            score = total.max(1) / np.maximum(ink, 1)
            first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (label[1:] != label[:-1])]) if len(of) else np.zeros(0, np.int64)
            length = np.diff(np.r_[first, len(of)])
            begins = (np.cumsum(count) - count)[of[first]]
            spans = pa.StructArray.from_arrays([pa.array(names[label[first]], pa.string()), pa.array((first - begins).astype(np.int32)), pa.array(length.astype(np.int32))], fields=list(span))
            offsets = np.searchsorted(of[first], np.arange(rows + 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [batch.column("_key"), *(batch.column("_text" if c == text else f"_{c}") for c in carry), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), spans)],
                [key, *carry, "lang_pred", "score", "spans"],
            )

        return step

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (key, *carry)), "lang_pred string, score double, spans array<struct<lang:string,first_word:int,n_words:int>>"])
    rows = df.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in carry if c != text), F.col(text).cast("string").alias("_text"))
    return arrow_map(rows, make, schema, "_text")


def held_out(key: str, fold: int = 0, folds: int = 5) -> Column:
    """Whether a row is kept from training: crc32 of its key as text, modulo ``folds``, is ``fold``."""
    return crc_bucket(key, folds) == fold
