"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives, texts taken regardless of labels the unlabelled rows. With the class prior pi the
risk of a classifier is ``pi * E_P[l(z)] + max(0, E_U[l(-z)] - pi * E_P[l(-z)])``: the second part estimates the risk on
negatives and is kept from becoming negative; while it is below zero, its gradient is followed upwards. The loss is the
logistic one, so a score estimates the probability of the label.

Features are presence of character n-grams of words (4 to 6, with word edges) and of whole words, those whose share among
positives exceeds the share among unlabelled rows beyond chance. Training uses bounded samples of rows; feature counts are
summed in Spark, and the driver holds the chosen features of the sampled rows. Scoring covers every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Rows, WordIndex, arrow_map, crc_bucket, landed, letters_only, ngrams, sampled, slices, split_words

ORDERS = (0, 4, 5, 6)
BITS = 22
THRESHOLD = 0.3


@dataclass
class Model:
    features: np.ndarray  # sorted hashes of n-grams
    weights: np.ndarray  # classifier x feature
    bias: np.ndarray
    prior: float


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, n-gram hash); equal n-grams of different orders or places in a word share a feature."""
    word, hashed, _ = ngrams(words, ORDERS)
    return word, hashed


class Finder:
    """Finds the chosen features of texts; keeps the features of words it has seen, up to a bound."""

    def __init__(self, features: np.ndarray):
        self.features = features
        self.reset()
        self.index = WordIndex(self.add, self.reset)

    def reset(self) -> None:
        self.flat, self.starts = Rows(np.int32), Rows(np.int64)
        self.starts.append(np.zeros(1, np.int64))

    def add(self, tokens: list[str]) -> None:
        word, hashed = features_of([letters_only(w) for w in tokens])
        if len(self.features):
            at = np.minimum(np.searchsorted(self.features, hashed), len(self.features) - 1)
            hit = np.flatnonzero(self.features[at] == hashed)
        else:
            at, hit = np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, at = word[hit], at[hit]
        order = np.argsort(word, kind="stable")
        self.starts.append(np.cumsum(np.bincount(word, minlength=len(tokens))) + self.flat.used)
        self.flat.append(at[order].astype(np.int32))

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) pairs, sorted."""
        count, distinct, number = split_words(pc.utf8_split_whitespace(texts))
        number = self.index.numbers(distinct)[number]
        start = self.starts.data[number]
        length = self.starts.data[number + 1] - start
        some = np.flatnonzero(length)
        text = np.repeat(np.arange(len(texts)), count)[some]
        start, length = start[some], length[some]
        first = np.cumsum(length) - length
        feature = self.flat.data[np.repeat(start - first, length) + np.arange(int(length.sum()))]
        pairs = np.unique(np.repeat(text, length) * max(len(self.features), 1) + feature)
        return np.divmod(pairs, max(len(self.features), 1))


def bucket_counts(sample: DataFrame, most: int, least_z: float) -> np.ndarray:
    """Hashes of the n-grams whose share among positives exceeds that among unlabelled rows by ``least_z`` deviations.

    Two passes over the sample: counts of hash buckets, then exact counts of the n-grams in the buckets that stand out.
    """
    totals = sample.groupBy("positive").count().collect()
    n_p = next((r[1] for r in totals if r[0] == 1), 0)
    n_u = next((r[1] for r in totals if r[0] == 0), 0)

    def pairs(batch, wanted=None):
        """Distinct (row, n-gram) pairs of a batch; of the n-grams in wanted buckets only, if any are named."""
        count, distinct, number = split_words(pc.utf8_split_whitespace(batch.column("text").fill_null("")))
        word, hashed = features_of([letters_only(w) for w in distinct])
        if wanted is not None:
            own = wanted[(hashed >> np.uint64(64 - BITS)).astype(np.int64)]
            word, hashed = word[own], hashed[own]
        order = np.argsort(word, kind="stable")
        hashed, size = hashed[order], np.bincount(word, minlength=len(distinct))
        start = np.cumsum(size) - size
        row, number = np.divmod(np.unique(np.repeat(np.arange(len(count)), count) * max(len(distinct), 1) + number), max(len(distinct), 1))
        length = size[number]
        first = np.cumsum(length) - length
        return np.repeat(row, length), hashed[np.repeat(start[number] - first, length) + np.arange(int(length.sum()))]

    def counted(at, positive):
        p = np.bincount(at, positive).astype(np.int64)
        u = np.bincount(at).astype(np.int64) - p
        return p, u

    def count_buckets(batches):
        p, u = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)  # bounded by the rows of the sample
        for batch in slices(batches, "text", 1 << 19):
            row, grams = pairs(batch)
            row, at = np.divmod(np.unique((row << BITS) + (grams >> np.uint64(64 - BITS)).astype(np.int64)), 1 << BITS)
            at, place = np.unique(at, return_inverse=True)
            more_p, more_u = counted(place, np.asarray(batch.column("positive"))[row])
            p[at] += more_p.astype(np.int32)
            u[at] += more_u.astype(np.int32)
        # all counts, those of one too: how rows lie in tasks must not change the sums
        seen = np.flatnonzero(p + u)
        for i in range(0, len(seen), 1 << 17):
            at = seen[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(p[at].astype(np.int64)), pa.array(u[at].astype(np.int64))], ["at", "p", "u"])

    def strongest(counted: DataFrame, bound: int) -> list:
        p, u = F.col("p") / max(n_p, 1), F.col("u") / max(n_u, 1)
        mean = (F.col("p") + F.col("u")) / max(n_p + n_u, 1)
        z = (p - u) / F.sqrt(mean * (1 - mean + 1e-9) * (1 / max(n_p, 1) + 1 / max(n_u, 1)))
        summed = counted.groupBy("at").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).withColumn("z", z)
        return [r[0] for r in summed.where((F.col("z") > least_z) & (F.col("p") >= 4)).orderBy(F.desc("z"), "at").limit(bound).select("at").collect()]

    buckets = np.sort(np.array(strongest(sample.mapInArrow(count_buckets, "at bigint, p bigint, u bigint"), 4 * most), np.int64))

    def count_grams(batches):
        wanted = np.zeros(1 << BITS, bool)
        wanted[buckets] = True
        for batch in slices(batches, "text"):
            row, grams = pairs(batch, wanted)
            at, place = np.unique(grams, return_inverse=True)
            both = np.unique(row * max(len(at), 1) + place)
            row, place = np.divmod(both, max(len(at), 1))
            p, u = counted(place, np.asarray(batch.column("positive"))[row])
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(p), pa.array(u)], ["at", "p", "u"])

    if not len(buckets):
        return np.zeros(0, np.uint64)
    return np.sort(np.array(strongest(sample.mapInArrow(count_grams, "at bigint, p bigint, u bigint"), most), np.int64).view(np.uint64))


def gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, beta: float = 0.0) -> np.ndarray:
    """Gradient of the non-negative PU risk at the weights ``w`` (bias last); of the negatives' risk upwards while that is below -beta."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    z_p, z_u = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    g_p, g_p_neg, g_u = -sigmoid(-z_p) / len(p), sigmoid(z_p) / len(p), sigmoid(z_u) / len(u)
    negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    over = lambda x, g: np.r_[g @ x, g.sum()].astype(w.dtype)
    rest = over(u, g_u) - prior * over(p, g_p_neg)
    return prior * over(p, g_p) + rest if negative >= -beta else -rest


def fit(x_p: np.ndarray, x_u: np.ndarray, prior: float, seed: int, steps: int = 300, rate: float = 0.1, decay: float = 2e-5, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """A linear classifier of least non-negative PU risk, by Adam on random halves of both sets."""
    random = np.random.default_rng(seed)
    w, m, s = (np.zeros(x_p.shape[1] + 1, np.float32) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        p = x_p[random.integers(0, len(x_p), max(1, len(x_p) // 2))]
        u = x_u[random.integers(0, len(x_u), max(1, len(x_u) // 2))]
        grad = gradient(w, p, u, prior, beta)
        grad[:-1] += decay * w[:-1]
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def drawn(rows: DataFrame, name: str, bound: int, have: int = 0) -> DataFrame:
    """(text) of at most ``bound`` different rows of (key, text), those of the least hashes.

    Rows are chosen one by one, not by key: a key or a copy that repeats without end counts as its different texts do.
    ``have`` rows at least are thinned before they are shuffled. What is drawn is written, so one number reaches the driver.
    """
    h = F.xxhash64(F.lit(7), "key", "text")
    if have > bound:
        rows = rows.where(F.pmod(h, F.lit(1 << 24)) < int((1 << 24) * bound / have))
    kept = landed(rows.select("key", "text").distinct().select("text", F.pmod(h, F.lit(1 << 24)).alias("part"), h.alias("h")), name)
    order = ["part", "h"]
    if kept.count() > bound:
        last = kept.select(*order).orderBy(*order).limit(bound).agg(F.max(F.struct(*order))).first()[0]
        kept = kept.where((F.col("part") < last.part) | ((F.col("part") == last.part) & (F.col("h") <= last.h)))
    return kept.select("text")


def train(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    fold: int = 2, folds: int = 4, max_positive: int = 2_000, max_unlabelled: int = 5_000, max_features: int = 768, classifiers: int = 3, least_z: float = 4.5,
) -> Model:
    """Fit classifiers on rows outside the held-out fold: ``max_positive`` and ``max_unlabelled`` of them at most.

    The prior is the share of toxic rows among the labelled ones. NULL labels and keys are left out; several labels of
    one key count once, as toxic if any says so. Rows that repeat count once, several texts of a key each by itself, within
    the same bounds. Without positives the model scores every text 0.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc_bucket(key, folds) != fold))
    usable = usable.groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("positive"))
    counted = usable.agg(F.count("*"), F.coalesce(F.sum("positive"), F.lit(0))).first()
    docs = documents.where(F.col(key).isNotNull() & (crc_bucket(key, folds) != fold)).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    if not counted[1]:
        return Model(np.zeros(0, np.uint64), np.zeros((1, 0)), np.full(1, -np.inf), 0.0)
    prior = min(max(counted[1] / counted[0], 0.001), 0.9)
    chosen = sampled(usable.where("positive = 1"), "key", counted[1], max_positive).select("key")
    # the sample of keys is bounded, so the side that is broadcast is
    positives = drawn(docs.join(F.broadcast(chosen), "key", "left_semi"), "toxicity-positives", max_positive)
    unlabelled = drawn(docs, "toxicity-unlabelled", max_unlabelled, documents.count())
    sample = positives.withColumn("positive", F.lit(1)).unionByName(unlabelled.withColumn("positive", F.lit(0)))
    features = bucket_counts(sample, max_features, least_z)

    def task(batches):
        finder = Finder(features)
        for batch in slices(batches, "text"):
            row, feature = finder.find(batch.column("text").fill_null(""))
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature.astype(np.int32)))], ["positive", "at"])

    rows = sample.mapInArrow(task, "positive int, at array<int>").collect()  # a bounded sample
    rows.sort(key=lambda r: (r["positive"], r["at"]))  # the same order however the rows lie in tasks
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = 1
    is_p = np.array([r["positive"] for r in rows], bool)
    if not is_p.any() or is_p.all():
        return Model(np.zeros(0, np.uint64), np.zeros((1, 0)), np.full(1, -np.inf), prior)
    fitted = [fit(x[is_p], x[~is_p], prior, seed) for seed in range(classifiers)]
    return Model(features, np.stack([w for w, _ in fitted]), np.array([b for _, b in fitted]), prior)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, score) of every row: the mean probability over the classifiers. NULL and empty texts have no features."""

    def make():
        finder = Finder(model.features)

        def step(batch):
            row, feature = finder.find(batch.column("_text").fill_null(""))
            total = np.zeros(batch.num_rows)
            for w, b in zip(model.weights, model.bias):
                z = np.bincount(row, w[feature], batch.num_rows) + b
                with np.errstate(over="ignore"):
                    total += 1 / (1 + np.exp(-z))
            return pa.RecordBatch.from_arrays([batch.column("_key"), *(batch.column("_text" if c == text else f"_{c}") for c in carry), pa.array(total / len(model.bias))], [key, *carry, "score"])

        return step

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (key, *carry)), "score double"])
    rows = df.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in carry if c != text), F.col(text).cast("string").alias("_text"))
    return arrow_map(rows, make, schema, "_text")
