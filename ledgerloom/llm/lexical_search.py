"""Ranked lexical search, term at a time with limited accumulators.

One pass over the texts counts the terms of the queries in every document (postings) and writes them to the shared folder;
the numbers of documents, words and documents for each term are sums over that. Then every task ranks its own documents:
a query's terms are taken rarest first, and a document that holds one gets an accumulator. Once the greatest scores that
the remaining terms can still give add up to less than the k-th best partial score, no further accumulator is made, and
the remaining terms only add to those there are. So every document that could be among the best is scored exactly. A task
carries its k best of each query from batch to batch, and what it ends with is merged by rank.

Scores are integers: ``w * ((10**9 * tf) div (1000 * tf + 8 * m))`` for each term, with the weight
``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and the length norm ``m = 10 + (90 * n * N) div L``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import landed, slices

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: what every byte of a text stands for: ASCII letters in lower case, digits and all beyond ASCII for themselves, others for a blank
BYTES = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
BYTES[ord("A") : ord("Z") + 1] += 32
#: distinct terms that one pass over the documents looks for
TERMS_A_PASS = 200_000
POSTINGS = "id bigint, n bigint, terms array<int>, counts array<int>"


def query_terms(text: str | None) -> list[str]:
    """Distinct terms in the order of their first place; none for NULL."""
    return list(dict.fromkeys(TERM.findall((text or "").translate(LOWER))))


def term_lists(texts: pa.StringArray) -> pa.ListArray:
    """The terms of every text, with empty strings between separators. Works on the bytes of all texts at once."""
    if texts.offset or texts.null_count:
        texts = pa.concat_arrays([texts.fill_null("")])
    _, offsets, data = texts.buffers()
    plain = BYTES[np.frombuffer(data, np.uint8)] if data else np.zeros(0, np.uint8)
    return pc.split_pattern(pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(plain)), " ")


def postings(documents: DataFrame, terms: list[str]) -> DataFrame:
    """(id, n, terms, counts) of documents (id, text): number of terms, and how often each of ``terms`` occurs, by its number."""

    def task(batches: Iterator[pa.RecordBatch]):
        wanted = pa.array(terms, pa.string())
        for batch in slices(batches, "text"):
            lists = term_lists(batch.column("text"))
            values = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
            n = np.bincount(row[np.asarray(pc.greater(pc.binary_length(values), 0))], minlength=len(lists))
            number = np.asarray(pc.index_in(values, value_set=wanted).fill_null(-1), dtype=np.int64)
            hit = number >= 0
            pair, count = np.unique(row[hit] * len(terms) + number[hit], return_counts=True)
            row, number = np.divmod(pair, max(len(terms), 1))
            cuts = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(lists)))].astype(np.int32))
            held, counted = (pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (number, count))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), held, counted], ["id", "n", "terms", "counts"])

    return documents.mapInArrow(task, POSTINGS)


class Best:
    """The k best (score, id, row) so far, best first: higher scores, then smaller ids, NULL ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.r_[self.score, score], np.r_[self.id, ids], np.r_[self.null, null]
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]

    def least(self) -> int:
        """A score that a document must reach to be among the best; 1 while there are fewer than k."""
        return int(self.score[-1]) if len(self.score) == self.k else 1


def rank_batch(lists: list[np.ndarray], rows: np.ndarray, gain: np.ndarray, size: int, best: Best) -> tuple[np.ndarray, np.ndarray]:
    """(row, score) of the documents of a batch that can be among the k best, scored exactly.

    ``lists``: for each term, rarest first, the places of its postings in ``rows`` (document rows) and ``gain`` (scores).
    """
    score, made = np.zeros(size, np.int64), np.zeros(size, bool)
    most = [int(gain[x].max(initial=0)) for x in lists]
    rest = np.r_[np.cumsum(most[::-1])[::-1], 0].tolist()
    open_ = True
    for x, left in zip(lists, rest):
        if open_:
            # the k-th best partial score of this batch and of what the task has seen
            partial = score[made]
            bar = best.least()
            if len(partial) >= best.k:
                bar = max(bar, int(np.partition(partial, len(partial) - best.k)[len(partial) - best.k]))
            open_ = left >= bar
        if open_:
            made[rows[x]] = True
            score[rows[x]] += gain[x]
        else:
            x = x[made[rows[x]]]
            score[rows[x]] += gain[x]
    row = np.flatnonzero(made & (score >= best.least()))
    return row, score[row]


def ranked(found: DataFrame, weight: np.ndarray, queries: list[tuple[int, list[int]]], documents: int, words: int, k: int) -> DataFrame:
    """(item, id, score): for each task the k best of its documents for every query. ``queries`` have terms rarest first."""

    def task(batches: Iterator[pa.RecordBatch]):
        best = [Best(k) for _ in queries]
        for batch in batches:
            ids = batch.column("id")
            null = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0), dtype=np.int64)
            n = np.asarray(batch.column("n"), dtype=np.int64)
            norm = 10 + 90 * n * documents // words
            lists, counted = batch.column("terms"), batch.column("counts")
            row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
            term = np.asarray(lists.flatten(), dtype=np.int64)
            tf = np.asarray(counted.flatten(), dtype=np.int64)
            gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * norm[row]))
            by = np.argsort(term, kind="stable")
            cuts = np.searchsorted(term[by], np.arange(len(weight) + 1))
            for (_, terms), top in zip(queries, best):
                held = [by[cuts[t] : cuts[t + 1]] for t in terms if cuts[t + 1] > cuts[t]]
                if held:
                    at, score = rank_batch(held, row, gain, len(ids), top)
                    top.add(score, ids[at], null[at])
        out = [(q, s, i, z) for (q, _), b in zip(queries, best) for s, i, z in zip(b.score.tolist(), b.id.tolist(), b.null.tolist())]
        for start in range(0, len(out), 65536):
            part = out[start : start + 65536]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in part], pa.int64()), pa.array([None if x[3] else x[2] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64())],
                ["item", "id", "score"],
            )

    return found.mapInArrow(task, "item bigint, id bigint, score bigint")


def passes(items: DataFrame, most: int) -> Iterator[dict[int, list[str]]]:
    """The queries (item, text) in parts of about ``most`` distinct terms: terms by item. One part at a time is on the driver."""
    part, seen = {}, set()
    for r in items.orderBy("item").toLocalIterator():
        terms = query_terms(r.text)
        # rows of one item are next to each other and stay in one part
        if r.item not in part and len(seen) >= most:
            yield part
            part, seen = {}, set()
        part[r.item] = list(dict.fromkeys(part.get(r.item, []) + terms))
        seen.update(terms)
    if part:
        yield part


def search(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 10, terms_a_pass: int = TERMS_A_PASS
) -> DataFrame:
    """(item, rank, key, score) of the k documents with the highest score above 0 for every item.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case; NULL texts have none. All
    documents with a term count in the statistics. Equal scores stand by ascending key, NULL keys last; rows that share a
    key are documents of their own with ranks of their own. Rows that share an item are one query with the terms of all;
    rows with a NULL item, and items without terms, have no result. Other columns are passed over. The queries are taken
    in parts of ``terms_a_pass`` distinct terms (one longer query is a part), with a pass over the documents for each.
    """
    kind, item_kind = dict(documents.dtypes)[key], dict(items.dtypes)[item]
    docs = documents.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    asked = items.where(F.col(item).isNotNull()).select(F.col(item).cast("bigint").alias("item"), F.col(item_text).cast("string").alias("text"))
    parts = []
    for part in passes(asked, terms_a_pass):
        terms = sorted({t for ts in part.values() for t in ts})
        number = {t: i for i, t in enumerate(terms)}
        found = landed(postings(docs, terms), "postings").where("n > 0")
        total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        # one number for each term of this part
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r[0]] = r[1]
        weight = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        queries = [(q, sorted((number[t] for t in ts), key=lambda t: (df[t], t))) for q, ts in part.items()]
        parts.append(ranked(found, weight, queries, total[0], max(total[1], 1), k))
    if not parts:
        parts.append(documents.sparkSession.createDataFrame([], "item bigint, id bigint, score bigint"))
    merged = parts[0]
    for more in parts[1:]:
        merged = merged.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    top = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select(F.col("item").cast(item_kind).alias(item), "rank", F.col("id").cast(kind).alias(key), "score")
