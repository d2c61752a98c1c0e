"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of ``halves`` hash values are made for a document, each value from ``rows`` minhashes. A table key is a
pair of one value of the first collection and one of the second: ``halves ** 2`` tables from ``2 * halves * rows``
minhashes. A pair of documents at similarity s shares a table with probability ``(1 - (1 - s**rows) ** halves) ** 2``:
0.99985 at 0.85 with the defaults.

Equal sets are one class from the start. Documents that share a table are compared without emitting all pairs:

1. in every table bucket all members are compared with one centre, the member that meets most others anywhere;
2. buckets that still hold several components form families, joined by their centres. Within a family, blocks of documents
   are compared by exact matrix products, but never two blocks of the main component. A task holds two blocks.

Every comparison counts the intersection of the full sets of 64-bit shingle hashes. What links two documents is thus
exact; only the candidates depend on minhashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Rows, WordIndex, arrow_map, landed, mixed, split_words
from ledgerloom.llm.components import components

SHINGLE = 5
BLOCK = 256


class Shingler:
    """Shingle sets of texts as sorted distinct 64-bit hashes; keeps hashes of words it has seen, up to a bound."""

    def __init__(self, width: int = SHINGLE):
        self.width = width
        self.reset()
        self.index = WordIndex(self.add, self.reset)

    def reset(self) -> None:
        self.hashes = Rows(np.uint64)

    def add(self, words: list) -> None:
        self.hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """A-Z are lower-cased and words split at ASCII white space. With fewer words than the width, all are one shingle."""
        count, distinct, number = split_words(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
        number = self.index.numbers(distinct)[number]
        word = mixed(self.hashes.data[number])
        ends = np.cumsum(count)
        rolled = np.zeros(max(len(word) - self.width + 1, 0), np.uint64)
        for k in range(self.width):
            rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word[k : k + len(rolled)]
        rolled = mixed(rolled)
        out = []
        for end, n in zip(ends.tolist(), count.tolist()):
            if n >= self.width:
                own = np.sort(rolled[end - n : end - self.width + 1])
                out.append(own[np.r_[True, own[1:] != own[:-1]]])
            elif n:
                whole = np.uint64(xxhash.xxh3_64_intdigest(word[end - n : end].tobytes()))
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def fingerprints(df: DataFrame, key: str, text: str, halves: int, rows: int, seed: int = 1) -> DataFrame:
    """(id, n_shingles, class, signature) of each row: class is a digest of the set, signature one minhash after another."""
    factors = np.random.default_rng(seed).integers(1, 1 << 63, 2 * halves * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def make():
        shingler = Shingler()

        def step(batch):
            n, classes, signatures = [], [], []
            for s in shingler.sets(batch.column("text").fill_null("")):
                n.append(len(s))
                classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                least = np.full(len(factors), np.uint64(2**64 - 1))
                for k in range(0, len(s), 4096):
                    least = np.minimum(least, (s[k : k + 4096, None] * factors).min(0))
                signatures.append((least >> np.uint64(32)).astype("<u4").tobytes() if len(s) else None)
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())],
                ["id", "n_shingles", "class", "signature"],
            )

        return step

    rows_in = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows_in, make, "id bigint, n_shingles bigint, class binary, signature binary", "text")


def table_keys(representatives: DataFrame, halves: int, rows: int) -> DataFrame:
    """(id, table, key) of the tensored tables. Half values that only one document has make no keys."""
    width = 4 * rows
    half = representatives.select("id", F.expr(
        f"posexplode(transform(sequence(0, {2 * halves - 1}), i -> xxhash64(i, substring(signature, i * {width} + 1, {width}))))"
    ).alias("at", "half"))
    shared = half.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    own = half.join(shared, "half", "left_semi").groupBy("id").agg(F.collect_list(F.struct("at", "half")).alias("h"))
    pairs = f"""explode(flatten(transform(filter(h, x -> x.at < {halves}), x ->
        transform(filter(h, y -> y.at >= {halves}), y -> named_struct('table', x.at * {halves} + y.at - {halves}, 'key', xxhash64(x.half, y.half))))))"""
    return own.select("id", F.expr(pairs).alias("t")).select("id", "t.table", "t.key")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose texts' sets are similar enough. One text of a meets the texts of its partners.

    Rows are dealt by (a, part), where an a with many partners has a part for every ``BLOCK`` of them; in each part its
    text comes first, and the task keeps one set at a time.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("id"), F.lit(1).alias("turn"))
    first = many.select("a", F.explode(F.expr("sequence(0L, parts - 1L)")).alias("part"), F.col("a").alias("id"), F.lit(0).alias("turn"))
    rows = dealt.union(first).join(texts, "id").repartition("a", "part").sortWithinPartitions("a", "part", "turn")

    def task(batches: Iterator[pa.RecordBatch]):
        shingler, current, centres = Shingler(), None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                piece = batch.slice(start, 512)
                found = []
                a, part, ids, turn = (piece.column(c).to_pylist() for c in ("a", "part", "id", "turn"))
                for k, s in enumerate(shingler.sets(piece.column("text").fill_null(""))):
                    if (a[k], part[k]) != current:
                        current, centres = (a[k], part[k]), []
                    if turn[k] == 0:
                        centres.append(s)  # more than one only if rows share a key
                    elif any(linked(c, s, percent) for c in centres):
                        found.append((a[k], ids[k]))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    return rows.select("a", "part", "id", "turn", "text").mapInArrow(task, "a bigint, b bigint")


def block_links(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of a family, exact and without emitting pairs.

    ``members``: (family, id, component). The family's most frequent component is its main one. Blocks of about ``BLOCK``
    documents hold either main or other members; every block of others meets every block, and one group holds two blocks.
    There the intersections of all pairs are one matrix product over the shingles that at least two of them share. A group
    returns a link for components that it joins, so no more links than documents.
    """
    per = members.groupBy("family", "component").agg(F.count("*").alias("c"))
    main = per.groupBy("family").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("size"))
    main = main.select(
        "family", F.col("top.component").alias("main"),
        F.ceil(F.col("top.c") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("size") - F.col("top.c")) / BLOCK).cast("int").alias("others"),
    ).where("others > 0")
    own = members.join(main, "family").withColumn("is_main", F.expr("component = main")).withColumn(
        "block", F.expr("cast(if(is_main, others + pmod(xxhash64(id), mains), pmod(xxhash64(id), others)) as int)")
    )
    other = F.explode(F.expr("sequence(0, if(is_main, others, others + mains) - 1)")).alias("other")
    grouped = own.select("family", "id", "component", "block", other).select(
        "family", "id", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    ).join(texts, "id").repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")

    def compare(hi: int, group: list) -> list[tuple[int, int]]:
        right = np.array([g[1] == hi for g in group])
        left = ~right if right.any() and not right.all() else np.ones(len(group), bool)
        right = right if not left.all() else left
        ids, component = np.array([g[0] for g in group]), np.array([g[2] for g in group])
        sets = [g[3] for g in group]
        size = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), size)
        _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = often > 1
        row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((left.sum(), right.sum()), np.float32)
        for start in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(column, [start, start + 4096])
            x = np.zeros((len(sets), 4096), np.float32)
            x[row[a:b], column[a:b] - start] = 1
            common += x[left] @ x[right].T
        total = size[left][:, None] + size[right] - common
        i, j = np.nonzero((100 * common >= percent * total) & (component[left][:, None] != component[right]))
        i, j = np.flatnonzero(left)[i], np.flatnonzero(right)[j]
        root, links = {}, []

        def top(c):
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        for x, y in zip(i.tolist(), j.tolist()):
            p, q = top(component[x]), top(component[y])
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((int(ids[x]), int(ids[y])))
        return links

    def task(batches):
        shingler, current, group = Shingler(), None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                piece, links = batch.slice(start, 512), []
                ids, family, lo, hi, block, component = (piece.column(c).to_pylist() for c in ("id", "family", "lo", "hi", "block", "component"))
                for k, s in enumerate(shingler.sets(piece.column("text").fill_null(""))):
                    if (family[k], lo[k], hi[k]) != current:
                        if group:
                            links += compare(current[2], group)
                        current, group = (family[k], lo[k], hi[k]), []
                    group.append((ids[k], block[k], component[k], s))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])
        if group:
            links = compare(current[2], group)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

    return grouped.select("id", "family", "lo", "hi", "block", "component", "text").mapInArrow(task, "a bigint, b bigint")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, halves: int = 10, rows: int = 3) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row: documents linked at ``percent`` / 100 Jaccard similarity or more.

    A document's set holds its distinct shingles of five words; shorter ones are a single shingle. Rows without words
    (empty or NULL text) are linked with nothing. Rows with a NULL key stay by themselves with a NULL component and are
    kept. Rows that share a key are one document and share a component.
    """
    prints = landed(fingerprints(df, key, text, halves, rows), "fingerprints")
    usable = prints.where("id IS NOT NULL AND class IS NOT NULL")
    classes = landed(usable.groupBy("class").agg(F.min("id").alias("rep")), "classes")
    heads = usable.join(classes.withColumnRenamed("class", "c"), (F.col("id") == F.col("rep")) & (F.col("class") == F.col("c")), "left_semi")
    keys = landed(table_keys(heads.select("id", "signature"), halves, rows), "tables")
    full = keys.groupBy("table", "key").agg(F.count("*").alias("members")).where("members > 1")
    keys = landed(keys.join(full, ["table", "key"]), "buckets")
    meets = keys.groupBy("id").agg(F.sum("members").alias("meets"))
    meets = landed(meets, "meets")
    texts = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    texts = landed(texts.join(meets, "id", "left_semi"), "candidate-texts")

    centre = keys.join(meets, "id").groupBy("table", "key").agg(F.max(F.struct("meets", (-F.col("id")).alias("low"))).alias("top"))
    centre = centre.select("table", "key", (-F.col("top.low")).alias("a"))
    starred = landed(keys.join(centre, ["table", "key"]).select("table", "key", "a", F.col("id").alias("b")), "stars-of-buckets")
    edges = landed(verified(starred.select("a", "b").where("a != b").distinct(), texts, percent), "links")
    found = components(edges)

    labelled = starred.join(found.withColumnRenamed("id", "b"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    split = labelled.groupBy("table", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("table", "key")
    open_ = landed(labelled.join(split, ["table", "key"], "left_semi").select("a", "b", "component").distinct(), "open")
    families = components(open_).withColumnRenamed("component", "family")
    members = open_.select(F.col("b").alias("id"), "component").distinct().join(families, "id")
    more = landed(block_links(members, texts, percent), "more-links")
    found = components(edges.union(more))

    by_class = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
    kind = dict(df.dtypes)[key]
    out = prints.join(by_class, "class", "left").select(
        F.col("id").cast(kind).alias(key), "n_shingles", F.coalesce("component", "id").cast(kind).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
