"""Approximate nearest neighbours by several shifted Hilbert orderings.

Vectors are projected on their main axes (fitted on a bounded sample), turned and shifted differently for each curve, put
on a grid and numbered along a Hilbert curve. Rows are dealt by ranges of (curve, key); a query looks at the rows next to
its key on every curve. Windows hold one byte for each component; what looks nearest in them is merged over the curves and
ranked by exact Euclidean distance on the original vectors.

A window holds ``window_share`` of the rows on either side, ``window`` at least: in data without clusters the number of
rows nearer than a true neighbour on a curve grows with the rows, and a fixed window would lose recall. A window is an
interval of keys, by the keys of the sample. A range holds about ``range_rows`` rows however large the window is; a query
goes to every range that its window meets, and the lists of all ranges are merged in Spark.

Crowded places: tight groups, found in the sample, are segments with axes, grids and one-byte steps of their own, around
their own centre, and tight groups in them likewise. A row is in one segment; a query asks every segment that can hold one
of its neighbours. Rows nearer to a query than the error of their bytes are all ranked exactly.

Copies: of equal vectors the rows with the smallest ids are enough, so at most neighbours + 1 of them are searched; equal
query vectors are searched once. Rows of one grid cell are ordered by a hash, another one on each curve.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import landed, mixed, sampled

TIE_BITS = 14


@dataclass
class Curves:
    turn: list[np.ndarray]  # vector -> grid axes, one matrix for each curve
    low: list[np.ndarray]
    scale: list[np.ndarray]
    bits: int
    marks: list[np.ndarray]  # sorted keys of the sample on each curve
    splits: list[np.ndarray]  # key ranges of each curve
    step: np.ndarray  # of one-byte components
    parts: int = 1  # a range is dealt in so many parts
    reach: int = 1  # keys of the sample on either side of a window

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.round(vectors / self.step).clip(-127, 127).astype(np.int8)

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        cells = ((vectors @ self.turn[curve] - self.low[curve]) * self.scale[curve]).clip(0, (1 << self.bits) - 1).astype(np.uint64)
        tie = mixed(mixed(np.ascontiguousarray(vectors).view(np.uint64).sum(1, dtype=np.uint64)) + np.uint64(curve)) >> np.uint64(64 - TIE_BITS)
        return ((hilbert(cells, self.bits) << np.uint64(TIE_BITS)) | tie).astype(np.int64)

    def window(self, keys: np.ndarray, curve: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last key of the window around each key."""
        marks = np.r_[np.full(self.reach, np.iinfo(np.int64).min), self.marks[curve], np.full(self.reach, np.iinfo(np.int64).max)]
        low, high = np.searchsorted(self.marks[curve], keys), np.searchsorted(self.marks[curve], keys, side="right")
        return marks[low], marks[high + 2 * self.reach - 1]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Number of each cell along the Hilbert curve; cells are rows of ``bits``-bit coordinates (Skilling 2004)."""
    x = cells.T.copy()
    n = len(x)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - np.uint64(1)
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - np.uint64(1), np.uint64(0))
        q >>= np.uint64(1)
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out


def fit_curves(sample: np.ndarray, curves: int, axes: int, bits: int, ranges: int, seed: int = 5) -> Curves:
    """Turns, shifts and key ranges from a sample of vectors: each curve's grid is a random turn of the main axes."""
    random = np.random.default_rng(seed)
    centred = sample - sample.mean(0)
    _, _, main = np.linalg.svd(centred[: 4 * max(centred.shape[1], 500)], full_matrices=False)
    axes = min(axes, len(main))
    out = Curves([], [], [], bits, [], [], np.maximum(np.abs(sample).max(0), 1e-12) * (1.02 + 30 / len(sample)) / 127)
    keep = main[: min(len(main), 4 * axes)]
    for c in range(curves):
        turned, _ = np.linalg.qr(random.normal(size=(len(keep), len(keep))))
        # each curve sees other directions of the main axes
        out.turn.append(keep.T @ turned[:, :axes])
        at = sample @ out.turn[c]
        low, high = np.quantile(at, 0.001, axis=0), np.quantile(at, 0.999, axis=0)
        width = np.maximum(high - low, 1e-12) * 1.25
        out.low.append(low - random.uniform(0, 0.2, axes) * width)
        out.scale.append((1 << bits) / width)
        out.marks.append(np.sort(out.keys(sample, c)))
        out.splits.append(np.unique(out.marks[c][np.arange(1, ranges) * len(sample) // ranges]))
    return out


def tight_groups(sample: np.ndarray, least: int, ratio: float = 0.25, pivots: int = 1024, most: int = 64, seed: int = 3) -> list[tuple[np.ndarray, float]]:
    """Centre and radius of groups of ``least`` rows or more that lie much nearer to each other than the rows around them do.

    Groups in a group come after it. From pivots, the ``least``-th nearest row is compared with the median one.
    """
    random = np.random.default_rng(seed)
    out, todo = [], [sample]
    while todo and len(out) < most:
        own = todo.pop(0)
        while len(own) >= 4 * least and len(out) < most:
            at = own - own.mean(0)
            size = (at**2).sum(1)
            chosen = random.permutation(len(own))[:pivots]
            best = (ratio, None)
            for i in range(0, len(chosen), 128):
                some = chosen[i : i + 128]
                d = np.sqrt(np.maximum(size[some][:, None] + size - 2 * at[some] @ at.T, 0))
                d.partition((least, len(own) // 2), axis=1)
                # where most rows are one group, the median is inside it: the farthest rows count then
                tight = d[:, least] / np.maximum(np.maximum(d[:, len(own) // 2], d.max(1) / 2), 1e-300)
                if tight.min() < best[0]:
                    best = (tight.min(), some[tight.argmin()])
            if best[1] is None:
                break
            d = np.sort(np.sqrt(((at - at[best[1]]) ** 2).sum(1)))
            gap = d[least + 1 :] / np.maximum(d[least:-1], 1e-300)
            cut = least + int(gap.argmax()) if gap.max() > 1.5 else int(np.searchsorted(d, 2 * d[least], side="right")) - 1
            members = np.sqrt(((at - at[best[1]]) ** 2).sum(1)) <= d[cut]
            centre = own[members].mean(0)
            away = np.sqrt(((own - centre) ** 2).sum(1))
            radius = away[members].max() * 1.25
            if (~members).any():
                radius = max(away[members].max(), min(radius, (away[members].max() + away[~members].min()) / 2))
            members = away <= radius
            if members.all():
                break
            out.append((centre, float(radius)))
            todo.append(own[members])
            own = own[~members]
    return out


def segment_of(vectors: np.ndarray, groups: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Number of the last group that holds each vector, from 1; 0 for vectors in none."""
    out = np.zeros(len(vectors), np.int64)
    for i, (centre, radius) in enumerate(groups, 1):
        out[((vectors - centre) ** 2).sum(1) <= radius**2] = i
    return out


def nearest(
    df: DataFrame, query: Column, key: str = "vec_id", vector: str = "embedding", neighbours: int = 10, curves: int = 32, window: int = 512,
    window_share: float = 0.02, axes: int = 8, bits: int = 6, range_rows: int = 8192, max_sample: int = 20_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest rows to every row where ``query`` holds, itself left out.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id. Vectors that are NULL, zero, or
    hold NULL or non-finite components take no part, nor do rows with a NULL key and vectors of another length than the
    most frequent one (the longer, if two are as frequent). With few rows all are returned. Rows that share a key are
    candidates one by one; as a query the key is asked once for each different vector.
    """
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), query.alias("is_query"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(
        F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0)")
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    kind = dict(df.dtypes)[key]
    empty = df.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    if not sizes:
        return empty
    width, total = sizes[0]
    rows = rows.where(F.size("v") == width).withColumn("same", F.xxhash64("v"))
    first = Window.partitionBy("same").orderBy("id")
    few = rows.select("id", "v", "same", F.row_number().over(first).alias("r")).where(F.col("r") <= neighbours + 1).select("id", "v")
    few = landed(few, "vectors")
    asked = rows.where("is_query")
    classes = landed(asked.groupBy("same").agg(F.min("id").alias("id"), F.first("v").alias("v")), "query-vectors")

    sample = sampled(rows.select("id", "v"), "id", total, max_sample).limit(2 * max_sample).select("v").toPandas()
    if not len(sample):
        sample = rows.select("v").limit(max_sample).toPandas()
    points = np.unique(np.stack(sample["v"].to_numpy()), axis=0)
    points = points[np.random.default_rng(11).permutation(len(points))]
    groups = tight_groups(points, max(32, len(points) // 300))
    centres = [np.zeros(width), *(centre for centre, _ in groups)]
    of, each, fitted = segment_of(points, groups), total / len(points), []
    for i, centre in enumerate(centres):
        own = points[of == i] if (of == i).any() else points
        have = (of == i).sum() * each
        ranges = max(1, -(-int(have) // range_rows))
        cut = max(1, min(ranges, len(own) // 8))
        fitted.append(fit_curves(own - centre, curves, axes, bits, cut, seed=5 + i))
        fitted[-1].parts = -(-ranges // cut)
        fitted[-1].reach = max(16, int(max(window, window_share * have) / each) + 1)
    probes = points[:4000] if groups else points[:0]
    wide = np.dtype("<f4" if dict(df.dtypes)[vector] == "array<float>" else "<f8")

    def farthest(v: np.ndarray) -> np.ndarray:
        """No neighbour of a query is farther than this: the distance to some row of the sample."""
        if len(probes) <= neighbours:
            return np.full(len(v), np.inf)
        out = []
        for i in range(0, len(v), 256):
            d = (v[i : i + 256] ** 2).sum(1)[:, None] + (probes**2).sum(1) - 2 * v[i : i + 256] @ probes.T
            out.append(np.sqrt(np.maximum(np.partition(d, neighbours, axis=1)[:, neighbours], 0)))
        return np.concatenate(out) * (1 + 1e-6) + 1e-6 * np.sqrt((v**2).sum(1))

    names = ["segment", "curve", "block", "part", "asks", "k", "last", "id", "code"]

    def dealt_rows(segment, c, block, part, asks, k, last, ids, data):
        n = len(k)
        code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(data.shape[1] * data.itemsize), n, [None, pa.py_buffer(np.ascontiguousarray(data).tobytes())]).cast(pa.binary())
        columns = [np.full(n, segment, np.int32), np.full(n, c, np.int32), block.astype(np.int64), part.astype(np.int32), np.full(n, asks), k, last, ids]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), code], names)

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = np.asarray(batch.column("v").flatten()).reshape(-1, width), np.asarray(batch.column("id"))
            segment = segment_of(v, groups)
            for i in np.unique(segment).tolist():
                f, at, own = fitted[i], v[segment == i] - centres[i], ids[segment == i]
                codes, part = f.codes(at), (mixed(own.astype(np.uint64)) % np.uint64(f.parts)).astype(np.int32)
                for c in range(curves):
                    k = f.keys(at, c)
                    yield dealt_rows(i, c, np.searchsorted(f.splits[c], k, side="right"), part, False, k, k, own, codes)

    def ask(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = np.asarray(batch.column("v").flatten()).reshape(-1, width), np.asarray(batch.column("id"))
            limit = farthest(v)
            for i, f in enumerate(fitted):
                near = np.sqrt(((v - centres[i]) ** 2).sum(1)) <= limit + groups[i - 1][1] if i else np.ones(len(v), bool)
                if not near.any():
                    continue
                at, own, data = v[near] - centres[i], ids[near], v[near].astype(wide)
                for c in range(curves):
                    first, last = f.window(f.keys(at, c), c)
                    block, end = (np.searchsorted(f.splits[c], x, side="right") for x in (first, last))
                    while len(on := np.flatnonzero(block <= end)):
                        for part in range(f.parts):
                            for some in np.array_split(on, -(-len(on) // 2000)):
                                yield dealt_rows(i, c, block[some], np.full(len(some), part), True, first[some], last[some], own[some], data[some])
                        block = block + 1

    schema = "segment int, curve int, block bigint, part int, asks boolean, k bigint, last bigint, id bigint, code binary"
    dealt = few.mapInArrow(deal, schema).union(classes.select("id", "v").mapInArrow(ask, schema))
    dealt = dealt.repartition("segment", "curve", "block", "part").sortWithinPartitions("segment", "curve", "block", "part", "asks", "k")
    listed = 4 * (neighbours + 1)

    def search(batches):
        current, parts, own = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([np.asarray(batch.column(x), dtype=np.int64) for x in ("segment", "curve", "block", "part")], 1)
            k, last, ids = (np.asarray(batch.column(x)) for x in ("k", "last", "id"))
            asks = np.array(batch.column("asks").to_pylist())
            cuts = np.r_[0, np.flatnonzero((place[1:] != place[:-1]).any(1) | (asks[1:] != asks[:-1])) + 1, len(k)].tolist()
            for a, b in zip(cuts, cuts[1:]):
                if (here := tuple(place[a].tolist())) != current:
                    current, parts, own = here, [], None
                data = b"".join(batch.column("code").slice(a, b - a).to_pylist())
                segment = here[0]
                if not asks[a]:
                    parts.append((k[a:b], ids[a:b], np.frombuffer(data, np.int8).reshape(-1, width)))
                elif parts:
                    if own is None:
                        own = [np.concatenate(x) for x in zip(*parts)]
                        own[2] = own[2] * fitted[segment].step.astype(np.float32)
                        own.append((own[2] ** 2).sum(1))
                    v = (np.frombuffer(data, wide).reshape(-1, width) - centres[segment]).astype(np.float32)
                    # a byte is off by half a step at most; rows within twice that error of the query cannot be told apart
                    yield from around(own, k[a:b], last[a:b], ids[a:b], v, float(np.sqrt((fitted[segment].step ** 2).sum())))

    def around(own, first, last, ids, v, error):
        keys, candidates, points, sizes = own
        out, held = ([], [], []), 0
        starts, ends = np.searchsorted(keys, first), np.searchsorted(keys, last, side="right")
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            if a < b:
                d = np.sqrt(np.maximum(sizes[a:b] + (v[i] ** 2).sum() - 2 * (points[a:b] @ v[i]), 0))
                d[d <= error] = 0
                best = np.argpartition(d, listed)[:listed] if len(d) > listed else np.arange(len(d))
                if len(d) > listed:
                    best = np.union1d(best, np.flatnonzero(d == 0))
                for x, part in zip(out, (np.full(len(best), ids[i]), candidates[a:b][best], d[best])):
                    x.append(part)
                held += len(best)
            if held and (held > 1 << 17 or i == len(v) - 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["class", "vec", "score"])
                out, held = ([], [], []), 0

    found = dealt.mapInArrow(search, "class bigint, vec bigint, score float").groupBy("class", "vec").agg(F.min("score").alias("score"))
    found = found.withColumn("close", F.col("score") == 0)
    ahead = Window.partitionBy("class", "close").orderBy("score", "vec")
    found = found.withColumn("r", F.row_number().over(ahead)).where(F.col("close") | (F.col("r") <= 2 * listed)).select("class", "vec")
    top = Window.partitionBy("class").orderBy("score", "vec")
    exact = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    found = found.join(few.select(F.col("id").alias("vec"), "v"), "vec").join(classes.select(F.col("id").alias("class"), F.col("v").alias("q")), "class")
    found = found.select("class", "vec", exact.alias("score")).groupBy("class", "vec").agg(F.min("score").alias("score"))
    found = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= neighbours + 1).drop("r")
    named = classes.select(F.col("id").alias("class"), "same")
    answers = asked.select("id", "same").distinct().join(named, "same").join(found, "class").where("id != vec")
    last = Window.partitionBy("id", "same").orderBy("score", "vec")
    answers = landed(answers.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= neighbours), "neighbours")
    return answers.select(F.col("id").cast(kind).alias("query_id"), "rank", F.col("vec").cast(kind).alias("vec_id"), "score")
