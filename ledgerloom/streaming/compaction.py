"""Folding closed batches of the changelog into segments, so that what readers list does not grow with its history.

A segment holds the rows of consecutive batches, laid out by kind, chain and block bucket and sorted by block; nothing
is dropped, the changelog stays the only source of truth. ``fan`` batches become a segment, ``fan`` neighbouring segments
of one level become one of the next: each row is rewritten once for each level, and at most ``fan`` segments of a level and
about ``2 * fan`` batches are live. The manifest names the live segments; batches beyond the last of them are the tail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.streaming import manifest as L

FAN = 8
FOLDERS = ("kind", "chain_id", "block_bucket")


def batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in L.names(spark, path) if n.startswith("batch_id="))


def segments(spark: SparkSession, path: str) -> list[dict]:
    """Live segments {first, last, level, name}, oldest first."""
    return sorted(L.live(spark, path)[1], key=lambda s: s["first"])


def tail(spark: SparkSession, path: str, folded: list[dict]) -> list[int]:
    """Batches that no live segment holds."""
    last = folded[-1]["last"] if folded else -1
    return [b for b in batches(spark, path) if b > last]


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of live segments and of the tail; filters on kind, chain and bucket prune folders of both."""
    folded = segments(spark, path)
    if not folded:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    rows = _of_segments(spark, path, schema, folded)
    open_ = tail(spark, path, folded)
    if open_:
        rows = rows.unionByName(_of_batches(spark, path, schema, open_))
    return rows


def _of_batches(spark: SparkSession, path: str, schema: T.StructType, numbers: list[int]) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/batch_id={b}" for b in numbers])


def _of_segments(spark: SparkSession, path: str, schema: T.StructType, chosen: list[dict]) -> DataFrame:
    places = [f"{path}/_segments/segment={s['name']}" for s in chosen]
    return spark.read.schema(schema).option("basePath", f"{path}/_segments").parquet(*places).select(*schema.fieldNames())


def fold(spark: SparkSession, path: str, schema: T.StructType, closed: int, fan: int = FAN) -> int:
    """Fold batches up to number ``closed`` while ``fan`` of them, or ``fan`` segments of a level, lie together.

    Returns the number of segments written. Safe to run again after a crash: a segment counts once the manifest names it.
    Batches and segments that a version before the last one replaced are deleted; readers of the last two versions go on.
    """
    written = 0
    while True:
        folded = segments(spark, path)
        waiting = [b for b in tail(spark, path, folded) if b <= closed]
        level = next((k for k in sorted({s["level"] for s in folded}) if sum(s["level"] == k for s in folded) >= fan), None)
        if level is not None:
            old = [s for s in folded if s["level"] == level][:fan]
            rows, bounds, level = _of_segments(spark, path, schema, old), (old[0]["first"], old[-1]["last"]), level + 1
        elif len(waiting) >= fan:
            old, chosen = [], waiting[:fan]
            rows, bounds, level = _of_batches(spark, path, schema, chosen), (chosen[0], chosen[-1]), 0
        else:
            return written
        name = f"{bounds[0]}-{bounds[1]}-{level}"
        (
            rows.hint("rebalance", *FOLDERS)
            .sortWithinPartitions(*FOLDERS, "block_number", "seq")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy(*FOLDERS)
            .parquet(f"{path}/_segments/segment={name}")
        )
        version, _ = L.live(spark, path)
        _clean(spark, path, folded)
        kept = [s for s in folded if s not in old]
        L.commit(spark, path, version + 1, [*kept, {"first": bounds[0], "last": bounds[1], "level": level, "name": name}])
        written += 1


def _clean(spark: SparkSession, path: str, folded: list[dict]) -> None:
    """Delete what the live version replaced: batches within its segments and segments that it does not name."""
    last = folded[-1]["last"] if folded else -1
    for b in batches(spark, path):
        if b <= last:
            L.delete(spark, f"{path}/batch_id={b}")
    for n in L.names(spark, f"{path}/_segments"):
        name = n.split("=")[-1]
        first, end, _ = map(int, name.split("-"))
        if any(s["first"] <= first and end <= s["last"] and s["name"] != name for s in folded):
            L.delete(spark, f"{path}/_segments/{n}")
