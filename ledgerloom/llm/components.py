"""Connected components of an edge table by local forests, least neighbours and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.llm.common import landed, remove

#: edges that a task joins at a time
EDGES = 1 << 19


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it reaches) of every node that reaches a lesser one by the edges a[i] - b[i]."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    below = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[below], nodes[label[below]]


def forests(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components and b < a: within each task's parts of ``EDGES`` edges a node is a at most once."""

    def task(batches: Iterator[pa.RecordBatch]):
        def close(rows):
            table = pa.Table.from_batches(rows)
            a, b = least_labels(*(table.column(c).to_numpy() for c in ("a", "b")))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        rows, held = [], 0
        for batch in batches:
            rows.append(batch)
            held += batch.num_rows
            if held >= EDGES:
                yield from close(rows)
                rows, held = [], 0
        if held:
            yield from close(rows)

    return edges.select("a", "b").mapInArrow(task, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that has an edge to another; component is the smallest id it reaches.

    ``edges`` has bigint columns a and b; rows where one is NULL or both are equal say nothing. A round turns the edges of
    each task into forests, points each node to the least of its neighbours below, links the others of these to it, and
    lets every edge jump from its lower end to where that points. Rounds go on until all edges point to roots; their number
    grows with the logarithm of the longest path. After the forests a node stands above at most one edge for each part of
    a task, so no key is hot in the grouping; the jump is a join of single nodes with one row each, which adaptive
    execution can split. Each round is written to the shared folder and the one before it removed.
    """
    stars = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    before = None
    while True:
        own = forests(stars).groupBy("a").agg(F.collect_set("b").alias("below")).select("a", F.array_min("below").alias("m"), "below")
        linked = own.select(F.explode(F.expr("transform(below, x -> if(x = m, struct(a as a, m as b), struct(x as a, m as b)))")).alias("e"), F.expr("size(below) > 1").alias("open"))
        jump = own.select(F.col("a").alias("at"), F.col("m").alias("to"))
        jumped = linked.select("e.a", "e.b", "open").join(jump, F.col("b") == F.col("at"), "left")
        watch = Observation()
        rows = jumped.select("a", F.coalesce("to", "b").alias("b"), (F.col("open") | F.col("to").isNotNull()).alias("open"))
        after, path = landed(rows.observe(watch, F.max("open").alias("open")), "stars", with_path=True)
        if before:
            remove(edges.sparkSession, before)
        stars, before = after, path
        if not watch.get["open"]:
            roots = stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
