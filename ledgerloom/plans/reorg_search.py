"""The reorg check from the tip down: a chain whose tip agrees reads one block of either side.

The decisions are those of :func:`operators.reorg.detect`, which compares whole histories. Here a first job compares the
tips of all chains. Chains that differ are searched downwards in stretches of ``first`` blocks, then twice, four times as
many and so on, all open chains in one job, until a stretch holds an equal block. No more than three times the depth of the
fork is read, and ``first`` blocks. What reaches the driver is one row per chain and job.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import reorg as R

# Chains with the lowest and the highest block wanted of each.
Spans = dict[int, tuple[int, int]]
Reader = Callable[[Spans], DataFrame]
_DETECTED = "chain_id bigint, tip bigint, status string, from_block bigint, last_processed_block bigint"


def rows_within(blocks: DataFrame, bucket_width: int | None, spans: Spans) -> DataFrame:
    """Rows of the wanted blocks; with the width of a table's ``block_bucket`` folders, others are not opened."""

    def any_chain(column: str, width: int) -> Column:
        return reduce(Column.__or__, [
            (F.col("chain_id") == c) & F.col(column).between(low // width, high // width) for c, (low, high) in sorted(spans.items())
        ])

    found = blocks.where(any_chain("block_number", 1))
    return found.where(any_chain("block_bucket", bucket_width)) if bucket_width else found


def reader(blocks: DataFrame, bucket_width: int | None = None) -> Reader:
    return partial(rows_within, blocks, bucket_width)


def _look(stored: Reader, node: Reader, spans: Spans) -> dict[int, tuple]:
    """For each chain with stored blocks in its span: whether the node has all of them, the highest equal and missing ones."""
    compared = R.compare_hashes(stored(spans), node(spans))
    found = compared.groupBy("chain_id").agg(
        F.max(F.when(F.col("same"), F.col("block_number"))).alias("equal"),
        F.max(F.when(F.col("node_hash").isNull(), F.col("block_number"))).alias("missing"),
        F.max(F.col("node_hash").isNotNull()).alias("answered"),
    )
    return {r.chain_id: (r.equal, r.missing, r.answered) for r in found.collect()}


def detect_from_tip(stored: Reader, node: Reader, state: DataFrame, first: int = 64) -> DataFrame:
    """Decision per chain with a watermark, with the columns and the meaning of ``reorg.detect``. Runs jobs.

    ``stored`` and ``node`` give the blocks (chain_id, block_number, block_hash) of spans, see :func:`reader`. Equal rows
    change nothing; hashes are compared without case. A chain whose watermark is NULL or that has no stored tip is unchecked.
    """
    tips = {r.chain_id: r.last_processed_block for r in state.select("chain_id", "last_processed_block").collect()}
    spans = {c: (tip, tip) for c, tip in tips.items() if tip is not None}
    at_tip = _look(stored, node, spans) if spans else {}
    status: dict[int, str] = {}
    forks: dict[int, int | None] = {}
    for c, tip in tips.items():
        if c not in at_tip:
            status[c] = "unchecked"
        elif not at_tip[c][2]:
            status[c] = "unavailable"
        elif at_tip[c][0] is not None:
            status[c] = "ok"
    top = {c: tip - 1 for c, tip in tips.items() if c not in status}
    size = first
    while top:
        spans = {c: (max(high - size + 1, 0), high) for c, high in top.items() if high >= 0}
        found = _look(stored, node, spans) if spans else {}
        for c, high in list(top.items()):
            equal, missing, _ = found.get(c, (None, None, None))
            if missing is not None and (equal is None or missing > equal):
                status[c] = "unavailable"
            elif equal is not None or high < size:
                status[c], forks[c] = "reorg", equal
            else:
                top[c] = high - size
                continue
            del top[c]
        size *= 2
    rows = []
    for c, tip in sorted(tips.items()):
        fork, reorg = forks.get(c), status[c] == "reorg"
        rows.append((c, tip, status[c], (0 if fork is None else fork + 1) if reorg else None, fork if reorg else tip))
    return state.sparkSession.createDataFrame(rows, _DETECTED)
