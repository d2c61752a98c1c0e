"""Reorganisations: comparing hashes, finding the fork, removing what was orphaned.

A reorg marker (chain_id, seq, from_block) orphans every row of its chain that arrived
before it and lies at or above ``from_block``. Nothing is deleted from the changelog;
survivors are computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import schemas as S

# Blocks of one bucket when markers are matched: the most steps a row is compared with.
STEP_WIDTH = 64


def markers(changelog: DataFrame) -> DataFrame:
    return changelog.where(F.col("kind") == S.REORG).select("chain_id", "seq", "from_block")


def invalidate(rows: DataFrame, reorgs: DataFrame, width: int = STEP_WIDTH) -> DataFrame:
    """Rows (chain_id, block_number, seq, ...) no later marker orphans, for any numeric ``seq``.

    A row is orphaned if the latest marker at or below its block came after it. Markers act
    through their block bucket: markers of lower buckets by one number, the latest of them,
    and those of the row's own bucket by their steps, of which there are ``width`` at most.
    Only buckets with a row older than such a marker are joined, usually a few near forks;
    whether that side is broadcast, and how a busy bucket is split, is left to the runtime
    plan. The rows are read twice, the first time three narrow columns of them.
    """
    bucket = F.expr(f"block_number div {width}").alias("_bucket")
    marked = reorgs.select(
        "chain_id", F.expr(f"from_block div {width}").alias("_bucket"), "from_block", "seq"
    )
    steps = (
        marked.groupBy("chain_id", "_bucket", "from_block")
        .agg(F.max("seq").alias("seq"))
        .groupBy("chain_id", "_bucket")
        .agg(F.collect_list(F.struct("from_block", "seq")).alias("_steps"), F.max("seq").alias("_latest"))
    )
    # The window is over the buckets of a chain: its height divided by the width.
    earlier = (
        Window.partitionBy("chain_id")
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    acting = (
        rows.select("chain_id", bucket, "seq")
        .groupBy("chain_id", "_bucket")
        .agg(F.min("seq").alias("_oldest"))
        .join(steps, ["chain_id", "_bucket"], "full")
        .withColumn("_below", F.max("_latest").over(earlier))
        .where(F.greatest("_below", "_latest") > F.col("_oldest"))
        .select("chain_id", "_bucket", "_below", "_steps")
    )
    own = F.exists("_steps", lambda m: (m["from_block"] <= F.col("block_number")) & (m["seq"] > F.col("seq")))
    orphaned = F.coalesce(F.col("_below") > F.col("seq"), F.lit(False)) | F.coalesce(own, F.lit(False))
    return (
        rows.withColumn("_bucket", F.expr(f"block_number div {width}"))
        .join(acting, ["chain_id", "_bucket"], "left")
        .where(~orphaned)
        .select(*rows.columns)
    )


# --- comparing with the node ---------------------------------------------------------------


def compare_hashes(stored: DataFrame, canonical: DataFrame) -> DataFrame:
    """Stored blocks beside the node's hash. ``same`` is NULL where the node has no block."""
    node = canonical.select("chain_id", "block_number", F.col("block_hash").alias("node_hash"))
    return (
        stored.select("chain_id", "block_number", "block_hash")
        .join(node, S.BLOCK_KEY, "left")
        .withColumn("same", F.lower("block_hash") == F.lower("node_hash"))
    )


def fork_points(compared: DataFrame, state: DataFrame) -> DataFrame:
    """Per chain with a watermark: what the comparison below and at the tip says.

    The tip is the watermark block. One aggregate replaces the walk from the tip down:
    the fork is the highest equal block below the tip, and a block the node lacks only
    matters above that fork.
    """
    tips = state.select("chain_id", F.col("last_processed_block").alias("tip"))
    at_tip = F.col("block_number") == F.col("tip")
    below = F.col("block_number") < F.col("tip")
    return (
        compared.join(tips, "chain_id")
        .where(F.col("block_number") <= F.col("tip"))
        .groupBy("chain_id", "tip")
        .agg(
            # Flags instead of hashes keep the buffers fixed-width: a hash aggregate, no sort.
            F.max(at_tip).alias("stored_tip"),
            F.max(at_tip & F.col("node_hash").isNotNull()).alias("node_tip"),
            F.max(F.when(at_tip, F.col("same"))).alias("tip_same"),
            F.max(F.when(below & F.col("same"), F.col("block_number"))).alias("fork_block"),
            F.max(F.when(below & F.col("node_hash").isNull(), F.col("block_number")))
            .alias("highest_missing"),
        )
    )


def detect(stored: DataFrame, canonical: DataFrame, state: DataFrame) -> DataFrame:
    """Decision per chain: ``status`` unchecked | unavailable | ok | reorg.

    On a reorg ``from_block`` is the first orphaned block and ``last_processed_block`` the
    new watermark; no common block means from 0 and no watermark. A chain with a watermark and
    no stored block up to it is unchecked.
    """
    missing_above = F.col("highest_missing") > F.coalesce(F.col("fork_block"), F.lit(-1))
    status = (
        F.when(~F.coalesce("stored_tip", F.lit(False)), "unchecked")
        .when(~F.col("node_tip"), "unavailable")
        .when(F.col("tip_same"), "ok")
        .when(missing_above, "unavailable")
        .otherwise("reorg")
    )
    tips = state.select("chain_id", F.col("last_processed_block").alias("tip"))
    known = fork_points(compare_hashes(stored, canonical), state)
    forks = tips.join(known, ["chain_id", "tip"], "left").withColumn("status", status)
    is_reorg = F.col("status") == "reorg"
    return forks.select(
        "chain_id",
        "tip",
        "status",
        F.when(is_reorg, F.coalesce(F.col("fork_block") + 1, F.lit(0))).alias("from_block"),
        F.when(is_reorg, F.col("fork_block")).otherwise(F.col("tip")).alias("last_processed_block"),
    )


def reorg_messages(detected: DataFrame) -> DataFrame:
    """Marker rows to publish, ready for ``messages.encode_reorgs``."""
    return detected.where(F.col("status") == "reorg").select(
        "chain_id", "from_block", F.lit("reorg").alias("reason")
    )


# --- watermark -------------------------------------------------------------------------------


def watermarks(changelog: DataFrame) -> DataFrame:
    """Progress per chain: after its last marker, the highest block or ``from_block - 1``.

    A chain whose last marker is from block 0 with nothing after it has no row. The last
    marker is one row per chain, joined back before one partial-aggregated group-by.
    """
    last = markers(changelog).groupBy("chain_id").agg(
        F.max("seq").alias("_marker"), F.max_by("from_block", "seq").alias("_from")
    )
    moves = changelog.where(~F.col("kind").isin(S.REORG, S.DEAD_LETTER)).select(
        "chain_id", "seq", "block_number"
    )
    after = moves.join(last, "chain_id", "left").where(
        F.col("_marker").isNull() | (F.col("seq") > F.col("_marker"))
    )
    rewound = last.where(F.col("_from") > 0).select(
        "chain_id", (F.col("_from") - 1).alias("block_number")
    )
    return (
        after.select("chain_id", "block_number")
        .unionByName(rewound)
        .groupBy("chain_id")
        .agg(F.max("block_number").alias("last_processed_block"))
    )
