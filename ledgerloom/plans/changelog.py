"""Tables as views over the changelog.

Upserted tables take the last writer first and drop it when a later marker orphans its
block; otherwise an older version of a moved transaction would come back. Logs are
invalidated first and then keep the earliest survivor; otherwise a log delivered again
after a reorg would stay lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.operators import balances as B
from ledgerloom.operators import messages as M
from ledgerloom.operators import reorg as R
from ledgerloom.operators import writers as W


def live_logs(changelog: DataFrame, *extra: str) -> DataFrame:
    rows = W.normalise_logs(M.to_logs(changelog, "seq", *extra))
    return W.first_writer(R.invalidate(rows, R.markers(changelog)), S.LOG_KEY)


def logs(changelog: DataFrame) -> DataFrame:
    return live_logs(changelog).drop("seq")


def blocks(changelog: DataFrame) -> DataFrame:
    latest = W.upsert_blocks(M.to_blocks(changelog, "seq"))
    return R.invalidate(latest, R.markers(changelog)).drop("seq")


def transactions(changelog: DataFrame) -> DataFrame:
    latest = W.upsert_transactions(M.to_transactions(changelog, "seq"))
    return R.invalidate(latest, R.markers(changelog)).drop("seq")


def receipts(changelog: DataFrame) -> DataFrame:
    latest = W.upsert_receipts(M.to_receipts(changelog, "seq"))
    return R.invalidate(latest, R.markers(changelog)).drop("seq")


def balances(
    changelog: DataFrame, event_id: str, skip_removed: bool = False, include_orphaned: bool = False
) -> DataFrame:
    """Balances of the surviving logs; ``include_orphaned`` keeps credits a reorg removed."""
    if include_orphaned:
        rows = W.first_writer(W.normalise_logs(M.to_logs(changelog, "seq")), S.LOG_KEY)
    else:
        rows = live_logs(changelog)
    return B.balances(rows, event_id, skip_removed)


def state(changelog: DataFrame) -> DataFrame:
    return R.watermarks(changelog)


def replayed(changelog: DataFrame, chain_id: int, from_block: int) -> DataFrame:
    """Messages that arrive again after the watermark of a chain is set to ``from_block - 1``."""
    return changelog.where(
        (F.col("chain_id") == chain_id)
        & (F.col("block_number") >= from_block)
        & ~F.col("kind").isin(S.REORG, S.DEAD_LETTER)
    )
