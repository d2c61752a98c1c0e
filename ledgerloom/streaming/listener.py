"""Counters that only the running query knows: batches, rows and failures."""

from __future__ import annotations

from threading import Lock

from pyspark.sql.streaming import StreamingQueryListener


class ProgressCounters(StreamingQueryListener):
    """Feeds the metrics query: a failure while storing a batch is a commit error, any other a fetch error."""

    def __init__(self) -> None:
        self._lock = Lock()
        self.batches = 0
        self.rows = 0
        self.fetch_errors = 0
        self.commit_errors = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            self.batches += 1
            self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if not event.exception:
            return
        in_batch = (event.errorClassOnException or "").startswith("FOREACH_BATCH")
        with self._lock:
            if in_batch:
                self.commit_errors += 1
            else:
                self.fetch_errors += 1
