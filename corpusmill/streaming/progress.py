"""Progress of a streaming query as events of the run log: one when it starts, one a micro-batch, one when it ends or fails."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from corpusmill.plans.pipeline import Progress


class StreamProgress(StreamingQueryListener):
    """Turns the notices of one session's streaming queries into events of a Progress: initialize, store (a batch with rows), complete.

    Spark calls a listener from a thread of its own, after the batch; `wait` blocks until a query has ended and all its notices are in.
    """

    def __init__(self, progress: Progress) -> None:
        self.progress, self.ended, self.lock = progress, {}, threading.Lock()
        self.session: SparkSession | None = None

    def attach(self, spark: SparkSession) -> None:
        if self.session is None:
            self.session = spark
            spark.streams.addListener(self)

    def detach(self) -> None:
        if self.session is not None:
            self.session.streams.removeListener(self)
            self.session = None

    def _over(self, run: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run, threading.Event())

    def wait(self, run: str, seconds: float = 30.0) -> bool:
        """Whether the notices of a run (a query's runId) are complete within that time."""
        return self._over(str(run)).wait(seconds)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.progress.emit("initialize", "stream started", run=event.runId)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows:
            self.progress.emit("store", f"batch {p.batchId}", run=p.runId, batch=p.batchId, rows=p.numInputRows, milliseconds=p.batchDuration)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        failed = event.exception
        self.progress.emit("cancel" if failed else "complete", f"stream failed: {failed[:300]}" if failed else "stream ended", run=event.runId)
        self._over(str(event.runId)).set()
