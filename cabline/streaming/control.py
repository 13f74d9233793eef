"""Run-time control of streaming queries (T7, T8): by polls, or by the events that Spark sends."""

from __future__ import annotations

import threading
import time
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from cabline.schema import IDLE_POLL_SECONDS, IDLE_POLLS


def input_rows(q: StreamingQuery) -> int:
    """Rows read by the last completed trigger (0 before the first)."""
    p = q.lastProgress or {}
    return int(p.get("numInputRows", 0) or 0)


def stop_when_idle(
    queries: list[StreamingQuery],
    watched: list[StreamingQuery] | None = None,
    polls: int = IDLE_POLLS,
    every: float = IDLE_POLL_SECONDS,
    sleep=time.sleep,
    max_polls: int | None = None,
) -> int:
    """Poll every ``every`` seconds; after ``polls`` consecutive polls in
    which no watched query read input, or when any query has stopped, stop
    all of them. Returns the number of polls made."""
    watched = watched or queries
    idle, n = 0, 0
    try:
        while all(q.isActive for q in queries):
            n += 1
            if all(input_rows(q) == 0 for q in watched):
                idle += 1
                if idle >= polls:
                    break
            else:
                idle = 0
            if max_polls is not None and n >= max_polls:
                break
            sleep(every)
    finally:
        for q in queries:
            q.stop()
    return n


PROGRESS_COLUMNS = "run_id string, name string, batch_id long, at string, input_rows long, seconds double"
PROGRESS_KEPT = 10_000  # triggers


class IdleWatch(StreamingQueryListener):
    """Hears of every trigger: keeps the progress of the watched runs, and sets
    ``done`` once each of them has been idle ``idles`` events in a row or any
    has ended. Spark sends an idle event every
    ``spark.sql.streaming.noDataProgressEventInterval`` (10 s by default)."""

    def __init__(self, run_ids: list[str], idles: int = IDLE_POLLS) -> None:
        self.idles, self.quiet = idles, dict.fromkeys(run_ids, 0)
        self.progress: deque = deque(maxlen=PROGRESS_KEPT)
        self.done = threading.Event()

    def _heard(self, run_id: str, rows: int) -> None:
        if run_id in self.quiet:
            self.quiet[run_id] = 0 if rows else self.quiet[run_id] + 1
            if min(self.quiet.values()) >= self.idles:
                self.done.set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) in self.quiet:
            self.progress.append((str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, p.batchDuration / 1000))
        self._heard(str(p.runId), p.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._heard(str(event.runId), 0)

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.quiet:
            self.done.set()

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per trigger of a watched query, the last ``PROGRESS_KEPT`` of them."""
        return spark.createDataFrame(list(self.progress), PROGRESS_COLUMNS)


def stop_on_idle(
    spark: SparkSession,
    queries: list[StreamingQuery],
    watched: list[StreamingQuery] | None = None,
    idles: int = IDLE_POLLS,
    timeout: float | None = None,
) -> IdleWatch:
    """T7 by events: all queries are stopped when every watched one has been
    idle ``idles`` events in a row, when one has ended, or after ``timeout``
    seconds. One that is still busy keeps the others running."""
    watch = IdleWatch([str(q.runId) for q in watched or queries], idles)
    spark.streams.addListener(watch)
    try:
        if all(q.isActive for q in queries):  # one that ended before the listener was there sends nothing more
            watch.done.wait(timeout)
    finally:
        for q in queries:
            q.stop()
        spark.streams.removeListener(watch)
    return watch
