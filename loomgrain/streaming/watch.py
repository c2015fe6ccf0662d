"""File watch: events are debounced into bursts, and each burst triggers incremental indexing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loomgrain.streaming.folder import folder_changes

#: Paths that contain one of these never trigger.
QUIET = (".git", "node_modules", "target")


def is_quiet(path: Column, marks: tuple[str, ...] = QUIET) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(path, F.lit(m))
    return out


def debounced(events: DataFrame, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """(workspaceId, start, end, events): bursts of ``events`` (workspaceId, path, ts) with no pause of ``gap`` inside.

    On a stream the watermark bounds the state: a burst is kept until ``late`` after its end.
    """
    kept = events.where(~is_quiet(F.col("path")))
    if kept.isStreaming:
        kept = kept.withWatermark("ts", late)
    bursts = kept.groupBy("workspaceId", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return bursts.select("workspaceId", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def watch(events: DataFrame, reindex: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "2 seconds", late: str = "10 minutes") -> StreamingQuery:
    """Start indexing the workspaces of each batch of bursts.

    ``reindex`` gets the workspaces and the batch number; a batch may be repeated
    after a failure, so it must give the same result when it runs twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        reindex(batch.select("workspaceId").distinct(), number)

    return debounced(events, gap, late).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


BURST = "workspaceId string, start timestamp, end timestamp, events long"
_STORE = "spark.sql.streaming.stateStore.providerClass"


class Debounce(StatefulProcessor):
    """One open burst a workspace; each event puts off its end, and a processing-time timer ends it."""

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "start timestamp, end timestamp, events long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        start, end, events, due = self.burst.get() if self.burst.exists() else (None, None, 0, None)
        for r in rows:
            start, end, events = min(start or r.ts, r.ts), max(end or r.ts, r.ts), events + 1
        if due is not None:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.gap_ms
        self.handle.registerTimer(due)
        self.burst.update((start, end, events, due))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.burst.exists():
            start, end, events, due = self.burst.get()
            if due <= expiredTimerInfo.getExpiryTimeInMs():
                self.burst.clear()
                yield Row(workspaceId=key[0], start=start, end=end, events=events)

    def close(self) -> None:
        pass


def bursts(events: DataFrame, gap_ms: int = 2000) -> DataFrame:
    """(workspaceId, start, end, events) of each burst of a stream, ``gap_ms`` of processing time after its last event, without any newer one.

    The state is one row a workspace with an open burst. Needs the RocksDB state store.
    """
    kept = events.where(~is_quiet(F.col("path")) & F.col("workspaceId").isNotNull() & F.col("ts").isNotNull()).select("workspaceId", "ts")
    return kept.groupBy("workspaceId").transformWithState(Debounce(gap_ms), BURST, "append", "processingTime")


def watch_folder(spark: SparkSession, folder: str, reindex: Callable[[DataFrame, int], None], checkpoint: str, patterns: tuple[str, ...] = (), gap_ms: int = 2000, poll: str = "500 milliseconds") -> StreamingQuery:
    """Watch ``folder`` until the query is stopped: polls it, and calls ``reindex`` with the workspaces of bursts that have ended.

    Start it again with the same ``checkpoint`` and it tells of what changed meanwhile.
    """
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    changes = folder_changes(spark, folder, f"{checkpoint.rstrip('/')}/listings", patterns)

    def each(batch: DataFrame, number: int) -> None:
        ended = batch.select("workspaceId").distinct()
        if not ended.isEmpty():
            reindex(ended, number)

    return bursts(changes, gap_ms).writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint.rstrip('/')}/query").outputMode("append").trigger(processingTime=poll).start()
