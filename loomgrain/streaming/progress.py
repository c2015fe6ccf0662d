"""Progress of streaming queries as rows: who runs, how far it is, and how it ended."""

from __future__ import annotations

import threading
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS = "query string, job string, name string, status string, batch long, rows long, total long, error string"


@dataclass(frozen=True)
class Progress:
    """One event: ``query`` stays over restarts, ``job`` is this run; ``total`` counts the rows of the run so far."""

    query: str
    job: str
    name: str | None
    status: str  # running, completed or failed
    batch: int
    rows: int
    total: int
    error: str | None = None


class ProgressListener(StreamingQueryListener):
    """Turns the events of streaming queries into ``Progress``, in order, and hands each to ``tell`` if that is given.

    A query that starts and each batch that ends are running; a query that ends by itself or is stopped is completed, one that an
    error ends failed. ``names`` restricts it to queries of these names. The last ``most`` events are kept.
    """

    def __init__(self, tell: Callable[[Progress], None] | None = None, names: tuple[str, ...] = (), most: int = 10_000) -> None:
        self.tell, self.names, self.most = tell, names, most
        self.events: list[Progress] = []
        self._known: dict[str, tuple[str | None, int]] = {}  # name and total by run
        self._changed = threading.Condition()

    def _add(self, job: str, query: str, status: str, batch: int, rows: int, error: str | None = None) -> None:
        name, total = self._known.get(job, (None, 0))
        if self.names and name not in self.names:
            return
        self._known[job] = (name, total + rows)
        event = Progress(query, job, name, status, batch, rows, total + rows, error)
        with self._changed:
            self.events.append(event)
            del self.events[: -self.most]
            self._changed.notify_all()
        if self.tell is not None:
            self.tell(event)

    def onQueryStarted(self, event) -> None:
        self._known[str(event.runId)] = (event.name, 0)
        self._add(str(event.runId), str(event.id), "running", -1, 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows or p.batchId == 0:
            self._add(str(p.runId), str(p.id), "running", p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        job = str(event.runId)
        self._add(job, str(event.id), "failed" if event.exception else "completed", -1, 0, event.exception)
        self._known.pop(job, None)

    def wait_for(self, query: StreamingQuery, seconds: float = 30) -> bool:
        """Until the end of ``query`` has been told: events come after the query itself has ended."""
        over = lambda: any(e.job == str(query.runId) and e.status != "running" for e in self.events)
        with self._changed:
            return self._changed.wait_for(over, seconds)

    def rows(self, spark: SparkSession) -> DataFrame:
        with self._changed:
            return spark.createDataFrame([tuple(asdict(e).values()) for e in self.events], PROGRESS)


@contextmanager
def listening(spark: SparkSession, listener: ProgressListener):
    """``listener`` hears the session's queries inside the block."""
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)
