"""Counts of an import while it runs, gathered in the pass that does the work."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..session import written

METRICS = ("files", "failures", "scores", "tracks", "notes", "warnings")


def counts() -> list[Column]:
    """What is counted of parsed files: files, those that could not be read, and scores, tracks, notes and warnings of the others."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    notes = F.aggregate("tracks", F.lit(0), lambda n, t: n + F.size(t["notes"]))
    values = (F.count(F.lit(1)), F.count("error"), F.count_if(F.col("error").isNull()).cast("long"), whole(F.size("tracks")), whole(notes), whole(F.size("warnings")))
    return [v.alias(m) for v, m in zip(values, METRICS)]


def imported(parsed: DataFrame, name: str = "import") -> tuple[DataFrame, dict[str, int]]:
    """Parsed files as a table in the shared folder, and their counts.

    The files are read and parsed once: Spark counts the rows as they are
    written.  An import of no files has zeros.
    """
    seen = Observation(name)
    table = written(parsed.observe(seen, *counts()))
    return table, {m: seen.get.get(m) or 0 for m in METRICS}


class Progress(StreamingQueryListener):
    """Adds up what streams of parsed files have done: ``total`` by query name, ``batches`` as they come.

    Register it with ``spark.streams.addListener`` and observe the stream's
    rows under ``name`` with :func:`counts`.
    """

    def __init__(self, name: str = "import"):
        self.name, self.batches, self.total, self.failed = name, [], {}, {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self._lock:
            self.total.setdefault(event.name, dict.fromkeys(METRICS, 0))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress, row = event.progress, event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        with self._lock:
            now = {m: row[m] or 0 for m in METRICS}
            self.batches.append((progress.name, progress.batchId, now))
            total = self.total.setdefault(progress.name, dict.fromkeys(METRICS, 0))
            for m in METRICS:
                total[m] += now[m]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._lock:
            self.failed[str(event.runId)] = event.exception
