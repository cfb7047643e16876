"""Collecting run logs of streaming queries."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from meterline.operators.runlog import progress_metrics

STATUS_DDL = "run_id string, ts timestamp, seq bigint, status string"


def recent_metrics(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Metrics rows of the progress reports Spark still holds for a query."""
    rows = [(report.json,) for report in query.recentProgress]
    return progress_metrics(spark.createDataFrame(rows, "value string"))


class ProgressRecorder(StreamingQueryListener):
    """Appends progress reports and status changes of all queries to text tables.

    Reports are one small row per micro-batch, written as they come, so a lost driver
    loses none that it was told of. ``every`` writes them in groups instead. The tables
    hold the raw JSON under ``progress`` and (run_id, ts, seq, status) rows under
    ``status``; run_id is the id that a query keeps over restarts from its checkpoint.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 1):
        self._spark = spark
        self._path = path
        self._every = every
        self._reports: list[tuple[str]] = []

    def onQueryStarted(self, event) -> None:
        self._note(event, "RUNNING")

    def onQueryProgress(self, event) -> None:
        self._reports.append((event.progress.json,))
        if len(self._reports) >= self._every:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.flush()
        self._note(event, "FINISHED" if event.exception is None else "RESTARTING")

    def flush(self) -> None:
        reports, self._reports = self._reports, []
        if reports:
            frame = self._spark.createDataFrame(reports, "value string")
            frame.coalesce(1).write.mode("append").text(f"{self._path}/progress")

    def _note(self, event, status: str) -> None:
        # Nanoseconds of the clock order events of one instant, and those of later drivers.
        row = (str(event.id), datetime.now(timezone.utc), time.time_ns(), status)
        frame = self._spark.createDataFrame([row], STATUS_DDL)
        frame.coalesce(1).write.mode("append").parquet(f"{self._path}/status")

    def metrics(self) -> DataFrame:
        return progress_metrics(self._spark.read.text(f"{self._path}/progress"))

    def samples(self) -> DataFrame:
        """Status samples as ``status_changes`` and ``restart_episodes`` take them."""
        return self._spark.read.schema(STATUS_DDL).parquet(f"{self._path}/status")
