"""The hourly income job as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from meterline.operators.hourly import DEFAULT_WIDTH, hourly_income, hourly_lines
from meterline.operators.parse import counted_trips
from meterline.session import use_rocksdb, prepare
from meterline.sources.sinks import line_sink, write_rolled

# Fixed values.
DEFAULT_DELAY = "1 minute"
DEFAULT_INTERVAL = "30 seconds"
DEFAULT_ROLL_BYTES = 128 << 20


def stream_income(
    lines: DataFrame,
    bad: str = "failfast",
    width: str = DEFAULT_WIDTH,
    delay: str = DEFAULT_DELAY,
    exact_cents: bool = False,
) -> DataFrame:
    """Windows of a line stream, each given out once, when ``delay`` has passed its end.

    The delay counts from the latest pickup seen in earlier micro-batches. Later
    rows of a closed window are dropped; rows are never dropped while any window
    they belong to is open.
    """
    trips = counted_trips(lines, bad).withWatermark("pickup_ts", delay)
    return hourly_income(trips, width, exact_cents)


def stream_sources(
    sources: Sequence[DataFrame],
    bad: str = "failfast",
    width: str = DEFAULT_WIDTH,
    delay: str = DEFAULT_DELAY,
    exact_cents: bool = False,
) -> DataFrame:
    """Windows over several line streams, each with a watermark of its own.

    A window closes when ``delay`` has passed its end in every source, so a source that
    lags behind the others loses no row. A source without any row yet holds all windows
    open. The policy is kept in the checkpoint from the first start on.
    """
    first = sources[0].sparkSession
    first.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    marked = [counted_trips(lines, bad).withWatermark("pickup_ts", delay) for lines in sources]
    trips = marked[0]
    for more in marked[1:]:
        trips = trips.unionByName(more)
    return hourly_income(trips, width, exact_cents)


def drained(query: StreamingQuery) -> StreamingQuery:
    """Wait until a query under any trigger has taken all there is, then stop it.

    What its last batch made due (closed windows) is given out before.
    """
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def paced(writer: DataStreamWriter, interval: str | None = DEFAULT_INTERVAL) -> DataStreamWriter:
    """One micro-batch, hence one checkpoint, per interval; None drains what is there."""
    if interval is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval)


def run_hourly_lines(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = DEFAULT_INTERVAL,
    hourly_folders: bool = False,
    files: int | None = None,
    max_rows: int | None = None,
    **options,
) -> StreamingQuery:
    """Start the job with the text sink. Started again, it goes on from ``checkpoint``.

    State sits in RocksDB, one (count, sum) per open window and zone. The number
    of shuffle partitions is fixed by the first start.
    """
    _ready(lines)
    out = hourly_lines(stream_income(lines, **options))
    return paced(line_sink(out, path, checkpoint, hourly_folders, files, max_rows), interval).start()


def run_rolled_lines(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = DEFAULT_INTERVAL,
    max_bytes: int = DEFAULT_ROLL_BYTES,
    **options,
) -> StreamingQuery:
    """Result lines in files that are rolled by bytes and, with the interval, by time.

    Each micro-batch has a folder of its own under ``path``, so no file is longer open
    than an interval. A batch cut short is written again in place, so each line is there
    exactly once.
    """
    _ready(lines)

    def write(batch: DataFrame, number: int) -> None:
        write_rolled(batch, f"{path}/batch={number}", max_bytes)

    writer = hourly_lines(stream_income(lines, **options)).writeStream.foreachBatch(write)
    return paced(writer.option("checkpointLocation", checkpoint), interval).start()


def run_hourly_table(
    lines: DataFrame | Sequence[DataFrame],
    path: str,
    checkpoint: str,
    interval: str | None = DEFAULT_INTERVAL,
    **options,
) -> StreamingQuery:
    """The same with typed results in Parquet; several streams go by ``stream_sources``."""
    sources = [lines] if isinstance(lines, DataFrame) else list(lines)
    _ready(sources[0])
    windows = stream_income(sources[0], **options) if len(sources) == 1 else stream_sources(sources, **options)
    writer = (
        windows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return paced(writer, interval).start()


def _ready(lines: DataFrame) -> None:
    use_rocksdb(prepare(lines.sparkSession))
