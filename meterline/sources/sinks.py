"""Sinks: result lines, sorted CSV, topics and run logs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from meterline.functions.render import (
    NOT_AVAILABLE,
    STATUS_NOT_AVAILABLE,
    log_time,
    or_marker,
)
from meterline.schema import METRICS_COLUMNS, RESTART_COLUMNS, STATUS_COLUMNS
from meterline.sources.compaction import live_files


def line_sink(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    hourly_folders: bool = False,
    files: int | None = None,
    max_rows: int | None = None,
) -> DataStreamWriter:
    """Exactly-once text files of a ``value`` stream, committed per micro-batch.

    ``hourly_folders`` adds a folder per processing hour. ``files`` is the number of
    files per micro-batch (else one per shuffle partition with rows), and a file
    that reaches ``max_rows`` is followed by another.
    """
    out = lines.select("value")
    if files:
        out = out.repartition(files)
    if hourly_folders:
        out = out.withColumn("bucket", F.date_format(F.current_timestamp(), "yyyy-MM-dd--HH"))
    writer = (
        out.writeStream.format("text")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    return writer.partitionBy("bucket") if hourly_folders else writer


def sorted_name(path: str) -> str:
    """Default output name: ``trips.csv`` becomes ``trips.sorted.csv``."""
    base, extension = os.path.splitext(path)
    return f"{base}.sorted{extension}"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header per file; a sorted input gives files in sort order by name."""
    df.write.mode(mode).option("header", True).csv(path)


def write_raw_csv(lines: DataFrame, path: str, header: str, mode: str = "errorifexists") -> None:
    """Lines as they are, each file led by ``header``; nothing is quoted or escaped."""
    (
        lines.select(F.col("value").alias(header))
        .write.mode(mode)
        .option("header", True)
        .option("sep", "\u0001")
        .option("quote", "\u0000")
        .option("escape", "\u0000")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_topic(lines: DataFrame, servers: str, topic: str) -> None:
    """Lines to a topic without a key: at least once, acknowledged by the leader."""
    (
        lines.select("value")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "1")
        .option("kafka.retries", "3")
        .option("topic", topic)
        .save()
    )


def render_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics as log text: microsecond times, ``N/A`` for what is not known."""
    first, *others = METRICS_COLUMNS
    return metrics.select(
        log_time(F.col(first)).alias(first),
        *[or_marker(F.col(name)).alias(name) for name in others],
        *_extra(metrics, METRICS_COLUMNS),
    )


def render_status(status: DataFrame) -> DataFrame:
    when, state = STATUS_COLUMNS
    return status.select(
        log_time(F.col(when)).alias(when),
        or_marker(F.nullif(F.col(state), F.lit("")), STATUS_NOT_AVAILABLE).alias(state),
        *_extra(status, STATUS_COLUMNS),
    )


def render_restarts(restarts: DataFrame) -> DataFrame:
    when, seconds = RESTART_COLUMNS
    return restarts.select(
        log_time(F.col(when)).alias(when),
        F.format_string("%.4f", F.col(seconds)).alias(seconds),
        *_extra(restarts, RESTART_COLUMNS),
    )


def write_rolled(lines: DataFrame, path: str, max_bytes: int) -> None:
    """Write a ``value`` column as text files of at most ``max_bytes`` in place of what is there.

    Lines are dealt evenly over as many files as their bytes ask for, and a file ends
    before the longest line could take it over the limit. Only a line that is longer
    itself makes a longer file, alone. No line, no file.
    """
    rows = lines.select("value").persist()
    try:
        size = F.octet_length("value") + 1
        total, longest = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(1))).first()
        files = max(1, -(-total // max_bytes))
        if not total:
            return
        dealt = rows.repartition(files) if files > 1 else rows.coalesce(1)
        dealt.write.mode("overwrite").option("maxRecordsPerFile", max(1, max_bytes // longest)).text(path)
    finally:
        rows.unpersist()


def append_log(rows: DataFrame, path: str) -> None:
    """Append rendered rows to a run log; each written file carries the header."""
    rows.write.mode("append").option("header", True).csv(path)


def read_metrics(spark, path: str, extra: str = "") -> DataFrame:
    """A metrics log back as typed columns, ``N/A`` as null.

    ``extra`` declares the columns a log carries beyond the known ones ("run_id bigint,
    interval_s int"); a log whose header says otherwise is an error.
    """
    # Types of the metrics log columns, in file order.
    types = ("timestamp", "double", "double", "bigint", "string", "bigint", "string")
    schema = ", ".join(f"{name} {kind}" for name, kind in zip(METRICS_COLUMNS, types))
    return _read_log(spark, path, schema, extra, NOT_AVAILABLE)


def read_status(spark, path: str, extra: str = "") -> DataFrame:
    """A status log back as typed columns, see ``read_metrics``."""
    schema = "record_timestamp timestamp, job_status string"
    return _read_log(spark, path, schema, extra, STATUS_NOT_AVAILABLE)


def read_restarts(spark, path: str, extra: str = "") -> DataFrame:
    """A restart log back as typed columns, see ``read_metrics``."""
    when, seconds = RESTART_COLUMNS
    return _read_log(spark, path, f"{when} timestamp, {seconds} double", extra, NOT_AVAILABLE)


def _read_log(spark, path: str, schema: str, extra: str, missing: str) -> DataFrame:
    files = live_files(spark, path)
    return (
        spark.read.schema(f"{schema}, {extra}" if extra else schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("nullValue", missing)
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .csv(files or path)
    )


def _extra(df: DataFrame, known: tuple[str, ...]) -> list[str]:
    return [name for name in df.columns if name not in known]
