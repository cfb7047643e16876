"""Line sources: text files, CSV files with a header, message topics.

All of them but the CSV scan give one column, ``value STRING``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions.numbers import trim_control
from meterline.functions.times import raw_field_time
from meterline.schema import PICKUP_INDEX


def read_lines(
    spark: SparkSession, path: str | list[str], header: str | None = None, numbered: bool = False, by_place: bool = False
) -> DataFrame:
    """Trimmed, non-empty lines of text files without their header lines.

    With ``numbered``, ``file``, ``block`` and ``pos`` give every line a place in
    file order that no later shuffle changes: a split is read by one task from
    its start to its end, so ``pos`` grows along it. With ``by_place`` only the first line
    of a file can be its header; a line like one further down is data.
    """
    text = numbered_text(spark, path, by_place) if numbered else spark.read.text(path)
    return data_lines(text.select("*", "_metadata") if by_place and not numbered else text, header, by_place)


def numbered_text(spark: SparkSession, path: str | list[str], metadata: bool = False) -> DataFrame:
    """Lines of text files as they are, with ``file``, ``block`` and ``pos``."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        *(["_metadata"] if metadata else []),
    )


def stream_lines(
    spark: SparkSession,
    path: str,
    header: str | None = None,
    max_files: int | None = None,
    max_bytes: str | None = None,
    by_place: bool = False,
) -> DataFrame:
    """The same lines as a stream of files that keep arriving in a folder."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return data_lines(reader.load(path).select("value", "_metadata") if by_place else reader.load(path), header, by_place)


def data_lines(lines: DataFrame, header: str | None = None, by_place: bool = False) -> DataFrame:
    """Trim lines, then drop empty ones and headers.

    ``by_place`` needs lines as a text source gives them, with its ``_metadata``.
    """
    if by_place:
        return _without_first(lines, header).where("value <> ''")
    trimmed = lines.withColumn("value", trim_control(F.col("value")))
    return trimmed.where((F.col("value") != "") & ~is_header(F.col("value"), header))


def _without_first(lines: DataFrame, header: str | None) -> DataFrame:
    """Trimmed lines without those that are a file's first line and look like a header.

    A task reads the lines of a split one after the other, so a line is the first of its
    file where the split begins at byte 0 and the line before it is of another split.
    Whether it looks like a header is worked out in built-in expressions.
    """
    names = [name for name in lines.columns if name not in ("value", "_metadata")]
    split = (F.xxhash64("_metadata.file_path"), F.col("_metadata.file_block_start"))
    trimmed = trim_control(F.col("value"))
    marked = lines.select(split[0].alias("_file"), split[1].alias("_block"), is_header(trimmed, header).alias("_like"), trimmed.alias("value"), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.r_[(file[0], block[0]) != last, (file[1:] != file[:-1]) | (block[1:] != block[:-1])]
            last = (file[-1], block[-1])
            like = batch.column(2).to_numpy(zero_copy_only=False)
            kept = ~(first & (block == 0) & like.astype(bool))
            yield batch.select(range(3, batch.num_columns)).filter(pa.array(kept))

    fields = {field.name: field.dataType.simpleString() for field in marked.schema}
    return marked.mapInArrow(run, ", ".join(f"`{name}` {fields[name]}" for name in ("value", *names)))


def is_header(line: Column, header: str | None = None) -> Column:
    """True for the given header line or, if none is given, for one that looks so.

    A header names a pickup time column, holds no time where one is due and no number
    at all. Data lines hold numbers, so a bad one is not taken for a header, whatever
    its texts say, and a file that starts with data loses no row.
    """
    if header is not None:
        return line == F.lit(header.strip())
    names = F.lower(line)
    fields = F.split(line, ",")
    untimed = raw_field_time(F.get(fields, F.lit(PICKUP_INDEX))).isNull()
    unnumbered = ~F.exists(fields, lambda field: field.try_cast("double").isNotNull())
    return names.contains("pickup") & names.contains("datetime") & untimed & unnumbered


def read_csv_strings(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Quoted CSV with a header; every column stays a string.

    ``columns`` is the declared header; a file whose header differs is an error
    rather than a silent shift of columns.
    """
    schema = ", ".join(f"`{name}` string" for name in columns)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
    )


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file (reads its first line only)."""
    return spark.read.option("header", True).csv(path).columns


def topic_options(servers: str, topic: str) -> dict[str, str]:
    """Read a topic from its beginning; progress is kept by the checkpoint."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
    }


def stream_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Lines of a message topic (needs the Kafka connector on the class path)."""
    raw = spark.readStream.format("kafka").options(**topic_options(servers, topic)).load()
    return raw.select(F.col("value").cast("string").alias("value"))


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """What a topic holds now, with the columns that order it."""
    raw = spark.read.format("kafka").options(**topic_options(servers, topic)).load()
    return raw.select(F.col("value").cast("string").alias("value"), "partition", "offset")


def peek(lines: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` lines in a total order (a top-k, never a full sort)."""
    return lines.orderBy(*order).limit(n)
