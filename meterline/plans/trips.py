"""Jobs over trip files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterline.operators import hourly, parse, prep, replay
from meterline.sources import lines as sources
from meterline.sources import sinks

_FILE_ORDER = ["file", "block", "pos"]


def prepare_file(
    spark: SparkSession, path: str, out: str | None = None, bound: str = prep.DEFAULT_BOUND
) -> str:
    """Clean a trip CSV and sort it by dropoff; returns where it went."""
    header = sources.csv_header(spark, path)
    line = ",".join(header)
    lines = sources.read_lines(spark, path, header=line, numbered=True)
    target = out or sinks.sorted_name(path)
    prep.sorted_lines(prep.keyed_lines(lines, header), line, _FILE_ORDER, bound).write.text(target)
    return target


def stage_file(
    spark: SparkSession, path: str, out: str, rate_s: int = replay.DEFAULT_RATE_S, form: str = "parquet"
) -> None:
    """Stage the lines of a trip file for replay, one folder per step."""
    lines = sources.read_lines(spark, path, numbered=True, by_place=True)
    replay.stage_ticks(replay.timed_lines(lines), out, _FILE_ORDER, rate_s, form=form)


def hourly_batch(
    spark: SparkSession, path: str, bad: str = "failfast", exact_cents: bool = False
) -> DataFrame:
    """Hourly income of trip files."""
    trips = parse.counted_trips(sources.read_lines(spark, path), bad)
    return hourly.hourly_income(trips, exact_cents=exact_cents)
