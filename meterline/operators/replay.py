"""Time-scaled replay: which step of the replay sends which line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.once import once
from meterline.functions.times import line_pickup_time
from meterline.operators.ordered import global_rank
from meterline.session import checkpoint_dir, shuffle_width

# Fixed value: two hours of data per step.
DEFAULT_RATE_S = 7200

_MICROS = 1_000_000
_FILL_BLOCK = 4096


def timed_lines(lines: DataFrame, index: int = 1, line: str = "value") -> DataFrame:
    """Lines with a readable pickup time, added as ``pickup``; the others go."""
    timed = lines.select("*", once(line_pickup_time(F.col(line), index), "pickup"))
    return timed.where(F.col("pickup").isNotNull())


def with_ticks(timed: DataFrame, rate_s: int = DEFAULT_RATE_S) -> DataFrame:
    """Add ``tick``: step k sends times in (start + k r, start + (k + 1) r].

    Step 0 also sends the start itself. Only the earliest time is needed (a
    scalar subquery), no sort.
    """
    start = timed.agg(F.min(F.unix_micros("pickup")).alias("start")).scalar()
    return timed.withColumn("tick", _tick(F.unix_micros("pickup") - start, rate_s))


def _tick(since: Column, rate_s: int) -> Column:
    behind = F.greatest(since - 1, F.lit(0))
    step = F.lit(rate_s * _MICROS)
    return ((behind - behind % step) / step).cast("bigint")


def tick_counts(timed: DataFrame, rate_s: int = DEFAULT_RATE_S) -> DataFrame:
    """Lines per step with the step's time span; empty steps count 0.

    Lines are read once, into counts per pickup time: times have whole seconds, so
    there are no more of them than seconds in the data, however many lines there
    are. The counts are checkpointed because three things are derived from them.
    """
    checkpoint_dir(timed.sparkSession)
    at_time = timed.groupBy("pickup").agg(F.count("*").alias("lines")).checkpoint()
    counts = with_ticks(at_time, rate_s).groupBy("tick").agg(F.sum("lines").alias("lines_sent"))
    span = at_time.agg(
        F.min(F.unix_micros("pickup")).alias("first"),
        F.max(F.unix_micros("pickup")).alias("last"),
    ).where(F.col("first").isNotNull())
    last_tick = _tick(F.col("last") - F.col("first"), rate_s)
    # Steps are made in two levels so that a long replay does not unfold in one task.
    blocks = span.select(
        "first",
        last_tick.alias("last_tick"),
    ).select(
        "first",
        "last_tick",
        F.explode(F.expr(f"sequence(0L, last_tick div {_FILL_BLOCK})")).alias("block"),
    )
    blocks = blocks.repartition(shuffle_width(timed.sparkSession), "block")
    lowest = F.col("block") * _FILL_BLOCK
    ticks = blocks.select(
        "first",
        F.explode(
            F.sequence(lowest, F.least(lowest + (_FILL_BLOCK - 1), F.col("last_tick")))
        ).alias("tick"),
    )
    begins = F.col("first") + F.col("tick") * F.lit(rate_s * _MICROS)
    return ticks.join(counts, "tick", "left").select(
        "tick",
        F.timestamp_micros(begins).alias("sim_start"),
        F.timestamp_micros(begins + F.lit(rate_s * _MICROS)).alias("sim_end"),
        F.coalesce("lines_sent", F.lit(0)).alias("lines_sent"),
    )


def replay_order(
    timed: DataFrame, tie_break: Sequence[str], rate_s: int = DEFAULT_RATE_S
) -> DataFrame:
    """Lines with their step and their place in pickup order."""
    return global_rank(with_ticks(timed, rate_s), ["pickup", *tie_break], "send_rank")


def stage_ticks(
    timed: DataFrame,
    path: str,
    tie_break: Sequence[str],
    rate_s: int = DEFAULT_RATE_S,
    mode: str = "errorifexists",
    form: str = "parquet",
) -> None:
    """Write lines into one folder per step, in pickup order within files.

    Range partitioning spreads a crowded step over several tasks. With ``form`` "text"
    a line stream can read the folders; it takes files by their modification time.
    """
    order = [F.col(name).asc_nulls_first() for name in ("tick", "pickup", *tie_break)]
    ticked = with_ticks(timed, rate_s)
    (
        ticked.repartitionByRange(shuffle_width(timed.sparkSession), *order)
        .sortWithinPartitions(*order)
        .select("value", "tick")
        .write.mode(mode)
        .partitionBy("tick")
        .format(form)
        .save(path)
    )
