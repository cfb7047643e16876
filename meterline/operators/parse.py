"""Trip lines to typed trips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.numbers import double_or_zero, half_up_int, trim_control
from meterline.functions.once import once
from meterline.functions.times import strict_time
from meterline.schema import DROPOFF_INDEX, PICKUP_INDEX, TRIP_FIELDS

BAD_LINE_MODES = ("failfast", "drop", "keep")


def parse_trips(
    lines: DataFrame, bad: str = "failfast", keep: Sequence[str] = (), line: str = "value"
) -> DataFrame:
    """Split lines at commas (quotes mean nothing) and type the first 19 fields.

    ``bad`` says what becomes of a line with too few fields or an unreadable
    time: ``failfast`` stops the job, ``drop`` leaves the line out, ``keep``
    keeps it with its reason in ``bad_reason``. ``keep`` names input columns to
    carry along.
    """
    if bad not in BAD_LINE_MODES:
        raise ValueError(f"bad must be one of {BAD_LINE_MODES}, not {bad!r}")
    rows = _read_fields(lines, keep, line)
    typed = [_typed(kind, index).alias(name) for index, (name, kind) in enumerate(TRIP_FIELDS)]
    if bad == "keep":
        return rows.select(*keep, *typed, _bad_reason().alias("bad_reason"))
    if bad == "drop":
        return rows.where(_bad_reason().isNull()).select(*keep, *typed)
    complaint = F.concat_ws("", F.lit("bad trip line ("), _bad_reason(), F.lit("): "), F.col(_LINE))
    checked = F.when(_bad_reason().isNull(), F.lit(True)).otherwise(
        F.raise_error(complaint).cast("boolean")
    )
    return rows.where(checked).select(*keep, *typed)


def counted_trips(lines: DataFrame, bad: str = "failfast", keep: Sequence[str] = ()) -> DataFrame:
    """Trips to be counted: ``keep`` as a mode would count bad lines as trips, so it is refused."""
    if bad == "keep":
        raise ValueError("bad lines can't be kept where trips are counted")
    return parse_trips(lines, bad, keep)


def bad_lines(lines: DataFrame, keep: Sequence[str] = (), line: str = "value") -> DataFrame:
    """The lines ``parse_trips`` would drop, as they are, with the reason."""
    marked = _read_fields(lines, keep, line).select(
        *keep, F.col(_LINE).alias(line), _bad_reason().alias("bad_reason")
    )
    return marked.where(F.col("bad_reason").isNotNull())


def divert_trips(
    lines: DataFrame, keep: Sequence[str] = (), line: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """Good trips and, apart, the bad lines. For a stream see ``streaming.divert_stream``."""
    return parse_trips(lines, "drop", keep, line), bad_lines(lines, keep, line)


_LINE = "_line"
_FIELDS = "_fields"
_TIMES = "_times"


def _read_fields(lines: DataFrame, keep: Sequence[str], line: str) -> DataFrame:
    """Split each line once, read its two times once and cast each number once.

    Numbers become columns of their own because what follows mentions them often.
    Columns nobody asks for are pruned.
    """
    split = F.split(F.coalesce(F.col(line), F.lit("")), ",", -1)
    rows = lines.select(*keep, F.col(line).alias(_LINE), once(split, _FIELDS))
    times = F.struct(
        *[strict_time(_field(i)).alias(f"_{i}") for i in (PICKUP_INDEX, DROPOFF_INDEX)]
    )
    numbers = [i for i, (_, kind) in enumerate(TRIP_FIELDS) if kind in ("int", "double")]
    cast = rows.select("*", once(times, _TIMES)).select(
        "*", *[_field(i).try_cast("double").alias(f"_cast_{i}") for i in numbers]
    )
    return cast.select(
        "*", *[double_or_zero(F.col(f"_cast_{i}"), _field(i)).alias(f"_{i}") for i in numbers]
    )


def _field(index: int) -> Column:
    return F.get(F.col(_FIELDS), F.lit(index))


def _time(index: int) -> Column:
    return F.col(f"{_TIMES}._{index}")


def _typed(kind: str, index: int) -> Column:
    if kind == "time":
        return _time(index)
    if kind == "text":
        return trim_control(_field(index))
    number = F.col(f"_{index}")
    return half_up_int(number) if kind == "int" else number


def _bad_reason() -> Column:
    blank = (F.size(_FIELDS) == 1) & (trim_control(_field(0)) == "")
    return (
        F.when(blank, F.lit("empty"))
        .when(F.size(_FIELDS) < len(TRIP_FIELDS), F.lit("short"))
        .when(_time(PICKUP_INDEX).isNull(), F.lit("pickup"))
        .when(_time(DROPOFF_INDEX).isNull(), F.lit("dropoff"))
    )
