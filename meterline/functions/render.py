"""Text forms, used only where rows leave for a text or CSV sink."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RESULT_LINE = "PULocationID=%d, WindowStart=%s, WindowEnd=%s, TripCount=%d, TotalIncome=%.2f"
RESULT_TIME = "yyyy-MM-dd HH:mm:ss"
LOG_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
NOT_AVAILABLE = "N/A"
STATUS_NOT_AVAILABLE = "N/A (API Failed)"


def result_line(
    zone: Column, start: Column, end: Column, trips: Column, income: Column
) -> Column:
    return F.format_string(
        RESULT_LINE,
        zone,
        F.date_format(start, RESULT_TIME),
        F.date_format(end, RESULT_TIME),
        trips,
        income,
    )


def or_marker(value: Column, marker: str = NOT_AVAILABLE) -> Column:
    return F.coalesce(value.cast("string"), F.lit(marker))


def log_time(value: Column) -> Column:
    return F.date_format(value, LOG_TIME)
