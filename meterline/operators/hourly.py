"""Trips and income per pickup zone and hour; for batch and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.render import result_line

DEFAULT_WIDTH = "1 hour"


def income_sum(amount: Column, exact_cents: bool = False) -> Column:
    """Sum of amounts as a double.

    A plain double sum depends on the order of rows in its last digits, hence on
    shuffles and retries. ``exact_cents`` rounds each amount to cents and sums
    decimals; if some amount is not finite or too large for that, the group falls
    back to the double sum, so it comes out as it would without the option.
    """
    plain = F.sum(amount)
    if not exact_cents:
        return plain
    cents = amount.try_cast("decimal(18,2)")
    beyond = F.count_if(cents.isNull() & amount.isNotNull())
    return F.when(beyond == 0, F.sum(cents).cast("double")).otherwise(plain)


def hourly_income(
    trips: DataFrame,
    width: str = DEFAULT_WIDTH,
    exact_cents: bool = False,
    time: str = "pickup_ts",
    zone: str = "pu_location_id",
    amount: str = "total_amount",
) -> DataFrame:
    """Count and income per zone and tumbling window ``[start, end)``.

    Partial sums are built before the one shuffle, so a crowded zone costs no
    more than its number of windows there.
    """
    grouped = trips.groupBy(F.window(time, width).alias("_window"), zone).agg(
        F.count("*").alias("trip_count"),
        income_sum(F.col(amount), exact_cents).alias("total_income"),
    )
    return grouped.select(
        F.col(zone).alias("pu_location_id"),
        F.col("_window.start").alias("window_start"),
        F.col("_window.end").alias("window_end"),
        "trip_count",
        "total_income",
    )


def hourly_lines(income: DataFrame) -> DataFrame:
    """Results as text lines."""
    return income.select(
        result_line(
            F.col("pu_location_id"),
            F.col("window_start"),
            F.col("window_end"),
            F.col("trip_count"),
            F.col("total_income"),
        ).alias("value")
    )
