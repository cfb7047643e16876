"""Cleaning and sorting of trip files before replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.once import once
from meterline.functions.times import csv_field_time
from meterline.operators.ordered import global_rank
from meterline.schema import DROPOFF_INDEX, PICKUP_INDEX

# Fixed value: trips that began earlier are dirty data.
DEFAULT_BOUND = "2023-01-01 00:00:00"

# A comma outside quotes: an even number of quotes follows it. Possessive, so that it
# neither backtracks nor recurses.
_OUTER_COMMA = r',(?=(?:[^"]*+"[^"]*+")*+[^"]*+$)'


def time_columns(header: Sequence[str]) -> tuple[int, int]:
    """Places of the pickup and dropoff time among the column names."""

    def place(word: str, default: int) -> int:
        lowered = [name.lower() for name in header]
        hits = [i for i, name in enumerate(lowered) if word in name and "datetime" in name]
        return hits[-1] if hits else default

    return place("pickup", PICKUP_INDEX), place("dropoff", DROPOFF_INDEX)


def csv_fields(line: Column) -> Column:
    """Fields of a CSV line; a quoted field keeps its commas, and its quotes."""
    plain = F.split(line, ",", -1)
    # Pieces between quotes in turn lie outside and inside, counted from the end. A line
    # has no line break, so breaks can stand for outer commas; this takes linear time.
    pieces = F.split(line, '"', -1)
    outer = lambda piece, i: (F.size(pieces) - 1 - i) % 2 == 0
    broken = F.transform(pieces, lambda piece, i: F.when(outer(piece, i), F.replace(piece, F.lit(","), F.lit("\n"))).otherwise(piece))
    quoted = F.split(F.array_join(broken, '"'), "\n", -1)
    quoted = F.when(F.contains(line, F.lit("\n")), F.split(line, _OUTER_COMMA, -1)).otherwise(quoted)
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain)


def keyed_lines(lines: DataFrame, header: Sequence[str], line: str = "value") -> DataFrame:
    """Add ``pickup``, ``dropoff`` (null when unreadable) and ``is_short``."""
    pickup, dropoff = time_columns(header)
    fields = F.col("_fields")
    keys = F.struct(
        csv_field_time(F.get(fields, F.lit(pickup))).alias("pickup"),
        csv_field_time(F.get(fields, F.lit(dropoff))).alias("dropoff"),
        (F.size(fields) <= max(pickup, dropoff)).alias("is_short"),
    )
    split = lines.select("*", once(csv_fields(F.col(line)), "_fields"))
    return split.select(*lines.columns, once(keys, "_keys")).select(*lines.columns, "_keys.*")


def _kept(bound: str) -> Column:
    in_time = F.col("pickup") >= F.lit(bound).cast("timestamp")
    return ~F.col("is_short") & F.coalesce(in_time, F.lit(False))


def clean(keyed: DataFrame, bound: str = DEFAULT_BOUND) -> DataFrame:
    """Rows long enough and picked up at or after the bound; bad pickups go."""
    return keyed.where(_kept(bound))


def prep_stats(keyed: DataFrame, bound: str = DEFAULT_BOUND) -> DataFrame:
    """One row of totals, from one pass."""
    return keyed.agg(
        F.count("*").alias("rows_read"),
        F.count_if(F.col("is_short")).alias("rows_short"),
        F.count_if(~F.col("is_short") & ~_kept(bound)).alias("rows_too_early"),
        F.count_if(_kept(bound)).alias("rows_kept"),
    )


def sort_by_dropoff(
    keyed: DataFrame, tie_break: Sequence[str], bound: str = DEFAULT_BOUND
) -> DataFrame:
    """Clean rows in dropoff order, bad dropoffs first; helper columns are gone.

    ``tie_break`` names columns that restore input order, because the sort is
    not stable. It is a range-partitioned sort: output files follow the order.
    """
    order = ["dropoff", *tie_break]
    ordered = clean(keyed, bound).orderBy(*[F.col(name).asc_nulls_first() for name in order])
    return ordered.drop("pickup", "dropoff", "is_short")


def sorted_lines(
    keyed: DataFrame, header: str, tie_break: Sequence[str], bound: str = DEFAULT_BOUND, line: str = "value"
) -> DataFrame:
    """The header, then clean lines in dropoff order, each as it is.

    The header is the first row of the order, so files written from this and read by
    name make one whole file: one header at its beginning, nothing quoted or escaped.
    """
    names = ["dropoff", *tie_break]
    first = keyed.sparkSession.createDataFrame([(header,)], f"{line} string").withColumn("_is_line", F.lit(0))
    rows = clean(keyed, bound).withColumn("_is_line", F.lit(1)).select("_is_line", line, *names)
    both = rows.unionByName(first, allowMissingColumns=True)
    return both.orderBy("_is_line", *[F.col(name).asc_nulls_first() for name in names]).select(line)


def rank_by_dropoff(
    keyed: DataFrame, tie_break: Sequence[str], bound: str = DEFAULT_BOUND
) -> DataFrame:
    """Clean rows with their place in that order as a column."""
    return global_rank(clean(keyed, bound), ["dropoff", *tie_break], "sort_rank")
