"""The hook for window functions that have to see every row of a window, in order.

``window_rows`` streams a window's rows, sorted, to the caller's function: memory does
not grow with the window, but one task reads it. ``ranked_rows`` gives each row its place
and the number of rows instead, cut into chunks of the total order, so a window with a
third of all rows is spread over many tasks; order statistics are then plain filters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.operators.hourly import DEFAULT_WIDTH
from meterline.operators.ordered import CHUNK, ordered_chunks, placed
from meterline.operators.window_fold import KEY_DDL, KEYS, names_in, with_window
from meterline.session import ship_package, shuffle_width

# Result rows that are handed over together.
_TOGETHER = 8192


@dataclass
class WindowRows:
    """A window's key and number of rows; iterating gives its rows, batch by batch, once."""

    pu_location_id: int
    window_start: np.datetime64
    window_end: np.datetime64
    size: int
    batches: Iterator[pa.RecordBatch]

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        return self.batches


Visit = Callable[[WindowRows], Iterable[tuple]]


def window_rows(
    trips: DataFrame, visit: Visit, columns: Sequence[str], order: Sequence[str], result_ddl: str, width: str = DEFAULT_WIDTH
) -> DataFrame:
    """Key columns and ``visit``'s result rows (tuples of ``result_ddl``), 0..n per window.

    ``visit`` gets a window's rows as Arrow batches of ``columns`` in the order of
    ``order`` (nulls first), and knows their number before the first: counts are summed
    per task before the shuffle and sorted to the front. It may stop anywhere. Rows of
    one place in the order come in any order.
    """
    ship_package(trips.sparkSession)
    wanted = list(dict.fromkeys((*columns, *order)))
    rows = with_window(trips, tuple(wanted), width)
    counts = rows.groupBy(*KEYS).agg(F.count("*").alias("_size"))
    # One count row per window, led to its front by _is_row.
    both = rows.withColumn("_is_row", F.lit(1)).unionByName(counts.withColumn("_is_row", F.lit(0)), allowMissingColumns=True)
    along = [F.col(name).asc_nulls_first() for name in (*KEYS, "_is_row", *order)]
    dealt = both.repartition(shuffle_width(trips.sparkSession), *KEYS).sortWithinPartitions(*along)
    names = [*KEYS, *names_in(result_ddl)]
    taken = dealt.select(*KEYS, "_size", *columns)
    schema = taken.sparkSession.createDataFrame([], f"{KEY_DDL}, {result_ddl}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        results: list[tuple] = []

        def full() -> pa.RecordBatch:
            parts = list(zip(*results, strict=True))
            arrays = [pa.array(part, kinds.field(i).type) for i, part in enumerate(parts)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for window in _windows(batches):
            key = (window.pu_location_id, window.window_start, window.window_end)
            results.extend((*key, *row) for row in visit(window))
            if len(results) >= _TOGETHER:
                yield full()
                results.clear()
        if results:
            yield full()

    return taken.mapInArrow(run, f"{KEY_DDL}, {result_ddl}")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[WindowRows]:
    """Windows one after the other; what a caller leaves unread of one is skipped."""
    parts = _parts(batches)
    head = next(parts, None)
    while head is not None:
        following: list[pa.RecordBatch] = []

        def rest() -> Iterator[pa.RecordBatch]:
            for part in parts:
                if part.column(3)[0].is_valid:  # the count of the next window
                    following.append(part)
                    return
                yield part.select(range(4, part.num_columns))

        unread = rest()
        key = [head.column(i)[0].as_py() for i in range(4)]
        yield WindowRows(*key, batches=unread)
        for _ in unread:
            pass
        head = following[0] if following else None


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut before and behind each count row."""
    for batch in batches:
        counts = np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False))
        cuts = np.unique(np.r_[0, counts, counts + 1, batch.num_rows])
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield batch.slice(low, high - low)


def ranked_rows(
    trips: DataFrame, columns: Sequence[str], order: Sequence[str], width: str = DEFAULT_WIDTH, chunks: int | None = None
) -> DataFrame:
    """Rows with ``row_place`` (from 1, in the order) and ``row_total`` of their window.

    No window is gathered: rows are cut into even chunks of (window, order), shuffled
    once by chunk, and counts per window and chunk carry places over chunk borders.
    """
    wanted = list(dict.fromkeys((*columns, *order)))
    cut = ordered_chunks(with_window(trips, tuple(wanted), width), KEYS, order, chunks)
    sizes = cut.groupBy(*KEYS, CHUNK).agg(F.count("*").alias("_rows"))
    # A window of several chunks has as many rows here; windows inside a chunk have one.
    whole = Window.partitionBy(*KEYS)
    before = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *[F.col(name).alias(f"_to_{name}") for name in (*KEYS, CHUNK)],
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("row_total"),
        F.count("*").over(whole).alias("_pieces"),
    )
    inside = Window.partitionBy(*KEYS, CHUNK)
    along = [F.col(name).asc_nulls_first() for name in order]
    rows = placed(cut).withColumn("_place", F.row_number().over(inside.orderBy(*along))).withColumn("_own", F.count("*").over(inside))
    # Only windows cut by a chunk border need what other chunks hold: two per chunk at most.
    same = F.lit(True)
    for name in (*KEYS, CHUNK):
        same = same & F.col(name).eqNullSafe(F.col(f"_to_{name}"))
    joined = rows.join(F.broadcast(sizes.where("_pieces > 1")), same, "left")
    return joined.select(
        *KEYS,
        *wanted,
        (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("bigint").alias("row_place"),
        F.coalesce("row_total", "_own").alias("row_total"),
    )


def is_median(place: Column | str = "row_place", total: Column | str = "row_total") -> Column:
    """The middle row of an odd number of rows, the two middle ones of an even number."""
    place, total = (F.col(x) if isinstance(x, str) else x for x in (place, total))
    return (place == F.floor((total + 1) / 2)) | (place == F.floor((total + 2) / 2))


def medians(trips: DataFrame, column: str, width: str = DEFAULT_WIDTH) -> DataFrame:
    """Each window's number of rows, and its lower and upper median of ``column``."""
    middle = ranked_rows(trips, [column], [column], width).where(is_median())
    return middle.groupBy(*KEYS).agg(
        F.max("row_total").alias("trip_count"), F.min(column).alias("low_median"), F.max(column).alias("high_median")
    )


def visit_median(window: WindowRows) -> Iterator[tuple]:
    """Rows, and the lower and upper median of the first column, of rows in its order."""
    low, high, at, found = (window.size - 1) // 2, window.size // 2, 0, []
    for batch in window:
        for place in dict.fromkeys((low, high)):
            if at <= place < at + batch.num_rows:
                found.append(batch.column(0)[place - at].as_py())
        at += batch.num_rows
        if at > high:
            break
    yield window.size, found[0], found[-1]
