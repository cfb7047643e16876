"""The hook for callers' own window functions.

A window's rows are never gathered as a whole: the caller's function comes in
two parts, one that condenses a batch of rows and one that combines condensed
rows. The first runs before the shuffle, so only condensed rows travel, however
crowded a zone and hour is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.operators.hourly import DEFAULT_WIDTH
from meterline.session import ship_package, shuffle_width

KEYS = ("pu_location_id", "window_start", "window_end")
KEY_DDL = "pu_location_id int, window_start timestamp, window_end timestamp"


@dataclass(frozen=True)
class WindowFold:
    """A window function in parts, each taking rows of many windows at once.

    ``condense(rows)`` turns trips into condensed rows, which hold the key columns
    and ``part_ddl``'s. ``combine(parts)`` reduces condensed rows to one (or a few)
    of the same shape per window, and must not depend on their order or grouping.
    ``finish(parts)`` makes 0..n result rows (``result_ddl``) per window from its
    last condensed rows; all keep the key columns.
    """

    columns: tuple[str, ...]
    part_ddl: str
    result_ddl: str
    condense: Callable[[pd.DataFrame], pd.DataFrame]
    combine: Callable[[pd.DataFrame], pd.DataFrame]
    finish: Callable[[pd.DataFrame], pd.DataFrame]


def with_window(trips: DataFrame, columns: tuple[str, ...], width: str = DEFAULT_WIDTH):
    """Key columns of each trip's window, and the columns the fold reads."""
    return trips.select(
        "pu_location_id",
        F.window("pickup_ts", width).alias("_window"),
        *columns,
    ).select(
        "pu_location_id",
        F.col("_window.start").alias("window_start"),
        F.col("_window.end").alias("window_end"),
        *columns,
    )


def condensed(rows: DataFrame, fold: WindowFold, latest: str | None = None) -> DataFrame:
    """Condensed rows of each task, at most a few per window met in a batch.

    ``latest`` names a time column; the latest time of the batch's rows of each window
    is added under that name.
    """
    ship_package(rows.sparkSession)
    combine_keys = list(KEYS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            parts = fold.condense(batch)[combine_keys + part_names]
            if latest:
                times = batch.groupby(combine_keys, as_index=False)[latest].max()
                parts = parts.merge(times, on=combine_keys)
            yield parts

    part_names = names_in(fold.part_ddl)
    more = f", {latest} timestamp" if latest else ""
    return rows.mapInPandas(run, f"{KEY_DDL}, {fold.part_ddl}{more}")


def fold_windows(trips: DataFrame, fold: WindowFold, width: str = DEFAULT_WIDTH) -> DataFrame:
    """Apply a fold to every zone and window of a batch of trips."""
    parts = condensed(with_window(trips, fold.columns, width), fold)
    columns = [*KEYS, *names_in(fold.result_ddl)]

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Windows arrive one after the other; only the last one may go on in the next batch.
        held = None
        for batch in batches:
            if not len(batch):
                continue
            last = batch[list(KEYS)].iloc[-1]
            parts = batch if held is None else pd.concat([held, batch], ignore_index=True)
            parts = fold.combine(parts)
            going_on = (parts[list(KEYS)] == last).all(axis=1)
            held = parts[going_on]
            done = parts[~going_on]
            if len(done):
                yield fold.finish(done)[columns]
        if held is not None:
            yield fold.finish(held)[columns]

    width_of_shuffle = shuffle_width(trips.sparkSession)
    gathered = parts.repartition(width_of_shuffle, *KEYS).sortWithinPartitions(*KEYS)
    return gathered.mapInPandas(reduce, f"{KEY_DDL}, {fold.result_ddl}")


def names_in(ddl: str) -> list[str]:
    return [column.split()[0] for column in ddl.split(",")]


_TALLIES = ["trips", "cents", "nans", "ups", "downs"]


def _condense_income(rows: pd.DataFrame) -> pd.DataFrame:
    amount = rows["total_amount"]
    # Sums in pandas skip NaN, so what is not finite is counted beside the sum.
    tallied = rows.assign(
        trips=1,
        cents=(amount.where(np.isfinite(amount), 0.0) * 100).round(),
        nans=amount.isna().astype("int64"),
        ups=(amount == np.inf).astype("int64"),
        downs=(amount == -np.inf).astype("int64"),
    )
    return _combine_income(tallied)


def _combine_income(parts: pd.DataFrame) -> pd.DataFrame:
    return parts.groupby(list(KEYS), as_index=False)[_TALLIES].sum()


def _finish_income(part: pd.DataFrame) -> pd.DataFrame:
    total = (part["cents"] / 100.0).mask(part["ups"] > 0, np.inf).mask(part["downs"] > 0, -np.inf)
    unknown = (part["nans"] > 0) | ((part["ups"] > 0) & (part["downs"] > 0))
    return part.assign(trip_count=part["trips"], total_income=total.mask(unknown, np.nan))


# The built-in aggregate once more, through the hook (for amounts in whole cents). Pandas
# hands NaN over as null, so a window that holds one has a null income here.
INCOME_FOLD = WindowFold(
    columns=("total_amount",),
    part_ddl="trips bigint, cents double, nans bigint, ups bigint, downs bigint",
    result_ddl="trip_count bigint, total_income double",
    condense=_condense_income,
    combine=_combine_income,
    finish=_finish_income,
)
