"""Callers' own window functions on a stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meterline.operators.hourly import DEFAULT_WIDTH
from meterline.operators.parse import counted_trips
from meterline.operators.window_fold import (
    KEY_DDL,
    KEYS,
    WindowFold,
    condensed,
    names_in,
    with_window,
)
from meterline.session import prepare, use_rocksdb
from meterline.streaming.hourly_stream import DEFAULT_DELAY


#: Zones are dealt into so many groups, the same after a restart: state is kept by group and window.
GROUPS = 4
GROUP = "zone_group"


class FoldProcessor(StatefulProcessor):
    """Keeps the condensed rows of a window's group of zones until the watermark passes its end."""

    def __init__(self, fold: WindowFold):
        self._fold = fold
        self._names = [KEYS[0], *names_in(fold.part_ddl)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._parts = handle.getListState("parts", f"{KEY_DDL.partition(',')[0]}, {self._fold.part_ddl}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Late rows do not come here. Timers fire after a batch's rows, also those of windows
        # that open and close with it.
        held = self._held(key)
        if not len(held):
            self._handle.registerTimer(_millis(key[2]))
        frames = [part[[*KEYS, *self._names[1:]]] for part in rows]
        frames += [held] if len(held) else []
        parts = self._fold.combine(pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0].reset_index(drop=True))
        self._parts.put(list(parts[self._names].itertuples(index=False, name=None)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        columns = [*KEYS, *names_in(self._fold.result_ddl)]
        results = self._fold.finish(self._held(key))[columns]
        self._parts.clear()
        if len(results):
            yield results

    def close(self) -> None:
        pass

    def _held(self, key) -> pd.DataFrame:
        parts = pd.DataFrame([tuple(row) for row in self._parts.get()], columns=self._names)
        for place, name in enumerate(KEYS[1:], 1):
            parts.insert(place, name, key[place])
        return parts


def _millis(time) -> int:
    stamp = pd.Timestamp(time)
    if stamp.tzinfo is None:
        stamp = stamp.tz_localize("UTC")
    return stamp.value // 1_000_000


def stream_fold(
    lines: DataFrame,
    fold: WindowFold,
    bad: str = "failfast",
    width: str = DEFAULT_WIDTH,
    delay: str = DEFAULT_DELAY,
) -> DataFrame:
    """A fold over a line stream; windows come out once, as ``stream_income``'s do.

    Rows are condensed before the shuffle, and state holds condensed rows only. The
    delay counts from the latest pickup among rows that were condensed to something;
    that time goes along with them, so rows are late here where they are late there.

    Calls into Python and state go by window and group of zones, not by zone, and the
    fold's functions get the rows of all of a group's zones at once.
    """
    use_rocksdb(prepare(lines.sparkSession))
    columns = tuple(dict.fromkeys((*fold.columns, "pickup_ts")))
    trips = counted_trips(lines, bad)
    package = sys.modules[__package__.partition(".")[0]]
    # Streaming Python workers do not see shipped files, so the code travels by value.
    cloudpickle.register_pickle_by_value(package)
    try:
        parts = condensed(with_window(trips, columns, width), fold, latest="pickup_ts")
        # Spark drops late rows by the window of a column that bears the watermark.
        parts = parts.withWatermark("pickup_ts", delay).withColumn("_window", F.window("pickup_ts", width)).drop("pickup_ts")
        parts = parts.withColumn(GROUP, F.pmod(F.xxhash64(KEYS[0]), F.lit(GROUPS)).cast("int"))
        return parts.groupBy(GROUP, *KEYS[1:]).transformWithStateInPandas(
            statefulProcessor=FoldProcessor(fold),
            outputStructType=f"{KEY_DDL}, {fold.result_ddl}",
            outputMode="append",
            timeMode="eventTime",
        )
    finally:
        cloudpickle.unregister_pickle_by_value(package)
