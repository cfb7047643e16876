"""Whole windows by the hook and by places; states, batches and late rows from a checkpoint."""

import random
from statistics import median_high, median_low

import pytest
from pyspark.sql import functions as F

from meterline.operators import hourly, parse
from meterline.operators.window_rows import _parts, _windows, medians, ranked_rows, visit_median, window_rows
from meterline.session import scratch_dir
from meterline.sources import lines as sources
from meterline.streaming.checkpoint_tables import batch_files, batches, judged_rows, open_windows
from meterline.streaming.hourly_stream import drained, run_hourly_table
from tests.test_streaming import _line, _random_trips, _run, _windows as emitted, _write

DDL = "trip_count bigint, low_median double, high_median double"


def _trips(spark, values, parts=5):
    return parse.parse_trips(spark.createDataFrame([(v,) for v in values], "value string").repartition(parts))


@pytest.fixture
def folders(spark):
    return tuple(scratch_dir(spark, name) for name in ("in", "out", "log"))


def test_medians_of_hot_and_single_windows(spark):
    """One zone and hour holds most rows; chunks and batches end inside it."""
    draw = random.Random(5)
    values = [_line(f"2023-01-01 00:{i % 60:02}:00", 7, draw.randrange(1000)) for i in range(3000)] + _random_trips(8, hours=6, n=400)
    trips = _trips(spark, values)
    want = {}
    for row in trips.select("pu_location_id", F.date_trunc("hour", "pickup_ts").alias("hour"), "total_amount").collect():
        want.setdefault((row.pu_location_id, row.hour), []).append(row.total_amount)
    want = {key: (len(x), median_low(x), median_high(x)) for key, x in want.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        hooked = window_rows(trips, visit_median, ["total_amount"], ["total_amount"], DDL).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows in (hooked, medians(trips, "total_amount").collect()):
        assert {(r.pu_location_id, r.window_start): (r.trip_count, r.low_median, r.high_median) for r in rows} == want
        assert len(rows) == len(want)


def test_a_visit_sees_all_rows_in_order_and_may_give_none(spark):
    """Rows, columns and order as asked for; nulls first; a visit that reads nothing leaves the next whole."""
    trips = _trips(spark, _random_trips(9, hours=3, n=500)).withColumn("fare_amount", F.when(F.col("total_amount") > 50, F.col("total_amount")))

    def visit(window):
        if window.pu_location_id % 2:
            return
        fares = [x for batch in window for x in batch.column(1).to_pylist()]
        assert len(fares) == window.size and fares == sorted(fares, key=lambda x: (x is not None, x))
        yield fares.count(None), max((x for x in fares if x is not None), default=None)

    got = {tuple(r) for r in window_rows(trips, visit, ["do_location_id", "fare_amount"], ["fare_amount"], "nulls int, high double").collect()}
    grouped = trips.where("pu_location_id % 2 = 0").groupBy("pu_location_id", F.window("pickup_ts", "1 hour").alias("w"))
    want = grouped.agg(F.count_if(F.col("fare_amount").isNull()).alias("nulls"), F.max("fare_amount").alias("high"))
    assert got == {tuple(r) for r in want.select("pu_location_id", "w.start", "w.end", "nulls", "high").collect()}


def test_places_in_many_chunks(spark):
    trips = _trips(spark, _random_trips(10, hours=2, n=300))
    rows = ranked_rows(trips, ["do_location_id"], ["total_amount", "trip_distance"], chunks=40).collect()
    found = {}
    for row in rows:
        found.setdefault((row.pu_location_id, row.window_start), []).append(row)
    for own in found.values():
        own.sort(key=lambda row: row.row_place)
        assert [row.row_place for row in own] == list(range(1, len(own) + 1))
        assert all(row.row_total == len(own) for row in own)
        amounts = [row.total_amount for row in own]
        assert amounts == sorted(amounts)
    assert len(rows) == 300


def test_no_rows(spark):
    trips = _trips(spark, [], 1)
    assert window_rows(trips, visit_median, ["total_amount"], ["total_amount"], DDL).collect() == []
    assert medians(trips, "total_amount").collect() == []
    assert list(_windows(_parts(iter([])))) == []


LATE = [
    [("00:10:00", 1, 10), ("00:20:00", 1, 5)],
    [("01:30:00", 1, 2), ("01:40:00", 2, 1)],
    [("00:50:00", 1, 100)],
    [("02:40:00", 1, 3)],
    [("00:30:00", 1, 999), ("01:59:00", 3, 7), ("02:50:00", 1, 1)],
]


def test_late_rows_are_those_the_job_dropped(spark, folders):
    source, out, log = folders
    for i, batch in enumerate(LATE[:3]):
        _write(source, f"{i} %.txt", batch)  # a name that paths write in another way
    _run(spark, folders)
    for i, batch in enumerate(LATE[3:], 3):
        _write(source, f"{i}.txt", batch)
    _run(spark, folders)
    judged = judged_rows(spark, source, log)
    rows = {(f"{r.pickup_ts:%H:%M}", r.pu_location_id): r.late for r in judged.collect()}
    assert len(rows) == sum(map(len, LATE))
    assert {key for key, late in rows.items() if late} == {("00:30", 1)}
    kept = {(r.window_start.hour, r.pu_location_id): (r.trip_count, r.total_income) for r in hourly.hourly_income(judged.where("not late")).collect()}
    left = {(r.window_start.hour, r.pu_location_id): (r.trip_count, r.total_income) for r in open_windows(spark, log).collect()}
    assert left and not left.keys() & emitted(spark, out).keys()
    assert kept == {**left, **emitted(spark, out)}
    files = {r.path.rpartition("/")[2]: r.batch for r in batch_files(spark, log).collect()}
    reading = {r.batch for r in batches(spark, log).where("reads_new").collect()}
    assert len(files) == 5 and set(files.values()) == reading
    assert judged_rows(spark, source, log, since=max(reading)).select("batch").distinct().count() == 1


def test_a_log_that_was_cut_is_an_error(spark, folders):
    source, _, log = folders
    for i, batch in enumerate(LATE):
        _write(source, f"{i}.txt", batch)
    _run(spark, folders)
    import os

    for name in ("offsets", "commits"):
        os.remove(f"{log.removeprefix('file:')}/{name}/0")
    with pytest.raises(ValueError):
        judged_rows(spark, source, log)
    assert judged_rows(spark, source, log, since=2).where("batch < 2").count() == 0


def test_open_windows_of_plain_sums_and_of_an_earlier_batch(spark, folders):
    source, out, log = folders
    for i, batch in enumerate(LATE[:2]):
        _write(source, f"{i}.txt", batch)
    _run(spark, folders)
    assert {(r.window_start.hour, r.pu_location_id): (r.trip_count, r.total_income) for r in open_windows(spark, log, 0).collect()} == {(0, 1): (2, 15.0)}
    assert {(r.window_start.hour, r.pu_location_id) for r in open_windows(spark, log).collect()} == {(1, 1), (1, 2)}


def test_a_slow_source_loses_no_row(spark, folders):
    """The fast source is hours ahead; alone it would have closed what the slow one still brings."""
    slow, out, log = folders
    fast = scratch_dir(spark, "fast")
    _write(fast, "0.txt", [("00:05:00", 1, 1), ("09:00:00", 1, 2)])
    _write(slow, "0.txt", [("00:10:00", 1, 10)])
    job = run_hourly_table([sources.stream_lines(spark, folder) for folder in (fast, slow)], out, log, interval="50 milliseconds")
    try:
        for i, batch in enumerate(([("01:10:00", 1, 20)], [("00:50:00", 2, 5), ("03:00:00", 1, 30)]), 1):
            job.processAllAvailable()
            _write(slow, f"{i}.txt", batch)
    finally:
        drained(job)
    assert emitted(spark, out) == {(0, 1): (2, 11.0), (1, 1): (1, 20.0)}
    assert batches(spark, log).where("reads_new").count() == 3
