import datetime as dt
import itertools
import os
import random
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from meterline.operators import faults, hourly, parse, replay
from meterline.operators.window_fold import INCOME_FOLD, WindowFold, fold_windows
from meterline.session import scratch_dir
from meterline.sources import lines as sources
from meterline.streaming.fold_stream import stream_fold
from meterline.streaming.hourly_stream import run_hourly_lines, run_hourly_table, stream_income
from meterline.streaming.progress import ProgressRecorder, recent_metrics


def _line(time, zone, amount):
    return f"1,{time},{time},1,1,1,N,{zone},1,1,1,0,0,0,0,0,{amount},0,0"


def _local(path):
    return path.removeprefix("file:")


def _write(folder, name, rows):
    os.makedirs(_local(folder), exist_ok=True)
    hidden = os.path.join(_local(folder), f".{name}")
    with open(hidden, "w") as out:
        out.writelines(_line(f"2023-01-01 {time}", zone, amount) + "\n" for time, zone, amount in rows)
    # A file stream reads in order of modification time; files of one instant have none.
    at = time.time() - 3600 + next(_ORDER)
    os.utime(hidden, (at, at))
    os.rename(hidden, os.path.join(_local(folder), name))


_ORDER = itertools.count()

BATCHES = [
    [("00:10:00", 1, 10), ("00:20:00", 1, 5), ("01:00:59", 1, 1)],
    [("00:59:00", 1, 100)],
    [("01:01:00", 1, 2)],
    [("00:30:00", 1, 999)],
    [("02:00:00", 1, 3)],
]


def _run(spark, folders, **options):
    source, out, log = folders
    lines = sources.stream_lines(spark, source, max_files=1)
    query = run_hourly_table(lines, out, log, interval=None, **options)
    query.awaitTermination()
    return query


def _windows(spark, out):
    rows = spark.read.parquet(out).collect()
    return {(r.window_start.hour, r.pu_location_id): (r.trip_count, r.total_income) for r in rows}


@pytest.fixture
def folders(spark):
    return tuple(scratch_dir(spark, name) for name in ("in", "out", "log"))


def test_windows_close_late_rows_and_restart(spark, folders):
    for i, batch in enumerate(BATCHES):
        _write(folders[0], f"{i}.txt", batch)
    query = _run(spark, folders)
    assert _windows(spark, folders[1]) == {(0, 1): (4, 1114.0)}
    assert recent_metrics(spark, query).where("CheckpointStatus = 'COMPLETED'").count() >= len(BATCHES)
    _write(folders[0], "9.txt", [("05:00:00", 1, 4)])
    _run(spark, folders)
    assert _windows(spark, folders[1]) == {
        (0, 1): (4, 1114.0),
        (1, 1): (2, 3.0),
        (2, 1): (1, 3.0),
    }


def test_row_after_closing_is_dropped_and_counted(spark, folders):
    late = [BATCHES[0], BATCHES[2], BATCHES[4], BATCHES[3], [("05:00:00", 1, 4)]]
    for i, batch in enumerate(late):
        _write(folders[0], f"{i}.txt", batch)
    query = _run(spark, folders)
    assert _windows(spark, folders[1])[(0, 1)] == (2, 15.0)
    assert recent_metrics(spark, query).agg(F.sum("late_rows")).first()[0] == 1


def test_window_stays_open_one_second_before(spark, folders):
    _write(folders[0], "0.txt", [("00:10:00", 1, 10), ("01:00:59", 1, 1)])
    _run(spark, folders)
    assert _windows(spark, folders[1]) == {}
    _write(folders[0], "1.txt", [("01:01:00", 1, 1)])
    _run(spark, folders)
    assert _windows(spark, folders[1]) == {(0, 1): (1, 10.0)}


def test_bad_line_stops_or_is_dropped(spark, folders):
    _write(folders[0], "0.txt", [("00:10:00", 1, 10), ("00:nonsense", 1, 10), ("03:00:00", 1, 1)])
    with pytest.raises(StreamingQueryException):
        _run(spark, folders)
    other = (folders[0], folders[1] + "-b", folders[2] + "-b")
    _run(spark, other, bad="drop")
    assert _windows(spark, other[1]) == {(0, 1): (1, 10.0)}


def _random_trips(seed, hours=30, n=3000):
    """Lines in pickup order, one zone holding most of them."""
    rng = random.Random(seed)
    seconds = sorted(rng.randrange(hours * 3600) for _ in range(n))
    start = dt.datetime(2023, 1, 1)
    return [
        _line(
            f"{start + dt.timedelta(seconds=s):%Y-%m-%d %H:%M:%S}",
            7 if rng.random() < 0.6 else rng.randrange(1, 20),
            rng.randrange(100, 10000) / 100,
        )
        for s in seconds
    ]


def test_replayed_and_interrupted_stream_equals_batch(spark):
    """Lines staged by step, read step after step by a job stopped by a crash."""
    values = _random_trips(3)
    lines = spark.createDataFrame(list(enumerate(values)), "seq long, value string").repartition(6)
    staged, out, log = (scratch_dir(spark, n) for n in ("staged", "out", "log"))
    timed = replay.timed_lines(lines)
    replay.stage_ticks(timed, staged, ["seq"], rate_s=3600, form="text")
    assert spark.read.text(f"{staged}/tick=*").count() == len(values)
    for folder in Path(_local(staged)).glob("tick=*"):
        at = time.time() - 3600 + int(folder.name.partition("=")[2])
        for file in folder.glob("*.txt"):
            os.utime(file, (at, at))

    def stream():
        source = spark.readStream.format("text").option("maxFilesPerTrigger", 3)
        return stream_income(source.load(f"{staged}/tick=*").select("value"), exact_cents=True)

    calls = {"n": 0}

    def write(frame, batch):
        calls["n"] += 1
        frame.write.mode("overwrite").parquet(f"{out}/batch={batch:06d}")
        if calls["n"] in (3, 6):
            raise RuntimeError("lost in the middle of a batch")

    def start():
        writer = stream().writeStream.foreachBatch(write).option("checkpointLocation", log)
        return writer.trigger(availableNow=True).start()

    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            start().awaitTermination()
    start().awaitTermination()
    got = {
        (r.pu_location_id, r.window_start): (r.trip_count, r.total_income)
        for r in spark.read.parquet(out).collect()
    }
    trips = parse.parse_trips(lines)
    closed = trips.agg(F.max("pickup_ts") - F.expr("interval 1 minute")).first()[0]
    want = {
        (r.pu_location_id, r.window_start): (r.trip_count, r.total_income)
        for r in hourly.hourly_income(trips, exact_cents=True).collect()
        if r.window_end <= closed
    }
    assert got == want and len(want) > 300


def test_line_sink_writes_result_lines(spark, folders):
    _write(folders[0], "0.txt", [("00:10:00", 132, 111.4), ("03:00:00", 1, 1)])
    lines = sources.stream_lines(spark, folders[0])
    run_hourly_lines(lines, folders[1], folders[2], interval=None, hourly_folders=True).awaitTermination()
    assert [r.value for r in spark.read.text(folders[1]).collect()] == [
        "PULocationID=132, WindowStart=2023-01-01 00:00:00, WindowEnd=2023-01-01 01:00:00, "
        "TripCount=1, TotalIncome=111.40"
    ]


def test_recorder_writes_progress(spark, folders):
    path = scratch_dir(spark, "recorded")
    recorder = ProgressRecorder(spark, path, every=1)
    spark.streams.addListener(recorder)
    try:
        _write(folders[0], "0.txt", BATCHES[0])
        _run(spark, folders)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        recorder.flush()
    finally:
        spark.streams.removeListener(recorder)
    assert recorder.metrics().where("JobStatus = 'RUNNING'").count() >= 1


def test_crash_and_restart_make_one_episode(spark, folders):
    recorder = ProgressRecorder(spark, scratch_dir(spark, "recorded"))
    source, out, log = folders
    spark.streams.addListener(recorder)
    try:
        _write(source, "0.txt", [("00:10:00", 1, 10), ("00:nonsense", 1, 10)])
        with pytest.raises(StreamingQueryException):
            _run(spark, folders)
        _run(spark, folders, bad="drop")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(recorder)
    found = faults.restart_episodes(recorder.samples()).collect()
    assert len(found) == 1 and found[0].duration_us > 0
    assert {r.run_id for r in found} == {r.stream_run_id for r in recorder.metrics().collect()}


def test_fold_equals_the_aggregate(spark):
    lines = spark.createDataFrame([(v,) for v in _random_trips(4)], "value string").repartition(7)
    trips = parse.parse_trips(lines)
    got = {tuple(r) for r in fold_windows(trips, INCOME_FOLD).collect()}
    assert got == {tuple(r) for r in hourly.hourly_income(trips, exact_cents=True).collect()}


def test_fold_of_amounts_that_are_not_finite(spark):
    amounts = [("a", ["NaN", "1"]), ("b", ["1.5", "2"]), ("c", ["1e400", "1"])]
    values = [(_line("2023-01-01 00:10:00", zone, x),) for zone, (_, xs) in enumerate(amounts) for x in xs]
    trips = parse.parse_trips(spark.createDataFrame(values, "value string"))
    got = {r.pu_location_id: str(r.total_income) for r in fold_windows(trips, INCOME_FOLD).collect()}
    assert got == {0: "None", 1: "3.5", 2: "inf"}
    assert {**got, 0: "nan"} == {r.pu_location_id: str(r.total_income) for r in hourly.hourly_income(trips).collect()}


KEYS = ["pu_location_id", "window_start", "window_end"]


def test_fold_on_a_stream(spark, folders):
    """The streamed fold gives the windows the streamed aggregate gives, across a restart."""
    source, out, log = folders

    def run():
        lines = sources.stream_lines(spark, source, max_files=1)
        writer = stream_fold(lines, INCOME_FOLD).writeStream.format("parquet").option("path", out)
        writer.option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()

    for i, batch in enumerate(BATCHES):
        _write(source, f"{i}.txt", batch)
    run()
    assert _windows(spark, out) == {(0, 1): (4, 1114.0)}
    _write(source, "9.txt", [("05:00:00", 1, 4), ("00:05:00", 2, 4)])
    run()
    assert _windows(spark, out) == {(0, 1): (4, 1114.0), (1, 1): (2, 3.0), (2, 1): (1, 3.0)}


def test_fold_counts_what_the_aggregate_counts(spark, folders):
    """A window that opens with the batch that closes it, and a row too late for its own."""
    source, out, log = folders
    files = [[("00:10:00", 1, 1)], [("03:00:00", 1, 2)], [("01:10:00", 5, 3), ("05:00:00", 1, 4)], [("00:20:00", 1, 5), ("09:00:00", 1, 6)]]
    for i, rows in enumerate(files):
        _write(source, f"{i}.txt", rows)
    _run(spark, folders)
    windows = stream_fold(sources.stream_lines(spark, source, max_files=1), INCOME_FOLD)
    writer = windows.writeStream.format("parquet").option("path", f"{out}-fold").option("checkpointLocation", f"{log}-fold")
    writer.trigger(availableNow=True).start().awaitTermination()
    assert _windows(spark, f"{out}-fold") == _windows(spark, out)
    assert (1, 5) in _windows(spark, out)


def test_fold_gets_many_zones_at_once(spark, folders):
    """State and calls go by window and group of zones, also for a window met in two batches."""
    fold = WindowFold(
        columns=("trip_distance",),
        part_ddl="n bigint",
        result_ddl="n bigint, together bigint",
        condense=lambda rows: rows.groupby(KEYS, as_index=False).agg(n=("trip_distance", "size")),
        combine=lambda parts: parts.groupby(KEYS, as_index=False).agg({"n": "sum"}),
        finish=lambda parts: parts.assign(together=len(parts)),
    )
    source, out, log = folders
    _write(source, "0.txt", [("00:10:00", zone, 1) for zone in range(40)])
    _write(source, "1.txt", [("00:20:00", zone, 1) for zone in range(20, 60)])
    _write(source, "2.txt", [("03:00:00", 1, 1)])
    windows = stream_fold(sources.stream_lines(spark, source, max_files=1), fold)
    writer = windows.writeStream.format("parquet").option("path", out).option("checkpointLocation", log)
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert {r.pu_location_id: r.n for r in rows} == {zone: 1 + (20 <= zone < 40) for zone in range(60)}
    assert len(rows) == 60 and min(r.together for r in rows) > 1


def test_fold_from_another_folder(tmp_path):
    """Workers of a stream need no installed package."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.txt").write_text(_line("2023-01-01 00:10:00", 1, 10) + "\n" + _line("2023-01-01 03:00:00", 1, 1) + "\n")
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).parents[1])!r})
from meterline.session import build_session
from meterline.operators.window_fold import INCOME_FOLD
from meterline.sources.lines import stream_lines
from meterline.streaming.fold_stream import stream_fold
spark = build_session("fold", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
windows = stream_fold(stream_lines(spark, "in"), INCOME_FOLD).writeStream.format("parquet").option("path", "out")
windows.option("checkpointLocation", "log").trigger(availableNow=True).start().awaitTermination()
print("windows", spark.read.parquet("out").count())
"""
    environment = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=120)
    assert "windows 1" in done.stdout, done.stderr[-2000:]


def test_bad_lines_are_not_counted(spark):
    with pytest.raises(ValueError):
        stream_income(spark.createDataFrame([("x",)], "value string"), bad="keep")


def test_fold_may_give_no_or_many_rows(spark):
    """A caller's own function: the longest trip, only for zones with two trips or more."""
    fold = WindowFold(
        columns=("trip_distance",),
        part_ddl="n bigint, longest double",
        result_ddl="label string, longest double",
        condense=lambda rows: rows.groupby(KEYS, as_index=False).agg(
            n=("trip_distance", "size"), longest=("trip_distance", "max")
        ),
        combine=lambda parts: parts.groupby(KEYS, as_index=False).agg({"n": "sum", "longest": "max"}),
        finish=lambda parts: parts[parts["n"] >= 2].assign(label="busy"),
    )
    rows = [("00:10:00", 1, 1), ("00:20:00", 1, 1), ("00:30:00", 2, 1)]
    values = [(_line(f"2023-01-01 {time}", zone, amount),) for time, zone, amount in rows]
    trips = parse.parse_trips(spark.createDataFrame(values, "value string"))
    assert [(r.pu_location_id, r.label, r.longest) for r in fold_windows(trips, fold).collect()] == [
        (1, "busy", 1.0)
    ]


def test_exact_cents_falls_back(spark):
    rows = [(1, 0.1), (1, 0.2), (2, float("nan")), (2, 1.0), (3, 1e17), (3, 1.0)]
    frame = spark.createDataFrame(rows, "pu_location_id int, total_amount double").withColumn(
        "pickup_ts", F.lit("2023-01-01 00:00:00").cast("timestamp")
    )
    got = {r.pu_location_id: r.total_income for r in hourly.hourly_income(frame, exact_cents=True).collect()}
    assert got[1] == 0.3 and got[2] != got[2] and got[3] == 1e17 + 1.0
