import random
import re
import datetime as dt
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meterline.operators import prep, replay
from meterline.session import scratch_dir
from meterline.sources import lines as sources
from meterline.sources import sinks

HEADER = ["VendorID", "tpep_pickup_datetime", "tpep_dropoff_datetime", "note"]

LINES = [
    "1,2022-12-31 23:59:59,2023-01-01 01:00:00,early",
    "2,2023-01-01 00:00:00,2023-01-01 03:00:00,bound",
    "3,2023-01-01 00:00:01,bad,bad dropoff",
    '4,"2023-01-01 00:00:02","2023-01-01 02:00:00","a, ""b"""',
    "5,2023-01-01 00:00:03,2023-01-01 02:00:00,equal dropoff",
    "6,2023-01-01 00:00:04",
    "7,,2023-01-01 02:00:00,no pickup",
    "8,2023-01-01 00:00:05,2023-01-01 01:00:00,more,fields,than,names",
]


def _numbered(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "seq long, value string").repartition(4)


def test_time_columns():
    assert prep.time_columns(HEADER) == (1, 2)
    assert prep.time_columns(["a", "b", "c"]) == (1, 2)
    assert prep.time_columns(["Pickup_DateTime", "x", "dropoff_datetime", "pickup datetime 2"]) == (3, 2)


def test_prepare(spark):
    keyed = prep.keyed_lines(_numbered(spark, LINES), HEADER)
    ordered = prep.sort_by_dropoff(keyed, ["seq"])
    assert [row.seq for row in ordered.collect()] == [2, 7, 3, 4, 1]
    ranked = {row.seq: row.sort_rank for row in prep.rank_by_dropoff(keyed, ["seq"]).collect()}
    assert ranked == {2: 1, 7: 2, 3: 3, 4: 4, 1: 5}
    assert prep.prep_stats(keyed).first().asDict() == {
        "rows_read": 8,
        "rows_short": 1,
        "rows_too_early": 2,
        "rows_kept": 5,
    }


def test_sorted_file_keeps_lines(spark):
    path = scratch_dir(spark, "sorted")
    keyed = prep.keyed_lines(_numbered(spark, LINES), HEADER)
    sinks.write_raw_csv(prep.sort_by_dropoff(keyed, ["seq"]), path, ",".join(HEADER))
    back = sources.read_lines(spark, path, numbered=True).orderBy("file", "block", "pos")
    assert [row.value for row in back.collect()] == [LINES[i] for i in (2, 7, 3, 4, 1)]


def test_sorted_name():
    assert sinks.sorted_name("/data/trips.csv") == "/data/trips.sorted.csv"


def test_csv_scan_checks_header(spark):
    path = scratch_dir(spark, "csv")
    frame = spark.createDataFrame([("1", "2023-01-01 00:00:00", 'x, "y"')], "a string, b string, c string")
    sinks.write_csv(frame, path)
    assert sources.csv_header(spark, path) == ["a", "b", "c"]
    assert sources.read_csv_strings(spark, path, ["a", "b", "c"]).collect() == frame.collect()
    with pytest.raises(Exception, match="CSV header|header"):
        sources.read_csv_strings(spark, path, ["a", "x", "c"]).collect()


def test_bad_data_line_is_no_header(spark):
    frame = spark.createDataFrame([("2,the pickup datetime,bad,1.5",)], "value string")
    assert sources.data_lines(frame).count() == 1


def test_header_is_dropped_and_data_is_not(spark):
    lines = [",".join(HEADER), "", "  ", LINES[1], " " + LINES[2] + " "]
    frame = spark.createDataFrame([(line,) for line in lines], "value string")
    assert [r.value for r in sources.data_lines(frame).collect()] == [LINES[1], LINES[2]]
    assert sources.data_lines(frame, header=",".join(HEADER)).count() == 2
    assert sources.data_lines(frame, header="other").count() == 3


def test_peek_is_a_top_k(spark):
    frame = _numbered(spark, [f"line {i}" for i in range(50)])
    assert [r.seq for r in sources.peek(frame, ["seq"]).collect()] == list(range(10))


def _ticks_by_definition(times, rate):
    """A line is sent in the least step that ends at or after its time."""
    start, step = min(times), dt.timedelta(seconds=rate)
    sent = Counter(max(0, -((start - t) // step) - 1) for t in times)
    return [(start + n * step, start + (n + 1) * step, sent[n]) for n in range(max(sent) + 1)]


@pytest.mark.parametrize("seed, rate", [(1, 60), (2, 7200), (3, 1), (4, 599)])
def test_ticks_equal_their_definition(spark, seed, rate):
    rng = random.Random(seed)
    start = dt.datetime(2023, 1, 1)
    steps = [0, 0, rate, rate, 2 * rate, rate + 1] + [rng.randrange(0, 40 * rate) for _ in range(200)]
    times = [start + dt.timedelta(seconds=s) for s in steps]
    lines = _numbered(spark, [f"1,{t:%Y-%m-%d %H:%M:%S},x" for t in times] + ["1,bad,x"])
    counted = replay.tick_counts(replay.timed_lines(lines), rate).orderBy("tick").collect()
    want = _ticks_by_definition(times, rate)
    assert [(r.sim_start, r.sim_end, r.lines_sent) for r in counted] == want
    assert [r.tick for r in counted] == list(range(len(want)))


def test_replay_order_is_stable(spark):
    rng = random.Random(5)
    start = dt.datetime(2023, 1, 1)
    times = [start + dt.timedelta(seconds=rng.randrange(0, 50)) for _ in range(300)]
    lines = _numbered(spark, [f"1,{t:%Y-%m-%d %H:%M:%S},x" for t in times])
    ranked = replay.replay_order(replay.timed_lines(lines), ["seq"], 10)
    got = [r.seq for r in sorted(ranked.collect(), key=lambda r: r.send_rank)]
    assert got == sorted(range(300), key=lambda i: times[i])
    assert sorted(r.send_rank for r in ranked.collect()) == list(range(1, 301))


def test_staged_ticks(spark):
    start = dt.datetime(2023, 1, 1)
    times = [start + dt.timedelta(minutes=7 * i) for i in range(60)]
    lines = _numbered(spark, [f"{i},{t:%Y-%m-%d %H:%M:%S},x" for i, t in enumerate(times)])
    path = scratch_dir(spark, f"ticks-{uuid.uuid4().hex}")
    replay.stage_ticks(replay.timed_lines(lines), path, ["seq"], rate_s=3600)
    staged = spark.read.parquet(path)
    counts = {r.tick: r["count"] for r in staged.groupBy("tick").count().collect()}
    want = replay.with_ticks(replay.timed_lines(lines), 3600).groupBy("tick").count()
    assert counts == {r.tick: r["count"] for r in want.collect()}
    assert staged.where(F.col("tick") == 0).count() == 9


def test_quoted_fields_of_any_number(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(',,""ab\n') for _ in range(rng.randrange(14))) for _ in range(400)]
    texts.append(",".join(['"a,b"'] * 20000))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    got = {r.i: r.f for r in frame.select("i", prep.csv_fields(F.col("value")).alias("f")).collect()}
    for i, text in enumerate(texts[:-1]):
        assert got[i] == re.split(r',(?=(?:[^"]*"[^"]*")*[^"]*\Z)', text), text
    assert got[400] == ['"a,b"'] * 20000
