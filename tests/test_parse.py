import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meterline.functions.numbers import lenient_double, lenient_int
from meterline.functions.times import csv_field_time, line_pickup_time, raw_field_time, strict_time
from meterline.operators.parse import bad_lines, divert_trips, parse_trips
from meterline.schema import TRIP_SCHEMA

GOOD = "1,2023-01-01 00:10:00,2023-01-01 00:20:00,2.0,1.5,1.0, N\t,132,48,2,10,0.5,0.5,0,0,1,12.3,2.5,0"

NUMBERS = [
    ("1.5", 2, 1.5),
    ("-2.5", -2, -2.5),
    ("-0.5", 0, -0.5),
    ("0.49999999999999994", 0, 0.49999999999999994),
    ("null", 0, 0.0),
    ("NULL", 0, 0.0),
    ("", 0, 0.0),
    (" \t", 0, 0.0),
    ("abc", 0, 0.0),
    (None, 0, 0.0),
    (" 3 ", 3, 3.0),
    ("\t4\r", 4, 4.0),
    ("1e3", 1000, 1000.0),
    ("1.0f", 1, 1.0),
    ("0x1p3", 8, 8.0),
    ("Infinity", -1, math.inf),
    ("-Infinity", 0, -math.inf),
    ("1e999", -1, math.inf),
    ("inf", 0, 0.0),
    ("nan", 0, 0.0),
    ("3000000000", -1294967296, 3e9),
    ("4294967297", 1, 4294967297.0),
]


def _column(spark, texts):
    rows = [(i, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "i int, text string").coalesce(1)


def _values(frame):
    return [row[1] for row in sorted(frame.collect())]


def test_numbers(spark):
    frame = _column(spark, [text for text, _, _ in NUMBERS])
    ints = _values(frame.select("i", lenient_int(F.col("text"))))
    doubles = _values(frame.select("i", lenient_double(F.col("text"))))
    assert ints == [want for _, want, _ in NUMBERS]
    assert doubles == [want for _, _, want in NUMBERS]


def test_nan_is_a_double_and_int_zero(spark):
    frame = _column(spark, ["NaN", " NaN "])
    assert all(math.isnan(v) for v in _values(frame.select("i", lenient_double(F.col("text")))))
    assert _values(frame.select("i", lenient_int(F.col("text")))) == [0, 0]


EPOCH = dt.datetime(1970, 1, 1)
NOON = dt.datetime(2023, 1, 1, 5)

TIMES = [
    # text, typed field, CSV field, raw line field
    ("2023-01-01 05:00:00", NOON, NOON, NOON),
    ("2023-01-01 05:00:00.123", NOON, NOON, NOON),
    ("\t2023-01-01 05:00:00 ", NOON, NOON, NOON),
    (" null ", EPOCH, None, None),
    ("", EPOCH, None, None),
    ('"2023-01-01 05:00:00"', None, NOON, NOON),
    ('"2023-01-01 05:00:00.5"', None, NOON, NOON),
    ("bad", None, None, None),
    ("2023-1-1 5:0:0", None, NOON, NOON),
    ("2023-01-01T05:00:00", None, None, None),
    ("2023-01-01 05:00:00Z", None, None, None),
    ("2023-13-01 05:00:00", None, None, None),
    ("2023-02-30 05:00:00", dt.datetime(2023, 2, 28, 5), None, None),
    ("2024-02-31 05:00:00", dt.datetime(2024, 2, 29, 5), None, None),
    ("2023-01-01 24:00:00", dt.datetime(2023, 1, 2), None, None),
    ("2023-01-31 24:00:00", dt.datetime(2023, 2, 1), None, None),
    ("2023-04-30 24:00:00", dt.datetime(2023, 5, 1), None, None),
    ("2023-02-30 24:00:00", dt.datetime(2023, 3, 1), None, None),
    ("2023-01-01 25:00:00", None, None, None),
]


@pytest.mark.parametrize("reader, place", [(strict_time, 1), (csv_field_time, 2), (raw_field_time, 3)])
def test_times(spark, reader, place):
    frame = _column(spark, [case[0] for case in TIMES])
    assert _values(frame.select("i", reader(F.col("text")))) == [case[place] for case in TIMES]


def test_pickup_from_raw_line(spark):
    frame = _column(spark, [GOOD, '1,"2023-01-01 05:00:00",x', "1", ""])
    got = _values(frame.select("i", line_pickup_time(F.col("text"))))
    assert got == [dt.datetime(2023, 1, 1, 0, 10), NOON, None, None]


def _lines(spark, *lines):
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "id int, value string")


def test_good_lines(spark):
    trips = parse_trips(_lines(spark, GOOD, GOOD + ",extra", GOOD[:-1])).collect()
    assert [(t.vendor_id, t.passenger_count, t.store_and_fwd_flag, t.pu_location_id) for t in trips] == [
        (1, 2, "N", 132)
    ] * 3
    assert trips[2].airport_fee == 0.0


def test_schema(spark):
    got = parse_trips(_lines(spark, GOOD)).schema
    assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in TRIP_SCHEMA]


BAD = {
    1: ("", "empty"),
    2: ("  \t", "empty"),
    3: (None, "empty"),
    4: (GOOD.rsplit(",", 1)[0], "short"),
    5: (GOOD.replace("2023-01-01 00:10:00", "bad"), "pickup"),
    6: (GOOD.replace("2023-01-01 00:20:00", "bad"), "dropoff"),
    # No quote handling: the comma shifts fields.
    7: ('"1,2",' + GOOD, "pickup"),
}


def test_bad_lines(spark):
    lines = _lines(spark, GOOD, *[line for line, _ in BAD.values()])
    got = {row.id: (row.value, row.bad_reason) for row in bad_lines(lines, ["id"]).collect()}
    assert got == BAD
    good, diverted = divert_trips(lines, ["id"])
    assert [row.id for row in good.collect()] == [0]
    assert diverted.count() == len(BAD)
    kept = parse_trips(lines, "keep", ["id"])
    assert {r.id: r.bad_reason for r in kept.collect() if r.bad_reason} == {
        i: reason for i, (_, reason) in BAD.items()
    }


@pytest.mark.parametrize("place", sorted(BAD))
def test_failfast(spark, place):
    with pytest.raises(PySparkException, match="bad trip line"):
        parse_trips(_lines(spark, GOOD, BAD[place][0])).select("vendor_id").collect()


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        parse_trips(_lines(spark, GOOD), "ignore")
