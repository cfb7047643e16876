"""Column names and Spark types of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# The 19 trip fields in line order, with their kinds.
TRIP_FIELDS: tuple[tuple[str, str], ...] = (
    ("vendor_id", "int"),
    ("pickup_ts", "time"),
    ("dropoff_ts", "time"),
    ("passenger_count", "int"),
    ("trip_distance", "double"),
    ("ratecode_id", "int"),
    ("store_and_fwd_flag", "text"),
    ("pu_location_id", "int"),
    ("do_location_id", "int"),
    ("payment_type", "int"),
    ("fare_amount", "double"),
    ("extra", "double"),
    ("mta_tax", "double"),
    ("tip_amount", "double"),
    ("tolls_amount", "double"),
    ("improvement_surcharge", "double"),
    ("total_amount", "double"),
    ("congestion_surcharge", "double"),
    ("airport_fee", "double"),
)

PICKUP_INDEX = 1
DROPOFF_INDEX = 2

_SPARK_TYPES = {
    "int": T.IntegerType(),
    "time": T.TimestampType(),
    "double": T.DoubleType(),
    "text": T.StringType(),
}

TRIP_SCHEMA = T.StructType(
    [T.StructField(name, _SPARK_TYPES[kind]) for name, kind in TRIP_FIELDS]
)

HOURLY_SCHEMA = T.StructType(
    [
        T.StructField("pu_location_id", T.IntegerType()),
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("trip_count", T.LongType()),
        T.StructField("total_income", T.DoubleType()),
    ]
)

# File column names of the three run logs, in file order.
METRICS_COLUMNS = (
    "timestamp",
    "Latency",
    "Throughput",
    "CheckpointID",
    "CheckpointStatus",
    "CheckpointDurationMs",
    "JobStatus",
)
STATUS_COLUMNS = ("record_timestamp", "job_status")
RESTART_COLUMNS = ("record_timestamp", "duration_minus_60s_seconds")
