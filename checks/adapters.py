"""Inputs of the operators, derived by Spark from the given ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions.render import RESULT_TIME

# Column names of public trip files.
HEADER = (
    "VendorID",
    "tpep_pickup_datetime",
    "tpep_dropoff_datetime",
    "passenger_count",
    "trip_distance",
    "RatecodeID",
    "store_and_fwd_flag",
    "PULocationID",
    "DOLocationID",
    "payment_type",
    "fare_amount",
    "extra",
    "mta_tax",
    "tip_amount",
    "tolls_amount",
    "improvement_surcharge",
    "total_amount",
    "congestion_surcharge",
    "airport_fee",
)

# What is wrong with a line, by divisor of event_id; the first match counts.
MESS = (
    (97, "null_total"),
    (89, "fraction"),
    (83, "blank_passenger"),
    (79, "blank_pickup"),
    (73, "short"),
    (71, "blank_line"),
    (67, "quoted_pickup"),
    (61, "bad_dropoff"),
)

BOUND = "2024-01-10 00:00:00"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    return table.withColumn("ts", F.col("ts").cast("timestamp"))


def _mess() -> Column:
    kind = F.when(F.lit(False), F.lit(""))
    for divisor, name in MESS:
        kind = kind.when(F.col("event_id") % divisor == 0, F.lit(name))
    return kind.otherwise(F.lit("none"))


def trip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id`` and ``value``, a trip line, messy for some ids."""
    source = events(spark, sf_dir).select(
        "event_id", "user_id", "value", F.date_trunc("second", "ts").alias("pickup"), _mess().alias("mess")
    )
    mess = F.col("mess")
    pickup = F.date_format("pickup", RESULT_TIME)
    dropoff = F.date_format(
        F.timestamp_micros(
            F.unix_micros("pickup") + F.col("event_id") % 60 * F.lit(60_000_000)
        ),
        RESULT_TIME,
    )
    pickup_text = (
        F.when(mess == "blank_pickup", F.lit(""))
        .when(mess == "fraction", F.concat(pickup, F.lit(".000")))
        .when(mess == "quoted_pickup", F.concat(F.lit('"'), pickup, F.lit('"')))
        .otherwise(pickup)
    )
    text = lambda number: number.cast("string")
    fields = [
        text(F.col("user_id") % 2 + 1),
        pickup_text,
        F.when(mess == "bad_dropoff", F.lit("bad")).otherwise(dropoff),
        F.when(mess == "blank_passenger", F.lit("")).otherwise(text(F.col("event_id") % 6)),
        F.lit("1.5"),
        F.lit("1.0"),
        F.lit(" N "),
        text(F.col("user_id") % 263 + 1),
        text(F.col("event_id") % 263 + 1),
        F.lit("2"),
        F.lit("10.0"),
        F.lit("0.5"),
        F.lit("0.5"),
        F.lit("-1.25"),
        F.lit("null"),
        F.lit("1.0"),
        F.when(mess == "null_total", F.lit("null")).otherwise(text(F.col("value"))),
        F.lit("2.5"),
    ]
    line = F.concat_ws(",", *fields)
    value = (
        F.when(mess == "blank_line", F.lit("  "))
        .when(mess == "short", line)
        .otherwise(F.concat(line, F.lit(",0.0")))
    )
    return source.select("event_id", value.alias("value"))


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text``: numbers and things that are not."""
    number = F.col("value").cast("string")
    variants = [
        number,
        F.concat(F.lit(" \t"), number, F.lit(" ")),
        F.lit("NULL"),
        F.lit(" "),
        F.lit("abc"),
        F.concat(F.lit("-"), number),
        F.concat(F.col("event_id").cast("string"), F.lit(".5")),
        F.lit("inf"),
        F.concat(number, F.lit("e1")),
    ]
    return events(spark, sf_dir).select("event_id", _by_id(variants).alias("text"))


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text``: times in several spellings and things that are not."""
    time = F.date_format("ts", RESULT_TIME)
    variants = [
        time,
        F.concat(time, F.lit(".123")),
        F.concat(F.lit('"'), time, F.lit('"')),
        F.lit(" null "),
        F.lit("bad"),
        F.concat(F.lit("\t"), time, F.lit("  ")),
        F.date_format("ts", "yyyy-M-d H:m:s"),
    ]
    return events(spark, sf_dir).select("event_id", _by_id(variants).alias("text"))


def _by_id(variants: list[Column]) -> Column:
    chosen = F.when(F.lit(False), F.lit(""))
    for i, variant in enumerate(variants):
        chosen = chosen.when(F.col("event_id") % len(variants) == i, variant)
    return chosen


def status_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, interval_s, ts, seq, status."""
    run = F.col("user_id") % 3
    kind = F.col("event_type")
    status = (
        F.when(kind == "error", F.lit("RESTARTING"))
        .when(kind == "signup", F.lit("FAILED"))
        .when(kind != "view", F.lit("RUNNING"))
    )
    return events(spark, sf_dir).select(
        run.alias("run_id"),
        _interval(run).alias("interval_s"),
        "ts",
        F.col("event_id").alias("seq"),
        status.alias("status"),
    )


def _interval(run: Column) -> Column:
    return F.when(run == 0, F.lit(5)).when(run == 1, F.lit(30)).otherwise(F.lit(300))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metrics row per event; sign-ups know no checkpoint."""
    run = F.col("user_id") % 3
    number = F.floor(F.col("event_id") / 10)
    known = F.col("event_type") != "signup"
    return events(spark, sf_dir).select(
        run.alias("run_id"),
        _interval(run).alias("interval_s"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("double").alias("latency"),
        F.col("value").alias("throughput"),
        F.when(known, number).alias("checkpoint_id"),
        F.when(known, number % 1500).alias("checkpoint_duration_ms"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("job_status"),
    )


def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows under the names of the log file."""
    return metrics(spark, sf_dir).select(
        "seq",
        F.col("ts").alias("timestamp"),
        F.col("latency").alias("Latency"),
        F.col("throughput").alias("Throughput"),
        F.col("checkpoint_id").alias("CheckpointID"),
        F.when(F.col("checkpoint_id").isNotNull(), F.lit("COMPLETED")).alias("CheckpointStatus"),
        F.col("checkpoint_duration_ms").alias("CheckpointDurationMs"),
        F.col("job_status").alias("JobStatus"),
    )


def checkpoint_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value``: checkpoint reports of five shapes."""
    number = F.col("event_id") + 1
    took = F.col("event_id") % 1500
    shapes = [
        F.format_string(
            '{"history":{"entries":[{"id":%d,"status":"COMPLETED","duration":%d},{"id":0}]}}',
            number,
            took,
        ),
        F.format_string(
            '{"history":[{"id":9}],"latest":{"completed":'
            '{"id":%d,"status":"COMPLETED","end_to_end_duration":%d}}}',
            number,
            took,
        ),
        F.format_string(
            '{"history":{"entries":[]},"latest":{"completed":{"entries":[{"checkpointId":%d,'
            '"state":"FAILED","trigger_timestamp":%d,"latest_ack_timestamp":%d}]}}}',
            number,
            number * 1000,
            number * 1000 + took,
        ),
        F.format_string('{"latest":{},"last":{"checkpoint_id":%d,"duration":"44"}}', number),
        F.lit("{}"),
    ]
    return events(spark, sf_dir).select("event_id", _by_id(shapes).alias("value"))


# Metric names by event type: two that fit, one of them a second spelling, and
# two that hold only one of two keywords or none.
METRIC_NAMES = (
    ("click", "Source__Lines.numRecordsOutPerSecond"),
    ("view", "consumer.fetch-latency-avg"),
    ("error", "numRecordsOutPerSecond"),
    ("purchase", "Source__Lines.fetch-latency-avg"),
    ("signup", "Source__Lines.uptime"),
)


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight samples (position, id, value) per poll."""
    name = F.when(F.lit(False), F.lit(""))
    for kind, text in METRIC_NAMES:
        name = name.when(F.col("event_type") == kind, F.lit(text))
    return events(spark, sf_dir).select(
        F.floor(F.col("event_id") / 8).alias("poll_id"),
        (F.col("event_id") % 8).alias("position"),
        name.alias("id"),
        F.col("value").cast("string").alias("value"),
    )


def progress_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value``: streaming progress reports; every seventh has no state operator."""
    state = F.when(
        F.col("event_id") % 7 != 0,
        F.array(
            F.struct(
                (F.col("event_id") % 11).alias("commitTimeMs"),
                (F.col("event_id") % 3).alias("numRowsDroppedByWatermark"),
            ),
            F.struct(
                F.lit(5).alias("commitTimeMs"), F.lit(1).alias("numRowsDroppedByWatermark")
            ),
        ),
    ).otherwise(F.array())
    report = F.struct(
        F.concat(F.lit("run-"), (F.col("user_id") % 3).cast("string")).alias("id"),
        F.col("event_id").alias("batchId"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.col("value").alias("processedRowsPerSecond"),
        F.struct(
            (F.col("event_id") % 900).alias("triggerExecution"),
            (F.col("event_id") % 40).alias("walCommit"),
            (F.col("event_id") % 30).alias("commitOffsets"),
        ).alias("durationMs"),
        state.alias("stateOperators"),
        F.lit("x").alias("name"),
    )
    return events(spark, sf_dir).select("event_id", F.to_json(report).alias("value"))
