"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import adapters
from meterline.functions.numbers import lenient_double, lenient_int
from meterline.functions.times import column_time, raw_field_time, strict_time
from meterline.operators import analysis, faults, hourly, parse, prep, replay, runlog
from meterline.plans.report import interval_report
from meterline.operators.ordered import global_rank
from meterline.operators.window_fold import INCOME_FOLD, fold_windows
from meterline.operators.window_rows import medians, visit_median, window_rows
from meterline.session import scratch_dir, prepare
from meterline.sources import lines as line_sources
from meterline.sources import sinks
from meterline.sources.compaction import compact
from meterline.streaming.checkpoint_tables import batches, judged_rows, open_windows
from meterline.streaming.divert_stream import diverted, run_divert
from meterline.streaming.fold_stream import stream_fold
from meterline.streaming.hourly_stream import drained, paced, run_hourly_lines, run_hourly_table, run_rolled_lines
from meterline.streaming.measured_stream import measured, run_measured

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(prepare(spark), sf_dir)

    QUERIES[build.__name__] = run
    return run


# Lines, numbers, times


@query
def q_peek_lines(spark, sf_dir):
    return line_sources.peek(adapters.trip_lines(spark, sf_dir), ["event_id"])


@query
def q_read_lines(spark, sf_dir):
    path = scratch_dir(spark, "lines")
    sinks.write_raw_csv(adapters.trip_lines(spark, sf_dir), path, ",".join(adapters.HEADER))
    return line_sources.read_lines(spark, path).select("value")


@query
def q_lenient_int(spark, sf_dir):
    texts = adapters.number_texts(spark, sf_dir)
    return texts.select("event_id", lenient_int(F.col("text")).alias("number"))


@query
def q_lenient_double(spark, sf_dir):
    texts = adapters.number_texts(spark, sf_dir)
    return texts.select("event_id", lenient_double(F.col("text")).alias("number"))


@query
def q_time_fields(spark, sf_dir):
    text = F.col("text")
    return adapters.time_texts(spark, sf_dir).select(
        "event_id",
        strict_time(text).alias("strict"),
        column_time(text).alias("from_column"),
        raw_field_time(text).alias("from_raw_line"),
    )


@query
def q_parse_trips(spark, sf_dir):
    return parse.parse_trips(adapters.trip_lines(spark, sf_dir), "drop", keep=["event_id"])


@query
def q_bad_lines(spark, sf_dir):
    return parse.bad_lines(adapters.trip_lines(spark, sf_dir), keep=["event_id"])


# Cleaning, sorting, replay


def _keyed(spark, sf_dir):
    return prep.keyed_lines(adapters.trip_lines(spark, sf_dir), adapters.HEADER)


@query
def q_prep_sorted(spark, sf_dir):
    ranked = prep.rank_by_dropoff(
        _keyed(spark, sf_dir).drop("value"), ["event_id"], adapters.BOUND
    )
    return ranked.select("event_id", "pickup", "dropoff", "sort_rank")


@query
def q_shifted_columns(spark, sf_dir):
    """The same sort where other columns come first: times are found by the header."""
    moved = F.concat(F.lit("a,b,"), F.col("value"))
    lines = adapters.trip_lines(spark, sf_dir).where(F.btrim("value") != "").withColumn("value", moved)
    keyed = prep.keyed_lines(lines, ["first", "second", *adapters.HEADER]).drop("value")
    ranked = prep.rank_by_dropoff(keyed, ["event_id"], adapters.BOUND)
    return ranked.select("event_id", "pickup", "dropoff", "sort_rank")


@query
def q_prep_stats(spark, sf_dir):
    return prep.prep_stats(_keyed(spark, sf_dir), adapters.BOUND)


@query
def q_sorted_csv(spark, sf_dir):
    path = scratch_dir(spark, "sorted")
    ordered = prep.sort_by_dropoff(_keyed(spark, sf_dir), ["event_id"], adapters.BOUND)
    sinks.write_raw_csv(ordered, path, ",".join(adapters.HEADER))
    rows = line_sources.read_csv_strings(spark, path, list(adapters.HEADER))
    return rows.select(
        "tpep_pickup_datetime",
        "tpep_dropoff_datetime",
        "passenger_count",
        "PULocationID",
        "total_amount",
        "airport_fee",
    )


@query
def q_sorted_lines(spark, sf_dir):
    """Whole lines of the sorted file with their places, the header first."""
    path = scratch_dir(spark, "sorted")
    prep.sorted_lines(_keyed(spark, sf_dir), ",".join(adapters.HEADER), ["event_id"], adapters.BOUND).write.text(path)
    text = line_sources.numbered_text(spark, path)
    return global_rank(text, ["file", "block", "pos"], "line_no").select("line_no", "value")


@query
def q_lines_by_place(spark, sf_dir):
    """Files that begin with a header and hold a line like it further down, which is data."""
    path = scratch_dir(spark, "placed")
    header = ",".join(adapters.HEADER)
    lines = adapters.trip_lines(spark, sf_dir)
    twin = F.when(F.col("event_id") % 500 == 3, F.lit(header)).otherwise(F.col("value"))
    lines = lines.select(twin.alias("value"), F.floor(F.col("event_id") / 400).cast("int").alias("file"), "event_id")
    heads = lines.select("file").distinct().select(F.lit(header).alias("value"), "file", F.lit(-1).cast("bigint").alias("event_id"))
    both = lines.unionByName(heads).repartition("file").sortWithinPartitions("file", "event_id")
    both.select("value", "file").write.partitionBy("file").text(path)
    return line_sources.read_lines(spark, path, by_place=True).select("value")


def _timed(spark, sf_dir):
    return replay.timed_lines(adapters.trip_lines(spark, sf_dir))


@query
def q_replay_ticks(spark, sf_dir):
    return replay.tick_counts(_timed(spark, sf_dir))


@query
def q_replay_ticks_fine(spark, sf_dir):
    return replay.tick_counts(_timed(spark, sf_dir), rate_s=60)


@query
def q_replay_order(spark, sf_dir):
    ranked = replay.replay_order(_timed(spark, sf_dir).drop("value"), ["event_id"])
    return ranked.select("event_id", "pickup", "tick", "send_rank")


# Hourly income


def _trips(spark, sf_dir):
    return parse.parse_trips(adapters.trip_lines(spark, sf_dir), "drop")


@query
def q_hourly_income(spark, sf_dir):
    return hourly.hourly_income(_trips(spark, sf_dir), exact_cents=True)


@query
def q_hourly_lines(spark, sf_dir):
    return hourly.hourly_lines(q_hourly_income(spark, sf_dir))


@query
def q_window_apply(spark, sf_dir):
    return fold_windows(_trips(spark, sf_dir), INCOME_FOLD)


_MEDIAN_DDL = "trip_count bigint, low_median double, high_median double"


@query
def q_window_rows(spark, sf_dir):
    """The exact median of each window by a function that is handed its rows in order."""
    return window_rows(_trips(spark, sf_dir), visit_median, ["total_amount"], ["total_amount"], _MEDIAN_DDL)


@query
def q_window_medians(spark, sf_dir):
    """The same by places in the window, with no window read by one task."""
    return medians(_trips(spark, sf_dir), "total_amount")


@query
def q_stream_hourly(spark, sf_dir):
    """The streaming job over the same lines, drained to its end; open windows stay in state."""
    source = scratch_dir(spark, "stream-in")
    out = scratch_dir(spark, "stream-out")
    adapters.trip_lines(spark, sf_dir).select("value").write.text(source)
    lines = spark.readStream.format("text").load(source)
    job = run_hourly_table(
        lines, out, scratch_dir(spark, "stream-log"), interval=None, bad="drop", exact_cents=True
    )
    job.awaitTermination()
    return spark.read.parquet(out)


def _line_stream(spark, lines):
    """A stream over the lines, written as files."""
    source = scratch_dir(spark, "stream-in")
    lines.select("value").write.text(source)
    return spark.readStream.format("text").load(source)


@query
def q_stream_restart(spark, sf_dir):
    """The job stopped and started again: earlier lines first, later ones after the restart."""
    source, out, log = (scratch_dir(spark, name) for name in ("stream-in", "stream-out", "stream-log"))
    lines = adapters.trip_lines(spark, sf_dir).select("value")
    later = F.coalesce(F.get(F.split("value", ","), 1) >= adapters.BOUND, F.lit(False))
    for part in (~later, later):
        lines.where(part).write.mode("append").text(source)
        stream = spark.readStream.format("text").load(source)
        run_hourly_table(stream, out, log, interval=None, bad="drop", exact_cents=True).awaitTermination()
    return spark.read.parquet(out)


@query
def q_stream_fold(spark, sf_dir):
    """The streaming job through the hook for callers' own window functions."""
    out = scratch_dir(spark, "stream-out")
    windows = stream_fold(_line_stream(spark, adapters.trip_lines(spark, sf_dir)), INCOME_FOLD, bad="drop")
    writer = windows.writeStream.format("parquet").option("path", out)
    paced(writer.option("checkpointLocation", scratch_dir(spark, "stream-log")), None).start().awaitTermination()
    return spark.read.parquet(out)


@query
def q_stream_lines(spark, sf_dir):
    """Result lines of the streaming job, two files per micro-batch."""
    out, log = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-log")
    lines = _line_stream(spark, adapters.trip_lines(spark, sf_dir))
    run_hourly_lines(lines, out, log, interval=None, bad="drop", exact_cents=True, files=2).awaitTermination()
    return spark.read.text(out)


@query
def q_stream_rolled(spark, sf_dir):
    """Result lines in files that end before a number of bytes."""
    out, log = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-log")
    lines = _line_stream(spark, adapters.trip_lines(spark, sf_dir))
    run_rolled_lines(lines, out, log, interval=None, bad="drop", exact_cents=True, max_bytes=20_000).awaitTermination()
    return spark.read.text(out).select("value", (F.col("_metadata.file_size") <= 20_000).alias("fits"))


@query
def q_stream_observed(spark, sf_dir):
    """Figures that a stream gathers of its micro-batches, over all of them."""
    source, out, log = (scratch_dir(spark, name) for name in ("stream-in", "stream-out", "stream-log"))

    def run():
        run_measured(spark.readStream.format("text").load(source), out, log, interval=None).awaitTermination()

    _grown([[(part, source)] for part in _slices(adapters.trip_lines(spark, sf_dir))], run)
    return measured(spark, out).agg(
        F.count("*").alias("batches"),
        F.sum("lines").alias("lines"),
        F.sum("bad_lines").alias("bad_lines"),
        F.max("latest_pickup").alias("latest_pickup"),
        F.round(F.sum("total_amount"), 2).alias("total_amount"),
    )


@query
def q_stream_divert(spark, sf_dir):
    """Trips and bad lines of one streaming job."""
    out = scratch_dir(spark, "stream-out")
    lines = _line_stream(spark, adapters.trip_lines(spark, sf_dir))
    run_divert(lines, out, scratch_dir(spark, "stream-log"), interval=None).awaitTermination()
    trips, bad = diverted(spark, out)
    trips = trips.select("pu_location_id", "pickup_ts", "dropoff_ts", "total_amount")
    return trips.unionByName(bad, allowMissingColumns=True)


def _grown(parts, run):
    """Call ``run`` each time lines have been added to the folders they are for."""
    for part in parts:
        for lines, folder in part:
            lines.select("value").write.mode("append").text(folder)
        run()


def _slices(lines):
    """The lines in three parts by pickup; unreadable ones go with the first."""
    pickup = F.coalesce(F.get(F.split("value", ","), 1), F.lit(""))
    bounds = ("2024-01-10", "2024-01-20")
    return [lines.where(pickup < bounds[0]), lines.where(pickup.between(*bounds)), lines.where(pickup > bounds[1])]


@query
def q_stream_sources(spark, sf_dir):
    """Two sources: one gives all its lines at once, the other lags behind and loses none."""
    fast, slow, out, log = (scratch_dir(spark, name) for name in ("fast-in", "slow-in", "stream-out", "stream-log"))
    lines = adapters.trip_lines(spark, sf_dir)
    first, *later = _slices(lines.where("event_id % 3 <> 0"))
    for part, folder in ((lines.where("event_id % 3 = 0"), fast), (first, slow)):
        part.select("value").write.text(folder)
    streams = [spark.readStream.format("text").load(folder) for folder in (fast, slow)]
    job = run_hourly_table(streams, out, log, interval="100 milliseconds", bad="drop", exact_cents=True)
    job.processAllAvailable()
    _grown([[(part, slow)] for part in later], job.processAllAvailable)
    drained(job)
    return spark.read.parquet(out)


@query
def q_open_windows(spark, sf_dir):
    """Windows given out by the drained job, and those left in its state."""
    out, log = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-log")
    lines = _line_stream(spark, adapters.trip_lines(spark, sf_dir))
    run_hourly_table(lines, out, log, interval=None, bad="drop", exact_cents=True).awaitTermination()
    closed, open_ = spark.read.parquet(out), open_windows(spark, log)
    return closed.withColumn("is_open", F.lit(False)).unionByName(open_.withColumn("is_open", F.lit(True)))


@query
def q_late_rows(spark, sf_dir):
    """Every trip that a job with late rows has read, marked as counted or dropped."""
    source, out, log = (scratch_dir(spark, name) for name in ("stream-in", "stream-out", "stream-log"))
    lines = adapters.trip_lines(spark, sf_dir)

    def run():
        stream = spark.readStream.format("text").load(source)
        run_hourly_table(stream, out, log, interval=None, bad="drop", exact_cents=True).awaitTermination()

    _grown([[(lines.where(f"event_id % 2 = {i}"), source)] for i in (0, 1)], run)
    rows = judged_rows(spark, source, log, bad="drop")
    return rows.select("pu_location_id", "do_location_id", "pickup_ts", "total_amount", "late")


@query
def q_stream_interval(spark, sf_dir):
    """The job under two intervals: equal windows; the log has one commit per part that arrived."""
    runs = []
    for interval_ms in (100, 400):
        source, out, log = (scratch_dir(spark, name) for name in ("stream-in", "stream-out", "stream-log"))

        def run():
            stream = spark.readStream.format("text").load(source)
            drained(run_hourly_table(stream, out, log, interval=f"{interval_ms} milliseconds", bad="drop", exact_cents=True))

        _grown([[(part, source)] for part in _slices(adapters.trip_lines(spark, sf_dir))], run)
        commits = batches(spark, log).where("reads_new").agg(F.count("*")).scalar()
        runs.append(spark.read.parquet(out).select(F.lit(interval_ms).alias("interval_ms"), "*", commits.alias("commits")))
    return runs[0].unionByName(runs[1])


# Run logs


@query
def q_metrics_render(spark, sf_dir):
    return sinks.render_metrics(adapters.metrics_log(spark, sf_dir))


@query
def q_status_render(spark, sf_dir):
    status = adapters.status_samples(spark, sf_dir).select(
        "seq", F.col("ts").alias("record_timestamp"), F.col("status").alias("job_status")
    )
    return sinks.render_status(status)


@query
def q_run_log(spark, sf_dir):
    path = scratch_dir(spark, "metrics-log")
    rendered = sinks.render_metrics(adapters.metrics_log(spark, sf_dir).drop("seq"))
    sinks.append_log(rendered, path)
    sinks.append_log(rendered, path)
    return sinks.read_metrics(spark, path)


@query
def q_compacted_log(spark, sf_dir):
    """A log appended to in parts, merged twice with appends between and after."""
    path = scratch_dir(spark, "metrics-log")
    log = sinks.render_metrics(adapters.metrics_log(spark, sf_dir))
    for part in range(5):
        sinks.append_log(log.where(f"seq % 5 = {part}").drop("seq"), path)
        if part in (1, 3):
            compact(spark, path)
    return sinks.read_metrics(spark, path)


@query
def q_metric_pick(spark, sf_dir):
    return runlog.pick_metrics(adapters.metric_samples(spark, sf_dir))


@query
def q_checkpoint_rows(spark, sf_dir):
    return runlog.checkpoint_rows(adapters.checkpoint_reports(spark, sf_dir), ["event_id"])


@query
def q_progress_metrics(spark, sf_dir):
    return runlog.progress_metrics(adapters.progress_reports(spark, sf_dir), ["event_id"])


@query
def q_latest_checkpoint(spark, sf_dir):
    rows = adapters.metrics(spark, sf_dir)
    done = rows.where(F.col("job_status") == "purchase")
    polls = rows.where(~F.col("job_status").eqNullSafe(F.lit("purchase")))
    return runlog.latest_checkpoint(polls, done)


@query
def q_status_changes(spark, sf_dir):
    return faults.status_changes(adapters.status_samples(spark, sf_dir))


@query
def q_restart_episodes(spark, sf_dir):
    return faults.restart_episodes(adapters.status_samples(spark, sf_dir))


@query
def q_restart_log(spark, sf_dir):
    log = faults.restart_log(q_restart_episodes(spark, sf_dir))
    return log.select(
        "run_id",
        "record_timestamp",
        F.round("duration_minus_60s_seconds", 6).alias("duration_minus_60s_seconds"),
    )


@query
def q_recorded_report(spark, sf_dir):
    """Metrics and status written as run logs with run_id, read back, and reported on."""
    metrics_path, status_path = scratch_dir(spark, "metrics-log"), scratch_dir(spark, "status-log")
    rows = adapters.metrics(spark, sf_dir).select("run_id", "seq")
    sinks.append_log(sinks.render_metrics(rows.join(adapters.metrics_log(spark, sf_dir), "seq")), metrics_path)
    status = adapters.status_samples(spark, sf_dir).select(
        "run_id", "seq", F.col("ts").alias("record_timestamp"), F.col("status").alias("job_status")
    )
    sinks.append_log(sinks.render_status(status), status_path)
    metrics = sinks.read_metrics(spark, metrics_path, "seq bigint, run_id bigint")
    status = sinks.read_status(spark, status_path, "run_id bigint, seq bigint")
    runs = adapters.status_samples(spark, sf_dir).select("run_id", "interval_s").distinct()
    report = interval_report(runlog.report_rows(metrics), runlog.status_rows(status), runs)
    return report.select(*[F.round(n, 6).alias(n) if kind == "double" else n for n, kind in report.dtypes])


# Cost of the checkpoint interval


def _episodes(spark, sf_dir):
    """Episodes with the interval of their run, written once because they are used twice."""
    found = q_restart_episodes(spark, sf_dir).withColumn(
        "interval_s",
        F.when(F.col("run_id") == 0, F.lit(5)).when(F.col("run_id") == 1, F.lit(30)).otherwise(F.lit(300)),
    )
    return found.checkpoint()


@query
def q_steady_state_avg(spark, sf_dir):
    steady = faults.steady_samples(adapters.metrics(spark, sf_dir), _episodes(spark, sf_dir))
    return steady.groupBy("interval_s").agg(
        F.count("*").alias("samples"),
        F.round(F.avg("throughput"), 6).alias("avg_throughput"),
        F.round(F.avg("latency"), 6).alias("avg_latency"),
    )


def _by_interval(spark, sf_dir):
    return analysis.metrics_by_interval(adapters.metrics(spark, sf_dir))


@query
def q_metrics_by_interval(spark, sf_dir):
    rows = _by_interval(spark, sf_dir)
    doubles = [name for name, kind in rows.dtypes if kind == "double"]
    return rows.select(
        *[F.round(name, 6).alias(name) if name in doubles else name for name in rows.columns]
    )


@query
def q_restart_by_interval(spark, sf_dir):
    rows = analysis.restart_by_interval(_episodes(spark, sf_dir))
    return rows.select("interval_s", "restarts", F.round("avg_restart_s", 6).alias("avg_restart_s"))


def _costs(spark, sf_dir):
    return analysis.interval_costs(
        _by_interval(spark, sf_dir), analysis.restart_by_interval(_episodes(spark, sf_dir))
    )


@query
def q_utilization(spark, sf_dir):
    rows = analysis.with_utilization(_costs(spark, sf_dir))
    return rows.select(
        "interval_s",
        *[F.round(c, 9).alias(c) for c in ("checkpoint_s", "recovery_s", "utilization")],
    )


@query
def q_best_interval(spark, sf_dir):
    best = analysis.best_interval(analysis.with_utilization(_costs(spark, sf_dir)))
    return best.select("interval_s", F.round("utilization", 9).alias("utilization"))


@query
def q_best_interval_exact(spark, sf_dir):
    found = analysis.best_interval_exact(_costs(spark, sf_dir))
    return found.select(
        "interval_s",
        F.round("best_interval_s", 6).alias("best_interval_s"),
        F.round("best_utilization", 9).alias("best_utilization"),
    )
