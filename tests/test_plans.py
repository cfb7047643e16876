import datetime as dt
import os

from pyspark.sql import functions as F

from meterline import __main__ as cli
from meterline.plans.report import interval_report
from meterline.session import scratch_dir
from tests.test_prep_replay import HEADER, LINES

T0 = dt.datetime(2023, 1, 1)


def _file(spark, name, lines):
    folder = scratch_dir(spark, "files").removeprefix("file:")
    os.makedirs(folder)
    path = os.path.join(folder, name)
    with open(path, "w") as out:
        out.write("\n".join(lines) + "\n")
    return path


def test_prepare_and_peek(spark, capsys):
    path = _file(spark, "trips.csv", [",".join(HEADER), *LINES])
    cli.main(["prepare", path])
    target = capsys.readouterr().out.strip()
    assert target == path.replace("trips.csv", "trips.sorted.csv")
    cli.main(["peek", target])
    assert capsys.readouterr().out.splitlines() == [LINES[i] for i in (2, 7, 3, 4, 1)]


def _trip(time, zone, amount):
    return f"1,{time},{time},1,1,1,N,{zone},1,1,1,0,0,0,0,0,{amount},0,0"


def test_hourly_stage_and_stream(spark):
    header = "VendorID,tpep_pickup_datetime,tpep_dropoff_datetime"
    times = [T0 + dt.timedelta(minutes=11 * i) for i in range(40)]
    path = _file(spark, "trips.csv", [header, *[_trip(t, 1 + i % 3, 2.5) for i, t in enumerate(times)]])
    base = os.path.dirname(path)
    cli.main(["hourly", path, f"{base}/lines"])
    cli.main(["hourly", path, f"{base}/table", "--table"])
    lines = {r.value for r in spark.read.text(f"{base}/lines").collect()}
    assert len(lines) == spark.read.parquet(f"{base}/table").count() == 22
    cli.main(["stage", path, f"{base}/steps", "--timerate", "36000"])
    cli.main(["stream", f"{base}/steps/tick=*", f"{base}/out", f"{base}/log", "--drain"])
    streamed = {r.value for r in spark.read.text(f"{base}/out").collect()}
    assert len(streamed) == 21 and streamed < lines


def test_interval_report(spark):
    states = ["RUNNING"] * 5 + ["RESTARTING"] * 90 + ["RUNNING"] * 5
    rows = [
        (run, T0 + dt.timedelta(seconds=i), i, status, float(i % 7), 100.0 + run, i // 10, 700 + i // 10)
        for run in (1, 2)
        for i, status in enumerate(states)
    ]
    frame = spark.createDataFrame(
        rows,
        "run_id int, ts timestamp, seq int, status string, latency double, throughput double, "
        "checkpoint_id int, checkpoint_duration_ms int",
    )
    runs = spark.createDataFrame([(1, 5), (2, 30)], "run_id int, interval_s int")
    report = {
        r.interval_s: r
        for r in interval_report(frame.drop("status"), frame.select("run_id", "ts", "seq", "status"), runs).collect()
    }
    assert set(report) == {5, 30}
    row = report[30]
    assert (row.restarts, row.avg_restart_s, row.checkpoints) == (1, 30.0, 10)
    assert (row.steady_throughput, row.latency_spread, row.avg_checkpoint_ms) == (102.0, 6.0, 704.5)
    assert 0 < row.utilization < 1


def test_hourly_plan(spark):
    """Three fields are read, partial sums come before the only shuffle, no Python."""
    from meterline.operators.hourly import hourly_income
    from meterline.operators.parse import parse_trips

    lines = spark.range(10).select(F.col("id").cast("string").alias("value"))
    plan = hourly_income(parse_trips(lines, "drop"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2
    assert "Python" not in plan and "airport" not in plan and "_cast_10" not in plan
