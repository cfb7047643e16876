import datetime as dt
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from meterline.functions.utilization import utilization
from meterline.operators import analysis, faults, runlog
from meterline.operators.ordered import last_known, ordered_chunks
from meterline.session import scratch_dir
from meterline.sources import sinks

T0 = dt.datetime(2023, 1, 1)
SAMPLES = "run_id long, ts timestamp, seq long, status string"


def _samples(spark, statuses, run=1, step=1):
    rows = [(run, T0 + dt.timedelta(seconds=i * step), i, s) for i, s in enumerate(statuses)]
    return spark.createDataFrame(rows, SAMPLES)


FIXTURE = ["RUNNING", "RESTARTING", "RESTARTING", None, "FAILED", "RUNNING", "RUNNING", "RESTARTING"]


def test_status_fixture(spark):
    samples = _samples(spark, FIXTURE)
    changes = faults.status_changes(samples, chunks=3).orderBy("seq").collect()
    assert [r.seq + 1 for r in changes] == [1, 2, 5, 6, 8]
    (episode,) = faults.restart_episodes(samples, chunks=3).collect()
    assert (episode.started_seq + 1, episode.ended_seq + 1, episode.duration_us) == (2, 6, 4_000_000)
    (logged,) = faults.restart_log(faults.restart_episodes(samples)).collect()
    assert logged.duration_minus_60s_seconds == -56.0


def _by_text(rows):
    """Changes and episodes of one run, read off a text of one letter per known sample."""
    known = [(seq, {"RESTARTING": "x", "RUNNING": "r"}.get(status, "o")) for _, _, seq, status in rows if status]
    text = "".join(letter for _, letter in known)
    episodes = [(known[m.start()][0], known[m.end() - 1][0]) for m in re.finditer("x[^r]*r", text)]
    runs = itertools.groupby((r for r in rows if r[3]), key=lambda r: r[3])
    return [next(own)[2] for _, own in runs], episodes


@pytest.mark.parametrize("seed, chunks", [(1, 1), (2, 7), (3, 40), (4, 300)])
def test_faults_equal_their_text_form(spark, seed, chunks):
    """Most rows in one run and on few instants; chunks smaller than an episode too."""
    rng = random.Random(seed)
    states = ["RUNNING", "RESTARTING", "FAILED", None, ""]
    rows = []
    for seq in range(600):
        run = 1 if rng.random() < 0.8 else rng.randrange(2, 6)
        ts = T0 + dt.timedelta(seconds=rng.choice([0, 1, 2, 50]))
        rows.append((run, ts, seq, rng.choices(states, [2, 2, 1, 3, 1])[0]))
    frame = spark.createDataFrame(rows, SAMPLES).repartition(5)
    want_changes, want_episodes = set(), set()
    for run in {row[0] for row in rows}:
        changes, episodes = _by_text(sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], r[2])))
        want_changes |= {(run, seq) for seq in changes}
        want_episodes |= {(run, *pair) for pair in episodes}
    got_changes = {(r.run_id, r.seq) for r in faults.status_changes(frame, chunks).collect()}
    got = faults.restart_episodes(frame, chunks).collect()
    assert got_changes == want_changes
    assert {(r.run_id, r.started_seq, r.ended_seq) for r in got} == want_episodes
    assert len(got) == len(want_episodes)


def test_hot_key_is_spread(spark):
    frame = spark.range(20000).select(F.lit(1).alias("run_id"), F.col("id").alias("seq"))
    sizes = ordered_chunks(frame, ["run_id"], ["seq"], 8).groupBy("_chunk").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 5000


def test_null_key_is_kept(spark):
    frame = spark.createDataFrame([(None, i, i if i == 0 else None) for i in range(50)], "k int, o int, v int")
    cut = ordered_chunks(frame, ["k"], ["o"], 6)
    filled = last_known(cut, ["k"], ["o"], F.col("v"), "got", current=True).collect()
    assert len(filled) == 50 and {r.got for r in filled} == {0}


@pytest.mark.parametrize("chunks", [1, 7])
def test_steady_samples(spark, chunks):
    rng = random.Random(9)
    states = [rng.choice(["RUNNING", "RESTARTING", "FAILED", None]) for _ in range(400)]
    samples = _samples(spark, states).unionByName(_samples(spark, states[::-1], run=2))
    found = faults.restart_episodes(samples)
    # A span of 100 samples over many short ones, so that the last one begun does not decide.
    long = found.where("run_id = 2").orderBy("started_at").limit(1)
    episodes = found.unionByName(long.withColumn("ended_at", F.expr("started_at + interval 100 seconds"))).checkpoint()
    spans = [(r.run_id, r.started_at, r.ended_at) for r in episodes.collect()]
    rows = samples.select("run_id", "ts", "seq", F.col("seq").alias("throughput"))
    got = {(r.run_id, r.seq) for r in faults.steady_samples(rows, episodes, chunks).collect()}
    want = {
        (r.run_id, r.seq)
        for r in rows.collect()
        if not any(run == r.run_id and start <= r.ts < end for run, start, end in spans)
    }
    assert spans and got == want and len(got) < rows.count()


def test_one_shuffle_of_full_rows(spark):
    frame = spark.range(50).selectExpr("1L run_id", "timestamp_seconds(id) ts", "id seq", "cast(id as string) status")
    plan = faults.status_changes(frame)._jdf.queryExecution().executedPlan().toString()
    # The others move the sample of the bounds and one row per run and chunk.
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("+- Window") + plan.count(":- Window") == 2
    assert "ExistingRDD" not in plan


def test_checkpoint_documents(spark):
    documents = [
        ('{"history":{"entries":[{"id":3,"status":"COMPLETED","duration":12}]}}', (3, "COMPLETED", 12)),
        (
            '{"history":[{"id":9}],"latest":{"completed":{"id":4,"status":"COMPLETED",'
            '"end_to_end_duration":778}}}',
            (4, "COMPLETED", 778),
        ),
        (
            '{"latest":{"completed":{"entries":[{"checkpointId":5,"state":"X",'
            '"trigger_timestamp":100,"latest_ack_timestamp":350}]}}}',
            (5, "X", 250),
        ),
        ('{"last":{"checkpoint_id":6,"duration":"44"}}', (6, None, 44)),
        ("{}", (None, None, None)),
        ("not json", (None, None, None)),
        ('{"history":{"entries":[{}]},"last_completed":{"id":7,"status":"C"}}', (7, "C", None)),
        # The first duration key present decides, even when it holds nothing.
        (
            '{"last":{"id":8,"duration":null,"checkpoint_duration":5,"trigger":10,"completion":30}}',
            (8, None, 20),
        ),
        ('{"last":{"id":9,"trigger":10}}', (9, None, None)),
    ]
    frame = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(documents)], "i int, value string")
    got = sorted(tuple(r) for r in runlog.checkpoint_rows(frame, ["i"]).collect())
    assert got == [(i, *want) for i, (_, want) in enumerate(documents)]


def test_metric_pick(spark):
    rows = [
        (1, 0, "numRecordsOutPerSecond", "1"),
        (1, 1, "Source_a.numRecordsOutPerSecond", "2"),
        (1, 2, "Source_b.numRecordsOutPerSecond", "3"),
        (1, 3, "x.fetch-latency-avg", "4"),
        (2, 0, "x.fetch-latency-avg", "5"),
    ]
    samples = spark.createDataFrame(rows, "poll_id int, position int, id string, value string")
    picked = {r.poll_id: (r.latency, r.throughput) for r in runlog.pick_metrics(samples).collect()}
    assert picked == {1: (4.0, 2.0), 2: (None, None)}
    loose = {r.poll_id: r.latency for r in runlog.pick_metrics(samples, all_or_none=False).collect()}
    assert loose == {1: 4.0, 2: 5.0}


def test_logs_round_trip(spark):
    schema = (
        "timestamp timestamp, Latency double, Throughput double, CheckpointID bigint, "
        "CheckpointStatus string, CheckpointDurationMs bigint, JobStatus string"
    )
    rows = [(T0, 1.5, None, 3, "COMPLETED", 12, "RUNNING"), (T0, None, 2.0, None, None, None, None)]
    frame = spark.createDataFrame(rows, schema)
    path = scratch_dir(spark, "metrics")
    sinks.append_log(sinks.render_metrics(frame), path)
    sinks.append_log(sinks.render_metrics(frame), path)
    assert sinks.read_metrics(spark, path).count() == 4
    assert sinks.read_metrics(spark, path).subtract(frame).count() == 0
    status = spark.createDataFrame([(T0, "RUNNING"), (T0, None)], "record_timestamp timestamp, job_status string")
    texts = [r.job_status for r in sinks.render_status(status).collect()]
    assert texts == ["RUNNING", "N/A (API Failed)"]
    restarts = spark.createDataFrame([(T0, 1.23456)], "record_timestamp timestamp, duration_minus_60s_seconds double")
    assert sinks.render_restarts(restarts).first()[1] == "1.2346"


def test_published_utilization(spark):
    rows = [(300, 1.218, 87.82, 66.3), (30, 0.778, 81.85, 82.9), (5, 0.597, 81.02, 76.6)]
    costs = spark.createDataFrame(
        [r[:3] for r in rows], "interval_s int, checkpoint_s double, recovery_s double"
    )
    used = {r.interval_s: r.utilization for r in analysis.with_utilization(costs).collect()}
    for interval, _, _, percent in rows:
        assert abs(used[interval] * 100 - percent) < 0.1
    assert analysis.best_interval(analysis.with_utilization(costs)).first().interval_s == 30
    # The closed form for these costs gives 38.64, 30.82 and 26.97 seconds.
    found = {r.interval_s: r.best_interval_s for r in analysis.best_interval_exact(costs).collect()}
    assert {k: round(v, 6) for k, v in found.items()} == {300: 38.641226, 30: 30.816418, 5: 26.966138}
    long = spark.createDataFrame([(1, 100.0, 0.0), (2, 0.0, 0.0)], costs.schema)
    first, none = analysis.best_interval_exact(long, 1 / 6000).orderBy("interval_s").collect()
    assert round(first.best_interval_s, 6) == 1129.817708 and none.best_interval_s is None


def test_an_interval_without_restarts_has_costs(spark):
    means = spark.createDataFrame([(5, 100.0), (30, 200.0)], "interval_s int, avg_checkpoint_ms double")
    restarts = spark.createDataFrame([(5, 80.0)], "interval_s int, avg_restart_s double")
    costs = {r.interval_s: r.recovery_s for r in analysis.interval_costs(means, restarts).collect()}
    assert costs == {5: 80.0, 30: 0.0}


def test_utilization_is_stable_for_rare_failures(spark):
    value = utilization(F.lit(30.0), F.lit(0.0), F.lit(0.0), 1e-12)
    assert abs(spark.range(1).select(value).first()[0] - 1.0) < 1e-9


def test_logs_with_runs_read_back(spark):
    """Columns beyond the known ones come back by name; undeclared ones are an error."""
    row = (7, 30, T0, 1.5, 2.5, 4, "COMPLETED", 12, "RUNNING")
    kinds = "run_id long, interval_s int, timestamp timestamp, Latency double, Throughput double, CheckpointID long, CheckpointStatus string, CheckpointDurationMs long, JobStatus string"
    path = scratch_dir(spark, "metrics")
    sinks.append_log(sinks.render_metrics(spark.createDataFrame([row], kinds)), path)
    assert tuple(sinks.read_metrics(spark, path, "run_id long, interval_s int").select(*[k.split()[0] for k in kinds.split(", ")]).first()) == row
    with pytest.raises(Exception, match="header"):
        sinks.read_metrics(spark, path).collect()
    path = scratch_dir(spark, "restarts")
    log = faults.restart_log(faults.restart_episodes(_samples(spark, FIXTURE)))
    sinks.append_log(sinks.render_restarts(log), path)
    assert sinks.read_restarts(spark, path, "run_id long").collect() == log.select("record_timestamp", "duration_minus_60s_seconds", "run_id").collect()
