"""The report on a series of runs: what each checkpoint interval cost."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterline.functions.utilization import DEFAULT_FAILURE_RATE
from meterline.operators import analysis, faults


def interval_report(
    metrics: DataFrame,
    samples: DataFrame,
    runs: DataFrame,
    failure_rate: float = DEFAULT_FAILURE_RATE,
) -> DataFrame:
    """One row per interval: figures, steady throughput, restarts, utilization.

    ``metrics`` and ``samples`` carry run_id; ``runs`` names each run's interval_s.
    """
    episodes = faults.restart_episodes(samples).join(runs, "run_id").checkpoint()
    measured = metrics.join(runs, "run_id")
    by_interval = analysis.metrics_by_interval(measured)
    restarts = analysis.restart_by_interval(episodes)
    steady = (
        faults.steady_samples(measured, episodes)
        .groupBy("interval_s")
        .agg({"throughput": "avg"})
        .withColumnRenamed("avg(throughput)", "steady_throughput")
    )
    # One row per interval from here on.
    costs = analysis.with_utilization(analysis.interval_costs(by_interval, restarts), failure_rate)
    return (
        by_interval.join(steady, "interval_s", "left")
        .join(restarts, "interval_s", "left")
        .join(costs.select("interval_s", "utilization"), "interval_s", "left")
    )
