"""What the checkpoint interval costs: means per interval and the best interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.utilization import DEFAULT_FAILURE_RATE, utilization
from meterline.operators.faults import RESTART_DELAY_S

NEWTON_STEPS = 6


def metrics_by_interval(metrics: DataFrame) -> DataFrame:
    """Means, peaks and spreads per interval, from one pass over the metrics.

    Every poll repeats the checkpoint known then, so durations are first reduced
    to one per checkpoint (the longest reported: a running one still grows). The
    other figures ride along as partial sums, rows without a checkpoint included.
    """
    per_checkpoint = metrics.groupBy("interval_s", "run_id", "checkpoint_id").agg(
        F.count("throughput").alias("n_throughput"),
        F.sum("throughput").alias("sum_throughput"),
        F.max("throughput").alias("max_throughput"),
        F.count("latency").alias("n_latency"),
        F.sum("latency").alias("sum_latency"),
        F.max("latency").alias("max_latency"),
        F.min("latency").alias("min_latency"),
        F.max("checkpoint_duration_ms").alias("duration_ms"),
    )
    duration = F.when(F.col("checkpoint_id").isNotNull(), F.col("duration_ms"))
    return per_checkpoint.groupBy("interval_s").agg(
        _mean("throughput").alias("avg_throughput"),
        F.max("max_throughput").alias("peak_throughput"),
        _mean("latency").alias("avg_latency"),
        (F.max("max_latency") - F.min("min_latency")).alias("latency_spread"),
        F.count(duration).alias("checkpoints"),
        F.avg(duration).alias("avg_checkpoint_ms"),
        F.stddev_samp(duration).alias("stddev_checkpoint_ms"),
    )


def _mean(name: str) -> Column:
    rows = F.sum(f"n_{name}")
    return F.sum(f"sum_{name}").cast("double") / F.when(rows > 0, rows)


def restart_by_interval(episodes: DataFrame) -> DataFrame:
    """Mean restart time per interval, beyond the fixed restart delay."""
    return episodes.groupBy("interval_s").agg(
        F.count("*").alias("restarts"),
        (F.sum("duration_us") / F.count("duration_us") / 1e6 - RESTART_DELAY_S).alias(
            "avg_restart_s"
        ),
    )


def interval_costs(by_interval: DataFrame, restarts: DataFrame) -> DataFrame:
    """Checkpoint and recovery cost in seconds of each interval; none to recover without a restart."""
    return by_interval.join(restarts, "interval_s", "left").select(
        "interval_s",
        (F.col("avg_checkpoint_ms") / 1000.0).alias("checkpoint_s"),
        F.coalesce("avg_restart_s", F.lit(0.0)).alias("recovery_s"),
    )


def with_utilization(
    costs: DataFrame,
    failure_rate: float = DEFAULT_FAILURE_RATE,
    delta: float = 0.0,
    stages: float = 0.0,
) -> DataFrame:
    return costs.withColumn(
        "utilization",
        utilization(
            F.col("interval_s").cast("double"),
            F.col("checkpoint_s"),
            F.col("recovery_s"),
            failure_rate,
            delta,
            stages,
        ),
    )


def best_interval(costed: DataFrame) -> DataFrame:
    """The measured interval with the greatest utilization (the shortest of equals)."""
    best = F.max(
        F.struct(
            F.col("utilization").alias("u"),
            (-F.col("interval_s")).alias("minus_interval"),
        )
    )
    return costed.where(~F.isnan("utilization")).agg(best.alias("best")).select(
        (-F.col("best.minus_interval")).alias("interval_s"),
        F.col("best.u").alias("utilization"),
    )


def best_interval_exact(
    costs: DataFrame, failure_rate: float = DEFAULT_FAILURE_RATE, delta: float = 0.0, stages: float = 0.0
) -> DataFrame:
    """For each row of costs, the interval that utilizes best, at any length.

    With y the interval times the failure rate and a the checkpoint cost times it, the
    optimum solves y - a = 1 - exp(-y). Newton steps from sqrt(2a) settle in a few
    plain columns. Without a positive checkpoint cost there is no optimum (null).
    """
    found = costs.withColumn("_a", F.col("checkpoint_s") * F.lit(failure_rate))
    found = found.withColumn("_y", F.when(F.col("_a") > 0, F.sqrt(2 * F.col("_a"))))
    for _ in range(NEWTON_STEPS):
        y = F.col("_y")
        found = found.withColumn("_y", y + (y - F.col("_a") + F.expm1(-y)) / F.expm1(-y))
    interval = F.col("_y") / F.lit(failure_rate)
    use = utilization(interval, F.col("checkpoint_s"), F.col("recovery_s"), failure_rate, delta, stages)
    return found.select(*costs.columns, interval.alias("best_interval_s"), use.alias("best_utilization"))
