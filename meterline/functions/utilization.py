"""Share of time a checkpointed stream spends on useful work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: one failure every ten minutes.
DEFAULT_FAILURE_RATE = 1.0 / 600.0


def utilization(
    interval_s: Column,
    checkpoint_s: Column,
    recovery_s: Column,
    failure_rate: Column | float = DEFAULT_FAILURE_RATE,
    delta: float = 0.0,
    stages: float = 0.0,
) -> Column:
    """U = l e^(dl) (T - c) / (e^(l(R + T + dn)) - e^(l(R + dn))).

    The denominator is written as e^(l(R + dn)) (e^(lT) - 1) with ``expm1``, so
    that short intervals and rare failures do not cancel.
    """
    rate = failure_rate if isinstance(failure_rate, Column) else F.lit(float(failure_rate))
    useful = rate * F.exp(rate * delta) * (interval_s - checkpoint_s)
    return useful / (F.exp(rate * (recovery_s + delta * stages)) * F.expm1(rate * interval_s))
