"""Compute a costly column once per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, name: str) -> Column:
    """A column that later filters read instead of computing it again.

    The optimizer pushes a filter on a computed column below it, and writes the
    computation out at every mention there. It does not push filters below a
    generator on its output; this one gives one row per row.
    """
    return F.explode(F.array(value)).alias(name)
