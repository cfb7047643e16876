"""Training samples and scoring shared by the two text classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(ids: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` ids, chosen by a hash, so the choice does not depend on order."""
    return ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        is_held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
