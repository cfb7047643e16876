"""Job status samples: changes, restart episodes, samples outside of them.

Samples have run_id, ts, seq and status; (ts, seq) orders a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.operators.ordered import greatest_before, last_known, ordered_chunks

# Fixed values.
RESTARTING = "RESTARTING"
RUNNING = "RUNNING"
RESTART_DELAY_S = 60.0

_ORDER = ["ts", "seq"]


def status_changes(samples: DataFrame, chunks: int | None = None) -> DataFrame:
    """Samples whose status differs from the last known one; a run's first counts."""
    known = samples.select("run_id", *_ORDER, "status").where(
        F.col("status").isNotNull() & (F.col("status") != "")
    )
    cut = ordered_chunks(known, ["run_id"], _ORDER, chunks)
    compared = last_known(cut, ["run_id"], _ORDER, F.col("status"), "previous_status")
    changed = ~F.col("status").eqNullSafe(F.col("previous_status"))
    return compared.where(changed).select("run_id", *_ORDER, "status", "previous_status")


def restart_episodes(samples: DataFrame, chunks: int | None = None) -> DataFrame:
    """From each first RESTARTING to the next RUNNING of a run.

    Other samples in between mean nothing, and an episode still open at the end
    is not reported.
    """
    ends = samples.select("run_id", *_ORDER, "status").where(
        F.col("status").isin(RESTARTING, RUNNING)
    )
    cut = ordered_chunks(ends, ["run_id"], _ORDER, chunks)
    compared = last_known(cut, ["run_id"], _ORDER, F.col("status"), "_before")
    opens = (F.col("status") == RESTARTING) & ~F.col("_before").eqNullSafe(F.lit(RESTARTING))
    closes = (F.col("status") == RUNNING) & F.col("_before").eqNullSafe(F.lit(RESTARTING))
    edges = compared.where(opens | closes).drop("_before")
    # Openings and closings alternate, so a closing belongs to the edge before it.
    opening = F.when(F.col("status") == RESTARTING, F.struct("ts", "seq"))
    paired = last_known(edges, ["run_id"], _ORDER, opening, "_opened", is_placed=True)
    return paired.where(F.col("status") == RUNNING).select(
        "run_id",
        F.col("_opened.ts").alias("started_at"),
        F.col("_opened.seq").alias("started_seq"),
        F.col("ts").alias("ended_at"),
        F.col("seq").alias("ended_seq"),
        (F.unix_micros("ts") - F.unix_micros("_opened.ts")).alias("duration_us"),
    )


def restart_log(episodes: DataFrame) -> DataFrame:
    """Episodes as restart-log rows: seconds beyond the fixed restart delay."""
    return episodes.select(
        "run_id",
        F.col("ended_at").alias("record_timestamp"),
        (F.col("duration_us") / 1e6 - RESTART_DELAY_S).alias("duration_minus_60s_seconds"),
    )


def steady_samples(metrics: DataFrame, episodes: DataFrame, chunks: int | None = None) -> DataFrame:
    """Metrics rows (with run_id, ts, seq) outside every episode ``[started, ended)``.

    Metrics and episode starts are walked in time order: a row is inside one if any
    episode that began by then ends later, so the latest end so far decides, also
    where episodes overlap. A row without a time is in none.
    """
    rows = metrics.select(
        "run_id",
        "ts",
        F.lit(1).alias("_kind"),
        "seq",
        F.struct(*metrics.columns).alias("_row"),
        F.lit(None).cast("timestamp").alias("_ends"),
    )
    starts = episodes.select(
        "run_id",
        F.col("started_at").alias("ts"),
        F.lit(0).alias("_kind"),
        F.col("started_seq").alias("seq"),
        F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"),
        F.col("ended_at").alias("_ends"),
    )
    order = ["ts", "_kind", "seq"]
    cut = ordered_chunks(rows.unionByName(starts), ["run_id"], order, chunks)
    walked = greatest_before(cut, ["run_id"], order, F.col("_ends"), "_busy_until")
    free = F.col("_busy_until").isNull() | (F.col("ts") >= F.col("_busy_until"))
    return walked.where((F.col("_kind") == 1) & free).select("_row.*")
