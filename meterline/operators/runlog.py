"""Run logs: checkpoint reports, metric samples, progress reports, metrics rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions import checkpoint_doc
from meterline.functions.once import once
from meterline.operators.ordered import last_known, ordered_chunks

# A metric is the first one whose name holds all its keywords.
METRIC_KEYWORDS: dict[str, tuple[str, ...]] = {
    "latency": ("fetch-latency-avg",),
    "throughput": ("numRecordsOutPerSecond", "Source"),
}

# The parts of a streaming progress report that become metrics.
PROGRESS_DDL = """
    id string, batchId bigint, timestamp string, processedRowsPerSecond double,
    durationMs struct<triggerExecution: bigint, walCommit: bigint, commitOffsets: bigint>,
    stateOperators array<struct<commitTimeMs: bigint, numRowsDroppedByWatermark: bigint>>
"""


def checkpoint_rows(reports: DataFrame, keep: Sequence[str] = (), report: str = "value"):
    """Id, status and duration of each report's latest checkpoint; null if it has none."""
    latest = reports.select(*keep, once(checkpoint_doc.latest_entry(F.col(report)), "_entry"))
    facts = latest.select(*keep, once(checkpoint_doc.entry_facts(F.col("_entry")), "_facts"))
    return facts.select(
        *keep,
        checkpoint_doc.checkpoint_id(F.col("_facts")).alias("checkpoint_id"),
        checkpoint_doc.checkpoint_status(F.col("_facts")).alias("checkpoint_status"),
        checkpoint_doc.checkpoint_duration_ms(F.col("_facts")).alias("checkpoint_duration_ms"),
    )


def pick_metrics(
    samples: DataFrame,
    poll: str = "poll_id",
    keywords: Mapping[str, Sequence[str]] = METRIC_KEYWORDS,
    all_or_none: bool = True,
) -> DataFrame:
    """One row per poll with the wanted metrics, from (poll, position, id, value) rows.

    With ``all_or_none`` a poll that lacks one metric reports none of them.
    """
    hits = {name: _has_all(F.col("id"), words) for name, words in keywords.items()}
    picked = samples.groupBy(poll).agg(
        *[
            F.min_by("value", F.when(hit, F.col("position"))).alias(name)
            for name, hit in hits.items()
        ],
        *[F.max(hit).alias(f"_has_{name}") for name, hit in hits.items()],
    )
    complete = F.lit(True)
    if all_or_none:
        for name in hits:
            complete = complete & F.col(f"_has_{name}")
    return picked.select(
        poll,
        *[
            F.when(complete, F.col(name)).try_cast("double").alias(name)
            for name in hits
        ],
    )


def _has_all(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(True)
    for word in words:
        found = found & text.contains(word)
    return found


def progress_metrics(reports: DataFrame, keep: Sequence[str] = (), report: str = "value"):
    """Streaming progress reports (JSON text) as metrics rows.

    A micro-batch is a checkpoint here: its id is the checkpoint id and its log
    commits are the checkpoint duration. A stream keeps its id over restarts from its
    checkpoint, so the id names the run. ``late_rows`` and ``state_commit_ms``
    come on top of the metrics columns.
    """
    parsed = reports.select(*keep, F.from_json(F.col(report), PROGRESS_DDL).alias("p"))
    operators = F.coalesce(F.col("p.stateOperators"), F.array())
    duration = F.col("p.durationMs")

    def total(field: str) -> Column:
        return F.aggregate(
            operators,
            F.lit(0).cast("bigint"),
            lambda sum_, operator: sum_ + F.coalesce(operator[field], F.lit(0)),
        )

    commits = F.coalesce(duration["walCommit"], F.lit(0)) + F.coalesce(
        duration["commitOffsets"], F.lit(0)
    )
    return parsed.select(
        *keep,
        F.col("p.id").alias("stream_run_id"),
        F.col("p.timestamp").try_cast("timestamp").alias("timestamp"),
        duration["triggerExecution"].cast("double").alias("Latency"),
        F.col("p.processedRowsPerSecond").alias("Throughput"),
        F.col("p.batchId").alias("CheckpointID"),
        F.when(F.col("p.batchId").isNotNull(), F.lit("COMPLETED")).alias("CheckpointStatus"),
        commits.alias("CheckpointDurationMs"),
        F.lit("RUNNING").alias("JobStatus"),
        total("numRowsDroppedByWatermark").alias("late_rows"),
        total("commitTimeMs").alias("state_commit_ms"),
    )


def report_rows(metrics: DataFrame, run_id: str = "run_id", seq: str = "seq") -> DataFrame:
    """Rows of a metrics log, or of ``progress_metrics``, under the names that the analysis reads.

    ``run_id`` and ``seq`` name the columns that tell the run and the place in it: for
    progress reports stream_run_id and CheckpointID.
    """
    return metrics.select(
        F.col(run_id).alias("run_id"),
        F.col("timestamp").alias("ts"),
        F.col(seq).alias("seq"),
        F.col("Latency").alias("latency"),
        F.col("Throughput").alias("throughput"),
        F.col("CheckpointID").alias("checkpoint_id"),
        F.col("CheckpointDurationMs").alias("checkpoint_duration_ms"),
        F.col("JobStatus").alias("job_status"),
    )


def status_rows(status: DataFrame) -> DataFrame:
    """Rows of a status log with run_id and seq as ``faults`` takes them."""
    return status.select("run_id", F.col("record_timestamp").alias("ts"), "seq", F.col("job_status").alias("status"))


def latest_checkpoint(
    polls: DataFrame, checkpoints: DataFrame, chunks: int | None = None
) -> DataFrame:
    """Each poll (run_id, ts, seq) with the newest checkpoint known by then.

    ``checkpoints`` has run_id, ts, seq, checkpoint_id and checkpoint_duration_ms;
    one of the same instant counts as known.
    """
    known = checkpoints.select(
        "run_id",
        "ts",
        F.lit(0).alias("_kind"),
        "seq",
        F.struct("checkpoint_id", "checkpoint_duration_ms").alias("_checkpoint"),
    )
    asked = polls.select(
        "run_id",
        "ts",
        F.lit(1).alias("_kind"),
        "seq",
        F.lit(None).cast(known.schema["_checkpoint"].dataType).alias("_checkpoint"),
    )
    order = ["ts", "_kind", "seq"]
    cut = ordered_chunks(known.unionByName(asked), ["run_id"], order, chunks)
    filled = last_known(cut, ["run_id"], order, F.col("_checkpoint"), "_latest")
    return filled.where(F.col("_kind") == 1).select(
        "run_id",
        "ts",
        "seq",
        F.col("_latest.checkpoint_id").alias("checkpoint_id"),
        F.col("_latest.checkpoint_duration_ms").alias("checkpoint_duration_ms"),
    )
