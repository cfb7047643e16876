"""What a query's checkpoint holds, as tables: open windows, batches, late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.operators.hourly import DEFAULT_WIDTH
from meterline.operators.parse import counted_trips
from meterline.sources.lines import data_lines

# The sums that the state store keeps for hourly income, plain and in exact cents.
_PLAIN = "struct<trips: bigint, plain: double>"
_CENTS = "struct<trips: bigint, beyond: bigint, cents: decimal(28,2), no_cents: boolean, plain: double>"


def open_windows(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """Windows that the hourly job has not given out yet, with what they count so far.

    Read from the state store as the last (or the given) committed micro-batch left it,
    one task per state partition, without starting the query.
    """
    reader = spark.read.format("statestore")
    if batch is not None:
        reader = reader.option("batchId", batch)
    state = reader.load(checkpoint)
    fields = len(state.schema["value"].dataType.fields)
    if fields not in (2, 5):
        raise ValueError("this is not the state of hourly income")
    # Fields of one name can't be told by it, so the struct is read by position.
    sums = state.select("key", F.col("value").cast(_PLAIN if fields == 2 else _CENTS).alias("v"))
    total = F.col("v.plain")
    if fields == 5:
        cents = F.when(~F.col("v.no_cents"), F.col("v.cents")).cast("double")
        total = F.when(F.col("v.beyond") == 0, cents).otherwise(total)
    return sums.select(
        "key.pu_location_id",
        F.col("key.window.start").alias("window_start"),
        F.col("key.window.end").alias("window_end"),
        F.col("v.trips").alias("trip_count"),
        total.alias("total_income"),
    )


def batches(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Committed micro-batches: batch, planned_at, watermark, late_until, offsets, reads_new.

    ``watermark`` closes windows in a batch; rows whose window ends by ``late_until``, the
    watermark of the batch before, are dropped there. ``offsets`` has the sources' ends;
    ``reads_new`` is false for batches that only give out windows. One small file per batch
    is read; Spark keeps the last ``spark.sql.streaming.minBatchesToRetain`` of them.
    """
    name = F.col("_metadata.file_name").cast("bigint").alias("batch")
    lines = spark.read.text(f"{checkpoint}/offsets").select(name, F.struct(F.monotonically_increasing_id().alias("pos"), "value").alias("line"))
    # A version, facts about the batch, then a line for each source.
    texts = F.transform(F.sort_array(F.collect_list("line")), lambda line: line["value"])
    planned = lines.groupBy("batch").agg(texts.alias("lines"))
    done = spark.read.text(f"{checkpoint}/commits").select(name).distinct()
    fact = lambda key: F.timestamp_millis(F.get_json_object(F.get("lines", F.lit(1)), f"$.{key}").cast("bigint"))
    facts = planned.join(done, "batch", "left_semi").select(
        "batch",
        fact("batchTimestampMs").alias("planned_at"),
        fact("batchWatermarkMs").alias("watermark"),
        F.expr("slice(lines, 3, size(lines))").alias("offsets"),
    )
    earlier = facts.select((F.col("batch") + 1).alias("batch"), F.col("watermark").alias("late_until"), F.col("offsets").alias("_before"))
    return facts.join(earlier, "batch", "left").select(
        "batch", "planned_at", "watermark", "late_until", "offsets", (~F.col("offsets").eqNullSafe(F.col("_before"))).alias("reads_new")
    )


def batch_files(spark: SparkSession, checkpoint: str, source: int = 0) -> DataFrame:
    """(path, batch): the files each micro-batch of a file stream has read.

    A file source counts steps of its own; a batch takes those up to its offset.
    """
    end = F.coalesce(F.get_json_object(F.get("offsets", F.lit(source)), "$.logOffset").cast("bigint"), F.lit(-1))
    ends = batches(spark, checkpoint).select("batch", end.alias("end"))
    # The first batch that reaches a step took it; later ones that read nothing end there too.
    reached = ends.groupBy("end").agg(F.min("batch").alias("batch"))
    before = F.lag("end", 1, -1).over(Window.orderBy("end"))  # one row per batch in the log
    steps = reached.withColumn("start", before).where("end > start").select("batch", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("step"))
    log = spark.read.text(f"{checkpoint}/sources/{source}").where(F.col("value").startswith("{"))
    found = log.select(F.from_json("value", "path string, batchId bigint").alias("f"))
    # Compacted logs repeat what they replace.
    files = found.select(_one_spelling(F.col("f.path")).alias("path"), F.col("f.batchId").alias("step")).distinct()
    return files.join(steps, "step").select("path", "batch")


def _one_spelling(path: Column) -> Column:
    """Logs write an empty host as ``file:///``, file metadata as ``file:/``."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def judged_rows(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    bad: str = "failfast",
    width: str = DEFAULT_WIDTH,
    since: int = 0,
    source: int = 0,
    header: str | None = None,
) -> DataFrame:
    """Trips that a text stream over ``path`` has read, with ``batch`` and ``late``.

    Late rows are those the job has dropped: their window had ended by the watermark
    that held for their batch, taken from the query's own log, so each row is judged as the
    job judged it. ``bad``, ``width`` and ``header`` are those of the job. Batches from
    ``since`` on are taken; it is an error if the log does not go back that far.
    """
    known = batches(spark, checkpoint).select("batch", "late_until")
    oldest = known.agg(F.min("batch")).first()[0]
    if oldest is None or oldest > max(since - 1, 0):
        raise ValueError(f"the log begins at batch {oldest}; batches from {since} on can't all be judged")
    text = spark.read.text(path).select("value", _one_spelling(F.col("_metadata.file_path")).alias("path"))
    read = text.join(batch_files(spark, checkpoint, source).where(F.col("batch") >= since), "path")
    trips = counted_trips(data_lines(read.select("value", "batch"), header), bad, keep=["batch"])
    ends = F.window("pickup_ts", width)["end"]
    judged = trips.withColumn("_end", ends).join(known, "batch")
    return judged.withColumn("late", F.coalesce(F.col("_end") <= F.col("late_until"), F.lit(False))).drop("_end", "late_until")
