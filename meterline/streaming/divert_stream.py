"""Good trips and bad lines of a stream, told apart by one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterline.operators.parse import parse_trips
from meterline.schema import TRIP_FIELDS
from meterline.streaming.hourly_stream import DEFAULT_INTERVAL, paced


def run_divert(lines: DataFrame, path: str, checkpoint: str, interval: str | None = DEFAULT_INTERVAL) -> StreamingQuery:
    """Start the job: each micro-batch is read once and written once below ``path``.

    A batch cut short is written again as a whole under its number, so each line is
    there exactly once. ``diverted`` reads both sides.
    """

    def write(batch: DataFrame, number: int) -> None:
        marked = parse_trips(batch, "keep", keep=["value"]).withColumn("bad", F.col("bad_reason").isNotNull())
        marked = marked.withColumn("value", F.when(F.col("bad"), F.col("value")))
        marked.write.mode("overwrite").partitionBy("bad").parquet(f"{path}/batch={number}")

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return paced(writer, interval).start()


def diverted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Trips, and bad lines (value, bad_reason), that ``run_divert`` has written."""
    kinds = {"time": "timestamp", "text": "string"}
    fields = ", ".join(f"{name} {kinds.get(kind, kind)}" for name, kind in TRIP_FIELDS)
    rows = spark.read.schema(f"value string, {fields}, bad_reason string, batch bigint, bad boolean").parquet(path)
    trips = rows.where("not bad").select(*[name for name, _ in TRIP_FIELDS])
    return trips, rows.where("bad").select("value", "bad_reason")
