"""A stream that measures what it reads while it writes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterline.operators.parse import parse_trips
from meterline.streaming.hourly_stream import DEFAULT_INTERVAL, paced

MEASURED_DDL = "batch bigint, lines bigint, bad_lines bigint, latest_pickup timestamp, total_amount double"


def run_measured(lines: DataFrame, path: str, checkpoint: str, interval: str | None = DEFAULT_INTERVAL) -> StreamingQuery:
    """Write the stream's good trips below ``path/trips`` and a row of figures per micro-batch.

    The figures are gathered by the very job that writes the batch, not by a second pass
    nor from reports that a driver may lose. Trips and figures are written under the
    batch's number, so a batch cut short is replaced as a whole and counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        good = F.col("bad_reason").isNull()
        marked = parse_trips(batch, "keep").observe(
            seen,
            F.count(F.lit(1)).alias("lines"),
            F.count_if(~good).alias("bad_lines"),
            F.max(F.when(good, F.col("pickup_ts"))).alias("latest_pickup"),
            F.sum(F.when(good, F.col("total_amount"))).alias("total_amount"),
        )
        marked.where(good).drop("bad_reason").write.mode("overwrite").parquet(f"{path}/trips/batch={number}")
        found = seen.get
        row = (number, *[found[name] for name in ("lines", "bad_lines", "latest_pickup", "total_amount")])
        figures = batch.sparkSession.createDataFrame([row], MEASURED_DDL).drop("batch")
        figures.coalesce(1).write.mode("overwrite").parquet(f"{path}/measured/batch={number}")

    return paced(lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), interval).start()


def measured(spark: SparkSession, path: str) -> DataFrame:
    """One row of figures per micro-batch."""
    return spark.read.schema(MEASURED_DDL).parquet(f"{path}/measured")
