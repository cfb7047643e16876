"""Tables written to the shared folder to cut lineage, and removed when spent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterline.session import scratch_dir


class Scratch:
    """Written tables under ``spark.checkpoint.dir``: they outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = scratch_dir(spark, label)
        self.made = 0
        self.paths: dict[int, tuple[str, DataFrame]] = {}

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and read it back; what is built on it starts from files."""
        path = f"{self.folder}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(written)] = (path, written)
        return written

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove the files of tables written here that nothing later reads."""
        for path in [self.paths.pop(id(df))[0] for df in tables if id(df) in self.paths]:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
