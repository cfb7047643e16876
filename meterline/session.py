"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Event times are read and printed in UTC.
SQL_CONF = {"spark.sql.session.timeZone": "UTC"}

STATE_STORE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app: str = "meterline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, RocksDB state)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        # Recording the call site of every column expression slows down building plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **SQL_CONF,
        **STATE_STORE_CONF,
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators rely on to an existing session."""
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)
    return spark


def use_rocksdb(spark: SparkSession) -> SparkSession:
    """Keep streaming state in RocksDB with incremental (changelog) checkpoints."""
    for key, value in STATE_STORE_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder ``DataFrame.checkpoint`` writes to, set from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, in local mode only:
    on a cluster every executor has to reach the folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="meterline-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers it is not installed on."""
    context = spark.sparkContext
    if getattr(context, "_meterline_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="meterline-package-")
    archive = shutil.make_archive(
        os.path.join(folder, "meterline"), "zip", os.path.dirname(package), "meterline"
    )
    context.addPyFile(archive)
    context._meterline_shipped = True
