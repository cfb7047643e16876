"""Merging the small files of an appended log, safe against a crash at any point.

A log is a folder that writers append part files to. A merge writes its file under
``_merged/<n>`` and then ``_manifest/<n>``, the names of the part files it stands for.
A manifest counts once it is complete; till then readers take the parts, afterwards the
merged files of the last manifest and the parts that it does not name. So a crash
before the manifest leaves a folder nobody reads, and one after it, parts that nobody
reads; ``compact`` removes both the next time.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from meterline.sources.lines import csv_header, read_csv_strings

_PARTS = "path string"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str, files: bool) -> list[str]:
    """Names in a folder: its data files, or else its sub-folders; none if it is not there."""
    place, system = _folder(spark, path)
    if not system.exists(place):
        return []
    found = [status for status in system.listStatus(place) if status.isFile() == files]
    names = [status.getPath().getName() for status in found]
    return sorted(name for name in names if not files or not name.startswith(("_", ".")))


def _delete(spark: SparkSession, path: str) -> None:
    place, system = _folder(spark, path)
    system.delete(place, True)


def _last(spark: SparkSession, path: str) -> int | None:
    """The number of the last complete manifest."""
    done = []
    for name in _names(spark, f"{path}/_manifest", files=False):
        place, system = _folder(spark, f"{path}/_manifest/{name}/_SUCCESS")
        if system.exists(place):
            done.append(int(name))
    return max(done, default=None)


def _replaced(spark: SparkSession, path: str, number: int) -> set[str]:
    return {row.path for row in spark.read.schema(_PARTS).json(f"{path}/_manifest/{number}").toLocalIterator()}


def _live(spark: SparkSession, path: str, number: int | None) -> tuple[list[str], list[str]]:
    """Merged files of a manifest, and the parts it does not stand for."""
    parts = _names(spark, path, files=True)
    if number is None:
        return [], parts
    replaced = _replaced(spark, path, number)
    merged = [f"{path}/_merged/{number}/{name}" for name in _names(spark, f"{path}/_merged/{number}", files=True)]
    return merged, [name for name in parts if name not in replaced]


def live_files(spark: SparkSession, path: str) -> list[str]:
    """The files that make up a log that was merged; none for one that never was."""
    number = _last(spark, path)
    if number is None:
        return []
    merged, parts = _live(spark, path, number)
    return merged + [f"{path}/{name}" for name in parts]


def compact(spark: SparkSession, path: str, min_files: int = 2, max_bytes: int = 128 << 20, keep_replaced: bool = False) -> int:
    """Merge a CSV log's files into as few as their bytes ask for; returns how many were merged.

    Nothing is done for fewer than ``min_files`` files. Rows keep their texts and each
    file its header. One merge runs at a time; appends may go on meanwhile, as the parts
    to replace are named before they are read. Parts named by the manifest are removed at
    the end, or with ``keep_replaced`` by the next merge, when no reader that began
    before can still want them.
    """
    number = _last(spark, path)
    merged, parts = _live(spark, path, number)
    _sweep(spark, path, number)
    files = merged + [f"{path}/{name}" for name in parts]
    if len(files) < max(min_files, 2):
        return 0
    rows = read_csv_strings(spark, files, csv_header(spark, files[0]))
    size = sum(_size(spark, file) for file in files)
    following = (number or 0) + 1
    rows.coalesce(max(1, -(-size // max_bytes))).write.mode("overwrite").option("header", True).csv(f"{path}/_merged/{following}")
    spark.createDataFrame([(name,) for name in parts], _PARTS).coalesce(1).write.mode("overwrite").json(f"{path}/_manifest/{following}")
    if not keep_replaced:
        _sweep(spark, path, following)
    return len(files)


def _size(spark: SparkSession, file: str) -> int:
    place, system = _folder(spark, file)
    return system.getFileStatus(place).getLen()


def _sweep(spark: SparkSession, path: str, number: int | None) -> None:
    """Remove what no reader takes: replaced parts, older merges, merges without a manifest."""
    if number is not None:
        for name in _replaced(spark, path, number):
            _delete(spark, f"{path}/{name}")
    for folder in ("_manifest", "_merged"):
        for name in _names(spark, f"{path}/{folder}", files=False):
            if name != str(number):
                _delete(spark, f"{path}/{folder}/{name}")
