"""Lines kept as they are, files rolled by bytes, figures of a stream, merged logs."""

import os
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import meterline.sources.compaction as compaction
from meterline.operators import prep
from meterline.operators.ordered import global_rank
from meterline.plans.trips import prepare_file, stage_file
from meterline.session import scratch_dir
from meterline.sources import lines as sources
from meterline.sources import sinks
from meterline.streaming.hourly_stream import run_rolled_lines
from meterline.streaming.measured_stream import measured, run_measured
from tests.test_streaming import _line, _write

HEADER = "VendorID,tpep_pickup_datetime,tpep_dropoff_datetime,rest"
ODD = ["a\u0001b", "\u0000c", '"quoted, twice" ""', "back\\slash", "  spaces ", "é漢🙂", "x,,,"]


def _local(path):
    return path.removeprefix("file:")


def test_sorted_lines_keep_every_character(spark):
    lines = [f"{i},2023-02-01 00:00:00,2023-02-01 00:{59 - i:02}:00,{odd}" for i, odd in enumerate(ODD)]
    frame = spark.createDataFrame(list(enumerate(lines)), "n long, value string").repartition(4)
    path = scratch_dir(spark, "sorted")
    prep.sorted_lines(prep.keyed_lines(frame, HEADER.split(",")), HEADER, ["n"]).write.text(path)
    files = sorted(Path(_local(path)).glob("part-*"))
    assert b"".join(f.read_bytes() for f in files) == "".join(f"{x}\n" for x in [HEADER, *reversed(lines)]).encode()
    ranked = global_rank(sources.numbered_text(spark, path), ["file", "block", "pos"], "line_no")
    assert [r.value for r in ranked.orderBy("line_no").collect()] == [HEADER, *reversed(lines)]


def test_prepared_file_has_one_header(spark, tmp_path):
    rows = [_line(f"2023-01-01 00:{i:02}:00", 1, i) for i in (5, 3, 9)] + ["", "short", _line("2022-12-31 00:00:00", 1, 1)]
    (tmp_path / "t.csv").write_text("\n".join([HEADER, *rows]) + "\n")
    out = prepare_file(spark, str(tmp_path / "t.csv"))
    assert "".join(f.read_text() for f in sorted(Path(out).glob("part-*"))).splitlines() == [HEADER, rows[1], rows[0], rows[2]]
    stage_file(spark, str(tmp_path / "t.csv"), f"{out}.steps")
    assert spark.read.parquet(f"{out}.steps").count() == 4


@pytest.fixture
def placed(spark, tmp_path):
    """Files with a header, without one, with one in the middle, with a blank first line."""
    data = [f"{i},2023-01-01 00:00:00,x,pad{'.' * 300}" for i in range(40)]
    files = {"a": [HEADER, *data], "b": data, "c": [*data[:20], HEADER, *data[20:]], "d": [f" {HEADER}\t", HEADER], "e": ["", HEADER], "f": [HEADER]}
    for i, (name, rows) in enumerate(files.items()):
        (tmp_path / f"{name}.txt").write_text("\n".join(rows) + "\n")
        os.utime(tmp_path / f"{name}.txt", (1_600_000_000 + i, 1_600_000_000 + i))
    return str(tmp_path), sorted(data * 3 + [HEADER] * 3)


@pytest.mark.parametrize("header", [None, HEADER])
def test_headers_by_place(spark, placed, header):
    """Also where a file is cut into many splits, and several files are read by one task."""
    path, want = placed
    for size in ("1000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            rows = sources.read_lines(spark, path, header, by_place=True)
            numbered = sources.read_lines(spark, path, header, numbered=True, by_place=True)
            assert sorted(r.value for r in rows.collect()) == want
            assert numbered.columns == ["value", "file", "block", "pos"]
            assert sorted(r.value for r in numbered.collect()) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_headers_by_place_on_a_stream(spark, placed):
    path, want = placed
    out = scratch_dir(spark, "out")
    lines = sources.stream_lines(spark, path, max_files=2, by_place=True)
    lines.writeStream.format("text").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.value for r in spark.read.text(out).collect()) == want


def test_rolled_files(spark):
    lines = [f"{i:05}" for i in range(1000)] + ["é" * 400]
    path = scratch_dir(spark, "rolled")
    frame = spark.createDataFrame([(x,) for x in lines], "value string").repartition(3)
    for limit, files in ((700, None), (1 << 20, 1)):
        sinks.write_rolled(frame, path, limit)
        sizes = {f: f.stat().st_size for f in Path(_local(path)).glob("part-*")}
        assert files in (None, len(sizes)) and len(sizes) >= 6801 // limit
        # the one line that is longer has a file to itself
        assert sum(size > limit for size in sizes.values()) == (limit == 700)
        assert sorted(r.value for r in spark.read.text(path).collect()) == lines
    sinks.write_rolled(frame.limit(0), f"{path}-none", 10)
    assert not os.path.exists(_local(f"{path}-none"))


def test_rolled_stream_writes_a_batch_again_in_place(spark, monkeypatch):
    source, out, log = (scratch_dir(spark, name) for name in ("in", "out", "log"))
    _write(source, "0.txt", [("00:10:00", z, 1) for z in range(60)] + [("05:00:00", 1, 1)])
    import meterline.streaming.hourly_stream as hourly_stream

    calls = []

    def broken(lines, path, limit):
        sinks.write_rolled(lines, path, limit)
        calls.append(path)
        if lines.sparkSession.read.text(path).count() if os.path.exists(_local(path)) else 0:
            if len(calls) < 4:
                raise RuntimeError("lost after the files were written")

    monkeypatch.setattr(hourly_stream, "write_rolled", broken)
    for _ in range(4):
        try:
            run_rolled_lines(sources.stream_lines(spark, source), out, log, interval=None, max_bytes=1000).awaitTermination()
            break
        except StreamingQueryException:
            pass
    assert len(calls) > len(set(calls))
    assert spark.read.text(out).count() == 60
    assert all(f.stat().st_size <= 1000 for f in Path(_local(out)).glob("batch=*/part-*"))


def test_figures_of_a_stream(spark):
    source, out, log = (scratch_dir(spark, name) for name in ("in", "out", "log"))
    _write(source, "0.txt", [("00:10:00", 1, 2.5), ("00:nonsense", 1, 9)])
    _write(source, "1.txt", [("03:nonsense", 1, 9)])
    run_measured(sources.stream_lines(spark, source, max_files=1), out, log, interval=None).awaitTermination()
    rows = measured(spark, out).orderBy("batch").collect()
    assert [(r.batch, r.lines, r.bad_lines, r.latest_pickup and r.latest_pickup.hour, r.total_amount) for r in rows] == [(0, 2, 1, 0, 2.5), (1, 1, 1, None, None)]
    assert spark.read.parquet(f"{out}/trips").count() == 1


@pytest.fixture
def log(spark):
    path = scratch_dir(spark, "log")
    rows = spark.createDataFrame([(f"2023-01-01 00:00:{i:02}.000000", f"{i}" + ("" if i % 3 else ', "x" \\')) for i in range(30)], "record_timestamp string, job_status string")
    for part in range(6):
        sinks.append_log(rows.where(f"cast(substr(record_timestamp, 18, 2) as int) % 6 = {part}").coalesce(1), path)
    return path, rows


def _content(spark, path):
    return sorted((str(r.record_timestamp), r.job_status) for r in sinks.read_status(spark, path).collect())


def _files(path):
    return [f for f in Path(_local(path)).rglob("part-*") if "_manifest" not in f.parts]


def test_a_merged_log_reads_as_before(spark, log):
    path, rows = log
    before = _content(spark, path)
    assert len(before) == 30 and len(_files(path)) == 6
    assert compaction.compact(spark, path, min_files=7) == 0
    assert compaction.compact(spark, path) == 6
    assert len(_files(path)) == 1 and _content(spark, path) == before
    sinks.append_log(rows, path)
    assert compaction.compact(spark, path, max_bytes=200) > 1
    assert _content(spark, path) == sorted(before * 2)
    assert compaction.compact(spark, path, keep_replaced=True) == 0 or _content(spark, path) == sorted(before * 2)


def test_a_merge_cut_short_changes_nothing(spark, log, monkeypatch):
    """Lost before the manifest, in the middle of it, and after it before anything was removed."""
    path, rows = log
    before = _content(spark, path)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(type(spark), "createDataFrame", lost)
        with pytest.raises(RuntimeError):
            compaction.compact(spark, path)
    assert len(_files(path)) == 7 and _content(spark, path) == before
    os.makedirs(f"{_local(path)}/_manifest/1/_temporary/0")
    assert _content(spark, path) == before
    assert compaction.compact(spark, path, keep_replaced=True) == 6
    assert len(_files(path)) == 7 and _content(spark, path) == before
    sinks.append_log(rows.limit(1), path)
    assert len(_content(spark, path)) == 31
    assert compaction.compact(spark, path) == 2
    assert len(_files(path)) == 1 and len(_content(spark, path)) == 31


def test_merging_an_empty_or_absent_log(spark):
    path = scratch_dir(spark, "log")
    assert compaction.compact(spark, path) == 0 and compaction.live_files(spark, path) == []
