"""Bucket rows packed by parts of the keys, and wanted lines cut by their numbers."""

import numpy as np
import pyarrow as pa

from meterline.llm.lines import _cut_lines, _packed, _pick, _shared, _signatures, read_lines
from meterline.llm.neardup import OnePermutation
from meterline.llm.words import SPACED, WordReader


def _rows(tasks, parts):
    return [batch for held in tasks for batch in _packed([tuple(np.array(x, np.int64) for x in held)], parts)]


def test_packed_rows_give_the_shared_keys(spark, scratch):
    rng = np.random.default_rng(5)
    top = np.iinfo(np.int64).max
    tasks = [(rng.integers(-40, 40, 60) * (top // 50), rng.integers(0, 30, 60)) for _ in range(4)]
    tasks.append(([7, 7, 8, 9], [1, 1, 2, 3]))  # a line met again in a task is one row
    tasks.append(([8, 9], [2, 4]))  # and one met in two tasks too
    plain = {}
    for keys, names in tasks:
        for key, name in zip(np.asarray(keys).tolist(), np.asarray(names).tolist(), strict=True):
            plain.setdefault(key, set()).add(name)
    want = sorted((key, name) for key, names in plain.items() if len(names) > 1 for name in names)
    columns = "doc_id long, line_no int, id long, key long, part int, packed binary"
    rows = [tuple(row.values()) for batch in _rows(tasks, 5) for row in batch.to_pylist()]
    found = spark.createDataFrame(rows, columns)
    got = sorted((r.key, r.id) for r in _shared(found, scratch).collect())
    assert got == want and (7, 1) not in got and (8, 2) not in got and {(9, 3), (9, 4)} <= set(got)


def test_a_large_bucket_sends_one_row_of_a_task_to_its_part():
    batches = _rows([([5] * 1000, list(range(1000)))], 3)
    packed = [row for batch in batches for row in batch.to_pylist() if row["part"] is not None]
    assert [len(row["packed"]) for row in packed] == [17]
    assert sum(row["key"] == 5 for batch in batches for row in batch.to_pylist()) == 999


def test_cut_lines_by_number():
    texts = ["a\n\nbc", "", "x\n", "漢字\nlast"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(text.encode()) for text in texts])]
    places = [(r, n) for r, text in enumerate(texts) for n in range(len(text.split("\n")) + 1)]
    row, number = (np.array(column) for column in zip(*places, strict=True))
    cut, ends, names = _cut_lines(data, offsets, row, number, np.arange(len(places)))
    lines = [bytes(cut[i:j]).decode() for i, j in zip(ends[:-1], ends[1:], strict=True)]
    want = [(i, texts[r].split("\n")[n]) for i, (r, n) in enumerate(places) if n < len(texts[r].split("\n"))]
    assert list(zip(names.tolist(), lines, strict=True)) == want


def test_pick_leaves_out_another_line_at_that_number():
    texts = ["first line here\n  wanted line of this text \t", "first line here\nanother line of the same id"]
    data = np.frombuffer(texts[0].encode(), np.uint8)
    name = int(read_lines(data, np.array([0, len(data)]), WordReader(SPACED, fold=False), 1).id[1])
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("id", pa.int64())]))
    batch = pa.record_batch([pa.array(texts), pa.array([[{"line_no": 1, "id": name}]] * 2, kind)], ["text", "wanted"])
    rows = [row for out in _pick(8, 1)(iter([batch])) for row in out.to_pylist()]
    assert [(row["id"], row["line"], row["n"]) for row in rows] == [(name, b"wanted line of this text", 17)]


def test_signatures_take_the_first_filled_bin_of_each_order():
    rng = np.random.default_rng(3)
    hasher = OnePermutation(3, 4)
    sizes = [1, 2, 5, 40]
    found = rng.integers(0, 1 << 63, sum(sizes), np.int64).view(np.uint64) * np.uint64(2)
    got = _signatures(found, np.repeat(np.arange(4), sizes), 4, hasher)
    ends = np.cumsum(sizes)
    for i, end in enumerate(ends):
        assert (got[i] == hasher.signature(np.unique(found[end - sizes[i] : end]))).all()
