"""Line dedup: MinHash of character shingles, exact checks, one line kept per component."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.graph import components, merged
from meterline.llm.neardup import SETS, OnePermutation, _rare_pairs, marked, may_be_linked, set_rows, unsettled
from meterline.llm.neardup import _verified as verified_sets
from meterline.llm.scratch import Scratch
from meterline.llm.words import SPACED, WordReader, characters, constants, mix, slices, text_bytes
from meterline.session import shuffle_width

FOUND = "doc_id long, line_no int, id long, key long, part int, packed binary"
#: Lines that a task remembers; a line met again later gives equal bucket rows, which are merged.
SEEN_LINES = 100_000
#: Bucket rows that a task packs at a time, and parts of the keys for each shuffle partition.
PACKED_ROWS, PARTS = 1 << 19, 4
#: Buckets of so many lines at most are compared line by line.
SMALL_BUCKET = 24
#: Bytes of text that are read at a time, few enough for their arrays to stay in cache.
READ_BYTES = 1 << 16
#: Pairs that are checked at a time, and bytes of their lines.
CLOSE_PAIRS, CLOSE_BYTES = 64, 1 << 17
#: Stars, each about another member, by which larger buckets are linked before the exact join.
STARS = 4
PICKED = "id long, line binary, n int, marks array<long>"
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: What characters of one byte count for in a line's hash.
LOW_SPREAD = mix(np.arange(1, 257, dtype=np.uint64))


class Lines(NamedTuple):
    row: np.ndarray
    number: np.ndarray
    id: np.ndarray
    start: np.ndarray  # in characters of the slice
    end: np.ndarray
    value: np.ndarray  # all characters of the slice
    place: np.ndarray  # where each starts in bytes


def read_lines(data: np.ndarray, offsets: np.ndarray, reader: WordReader, least: int) -> Lines:
    """The trimmed lines of at least ``least`` characters, with their number in the row."""
    value, bounds, place = characters(data, offsets)
    breaks = np.flatnonzero(value == 10)
    row_of_break = np.searchsorted(bounds, breaks, "right") - 1
    start = np.sort(np.r_[bounds[:-1], breaks + 1], kind="stable")
    end = np.sort(np.r_[breaks, bounds[1:]], kind="stable")
    row = np.sort(np.r_[np.arange(len(bounds) - 1), row_of_break], kind="stable")
    number = np.arange(len(row)) - np.searchsorted(row, row)
    solid = np.flatnonzero(~((value == 32) | ((value >= 9) & (value <= 13))))
    low, high = np.searchsorted(solid, start), np.searchsorted(solid, end)
    keep = np.flatnonzero(high > low)
    start, end = solid[low[keep]], solid[high[keep] - 1] + 1
    long = end - start >= least
    keep, start, end = keep[long], start[long], end[long]
    spread = LOW_SPREAD[value & np.uint32(0xFF)]
    high = np.flatnonzero(value > 0xFF)
    spread[high] = mix(value[high].astype(np.uint64) + np.uint64(1))
    sums = reader.sums(spread)
    names = (reader.span_hash(sums, start, end)).astype(np.int64)
    return Lines(row[keep], number[keep], names, start, end, value, place)


def char_shingles(value: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` characters inside the spans, and the span of each."""
    many = end - start - k + 1
    span = np.repeat(np.arange(len(start)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + start[span]
    total = np.zeros(max(len(value) - k + 1, 0), np.uint64)
    part = np.empty_like(total)
    wide = value.astype(np.uint64)
    for j, factor in enumerate(constants(k, 17)):
        np.multiply(wide[j : j + len(total)], factor, out=part)
        total += part
    return mix(total[at]), span


def _signatures(found: np.ndarray, span: np.ndarray, n: int, hasher: OnePermutation) -> np.ndarray:
    bins = hasher.bins
    place = ((found >> np.uint64(40)) * np.uint64(bins)) >> np.uint64(24)
    out = np.full(n * bins, EMPTY)
    np.minimum.at(out, span * bins + place.astype(np.int64), found)
    out = out.reshape(n, bins)
    row, empty = np.nonzero(out == EMPTY)
    filled = out.copy()
    for choice in hasher.order.T:  # each bin's next choice; most find a filled one among the first
        if not len(row):
            break
        value = out[row, choice[empty]]
        some = value != EMPTY
        filled[row[some], empty[some]] = value[some]
        row, empty = row[~some], empty[~some]
    return filled


def _read(k: int, bands: int, rows: int, least: int, parts: int):
    """Rows of ``FOUND`` of three kinds: places of lines, bucket rows, and packed bucket rows (see ``_packed``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, hasher = WordReader(SPACED, fold=False), OnePermutation(bands, rows)
        seen: set[int] = set()  # a line's bands leave a task once, or once for so many lines
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            for first, _, data, offsets in slices(batch.column(1), READ_BYTES):
                lines = read_lines(data, offsets, reader, least)
                if not len(lines.id):
                    continue
                if len(seen) > SEEN_LINES:
                    seen.clear()
                fresh = np.zeros(len(lines.id), bool)
                for i, name in enumerate(lines.id.tolist()):
                    if name not in seen:
                        seen.add(name)
                        fresh[i] = True
                # a line of fewer than k characters has no shingle: equality alone
                fresh &= lines.end - lines.start >= k
                own = np.flatnonzero(fresh)
                found, span = char_shingles(lines.value, lines.start[own], lines.end[own], k)
                keys = hasher.keys(_signatures(found, span, len(own), hasher)).reshape(-1)
                held.append((keys, np.repeat(lines.id[own], bands)))
                waiting += len(keys)
                yield _found(
                    len(lines.id),
                    doc_id=batch.column(0).take(pa.array(first + lines.row)),
                    line_no=pa.array(lines.number.astype(np.int32)),
                    id=pa.array(lines.id),
                )
                if waiting >= PACKED_ROWS:
                    yield from _packed(held, parts)
                    held, waiting = [], 0
        if waiting:
            yield from _packed(held, parts)

    return run


def _found(n: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of ``FOUND`` with nulls in all other columns."""
    kinds = {"doc_id": pa.int64(), "line_no": pa.int32(), "id": pa.int64(), "key": pa.int64(), "part": pa.int32(), "packed": pa.binary()}
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kind)) for name, kind in kinds.items()], list(kinds))


def _packed(held: list[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Bucket rows of a task: one of each key packed by parts of the keys, the others as they are.

    A key with several lines is known to be shared, so its further lines need not meet
    other tasks' rows; its first one goes there with a mark. So no part grows with a bucket.
    """
    keys, names = (np.concatenate(column) for column in zip(*held, strict=True))
    order = np.argsort(keys.view(np.uint64))
    keys, names = keys[order], names[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    other = names != np.repeat(names[heads], np.diff(np.r_[heads, len(keys)]))
    marks = np.logical_or.reduceat(other, heads)
    if other.any():
        yield _found(int(other.sum()), key=pa.array(keys[other]), id=pa.array(names[other]))
    keys, names = keys[heads], names[heads]
    part = ((keys.view(np.uint64) >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    rows = [keys[i:j].tobytes() + names[i:j].tobytes() + marks[i:j].tobytes() for i, j in zip(cut, np.r_[cut[1:], len(keys)], strict=True)]
    yield _found(len(rows), part=pa.array(part[cut].astype(np.int32)), packed=pa.array(rows, pa.binary()))


def _shared_keys(table: pa.Table) -> pa.Table:
    """(key, id) of the packed rows of one part whose key is marked or has several ids."""
    rows = table.column("packed").to_pylist()
    sizes = [len(row) // 17 for row in rows]
    keys = np.concatenate([np.frombuffer(row, np.int64, n) for row, n in zip(rows, sizes, strict=True)])
    names = np.concatenate([np.frombuffer(row, np.int64, n, 8 * n) for row, n in zip(rows, sizes, strict=True)])
    marks = np.concatenate([np.frombuffer(row, bool, n, 16 * n) for row, n in zip(rows, sizes, strict=True)])
    order = np.argsort(keys)
    keys, names, marks = keys[order], names[order], marks[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    many = np.diff(np.r_[heads, len(keys)])
    several = np.logical_or.reduceat(marks | (names != np.repeat(names[heads], many)), heads)
    keep = np.repeat(several, many)
    return pa.table({"key": pa.array(keys[keep]), "id": pa.array(names[keep])})


def _shared(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct bucket rows (key, id) of the keys that several lines have."""
    dealt = found.where("part is not null").select("part", "packed").groupBy("part").applyInArrow(_shared_keys, "key long, id long")
    return scratch.table(dealt.unionByName(found.where("key is not null").select("key", "id")).distinct())


def _pick(k: int, least: int):
    """The wanted lines (line_no, id) of each document: (id, line, n, marks), the last two of its runs of ``k`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(SPACED, fold=False)
        for batch in batches:
            wanted = batch.column(1)
            counts = np.r_[0, np.cumsum(wanted.value_lengths().to_numpy(zero_copy_only=False))]
            number, name = (wanted.flatten().field(j).to_numpy(zero_copy_only=False) for j in (0, 1))
            for first, end, data, offsets in slices(batch.column(0)):
                some = slice(counts[first], counts[end])
                row = np.repeat(np.arange(end - first), np.diff(counts[first : end + 1]))
                data, offsets, names = _cut_lines(data, offsets, row, number[some], name[some])
                lines = read_lines(data, offsets, reader, least)
                # rows of equal doc_id may have another line there
                own = np.flatnonzero(lines.id == names[lines.row])
                place = np.r_[lines.place, len(data)]
                for at in (own[i : i + 4096] for i in range(0, len(own), 4096)):
                    starts, ends = lines.start[at], lines.end[at]
                    found, span = char_shingles(lines.value, starts, ends, k)
                    cut = np.searchsorted(span, np.arange(len(at) + 1))
                    for low, high in zip(cut[:-1], cut[1:], strict=True):
                        found[low:high].sort()
                    once = np.r_[True, (found[1:] != found[:-1]) | (span[1:] != span[:-1])]
                    size = np.bincount(span[once], minlength=len(at))
                    marks = marked(found[once], np.r_[0, np.cumsum(size)])
                    bounds = np.arange(len(at) + 1, dtype=np.int32) * marks.shape[1]
                    texts = [data[low:high].tobytes() for low, high in zip(place[starts], place[ends], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(lines.id[at], pa.int64()),
                            pa.array(texts, pa.binary()),
                            pa.array(size.astype(np.int32)),
                            pa.ListArray.from_arrays(pa.array(bounds), pa.array(marks.reshape(-1))),
                        ],
                        ["id", "line", "n", "marks"],
                    )

    return run


def _cut_lines(
    data: np.ndarray, offsets: np.ndarray, row: np.ndarray, number: np.ndarray, name: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines of these numbers in these rows as texts of their own (bytes, offsets), and their names."""
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, offsets)
    there = number <= (before[1:] - before[:-1])[row]
    row, number, name = row[there], number[there], name[there]
    at = before[row] + number  # the break that ends the line, if any
    start = np.where(number > 0, np.r_[breaks, 0][at - 1] + 1, offsets[row])
    end = np.where(at < before[row + 1], np.r_[breaks, 0][at], offsets[row + 1])
    ends = np.r_[0, np.cumsum(end - start)]
    return data[np.arange(ends[-1]) + np.repeat(start - ends[:-1], end - start)], ends, name


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1).cast(pa.large_binary()).view(pa.large_string())):
                value, bounds, _ = characters(data, offsets)
                found, span = char_shingles(value, bounds[:-1], bounds[1:], k)
                cut = np.searchsorted(span, np.arange(end - first + 1))
                own = [np.unique(found[cut[i] : cut[i + 1]]) for i in range(end - first)]
                for i in range(0, len(own), 4096):
                    some = own[i : i + 4096]
                    yield set_rows(batch.column(0).slice(first + i, len(some)), some)

    return run


def _close(k: int, percent: int):
    """Of pairs of lines (a, b, x, y) those whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = np.zeros(len(batch), bool)
            size = np.cumsum(np.diff(text_bytes(x)[1]) + np.diff(text_bytes(y)[1]))
            first = 0
            while first < len(batch):
                most = (size[first - 1] if first else 0) + CLOSE_BYTES
                end = min(max(int(np.searchsorted(size, most, "right")), first + 1), first + CLOSE_PAIRS)
                keys = _sided(x.slice(first, end - first), y.slice(first, end - first), k)
                pair = (keys >> np.uint64(56)).astype(np.int64)
                shared_by = pair[1:][keys[1:] ^ keys[:-1] == 1]
                total, m = (np.bincount(found, minlength=end - first) for found in (pair, shared_by))
                keep[first:end] = 100 * m >= percent * (total - m)
                first = end
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _sided(x: pa.Array, y: pa.Array, k: int) -> np.ndarray:
    """The distinct shingles of pairs of lines, ascending: the pair's place in 8 bits, 55 bits of the hash, the side in one."""
    data, offsets = text_bytes(pa.concat_arrays([x, y]))
    value, bounds, _ = characters(data[offsets[0] : offsets[-1]], offsets - offsets[0])
    found, span = char_shingles(value, bounds[:-1], bounds[1:], k)
    keys = (found >> np.uint64(9) << np.uint64(1)) | (span % len(x) << 56 | span // len(x)).astype(np.uint64)
    keys.sort()
    return keys[np.r_[True, keys[1:] != keys[:-1]]]


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of lines those that are linked; near misses fall by the lines' marks."""
    sketch = texts.select("id", "n", "marks")
    left = sketch.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("marks").alias("marks_a"))
    near = pairs.join(left, "a").join(sketch.withColumnRenamed("id", "b"), "b").where(may_be_linked(percent)).select("a", "b")
    both = near.join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").select("a", "b", "x", "y")
    return both.mapInArrow(_close(k, percent), "a long, b long")


def _other_stars(buckets: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of a member drawn from each bucket of several components and its members of others."""
    named = buckets.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    draw = F.min(F.struct(F.xxhash64(F.lit(turn), "id").alias("draw"), F.col("id").alias("a"), F.col("c").alias("of"))).alias("hub")
    hubs = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), draw).where("low < high").select("key", "hub.a", "hub.of")
    return named.join(hubs, "key").where("c <> of").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()


def repeated_lines(
    docs: DataFrame,
    scratch: Scratch,
    *,
    k: int = 8,
    percent: int = 80,
    bands: int = 12,
    rows: int = 4,
    least: int = 25,
) -> DataFrame:
    """(doc_id, removed): for each document that repeats lines, the numbers of those to remove.

    Lines are cut at newlines, numbered from 0, and compared without outer ASCII white
    space. A line is the set of its runs of ``k`` characters; two lines are linked
    where 100 * intersection >= percent * union. Of every component of linked or equal
    lines the first stays (least doc_id, then line number), all others are removed.
    Lines of fewer than ``k`` characters have no run and are linked where they are equal.
    Lines of fewer than ``least`` characters are never compared and stay; with 1 every
    line that holds more than white space is compared.

    With 12 bands of 4 rows a pair at similarity 0.8 shares no bucket with probability
    2e-3, one at 0.9 with 2e-6. Lines of a small bucket are all compared. A larger one
    links its members to its smallest line, then those of other components to a few drawn
    ones, and members of buckets that still have several components go through the exact
    join on their rarest shingles. Equal lines are one node; a line enters buckets about once per task.

    Null or empty texts have no lines. Rows of a null doc_id keep all lines and are
    compared with none; rows of equal doc_id are one document. Further columns are
    ignored. Lines are told apart by 64-bit hashes.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = PARTS * shuffle_width(docs.sparkSession)
    found = scratch.table(docs.mapInArrow(_read(k, bands, rows, least, parts), FOUND))
    buckets = _shared(found, scratch)
    places = scratch.table(found.where("doc_id is not null").select("doc_id", "line_no", "id"))
    scratch.drop(found)
    sizes = buckets.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("m"))
    members = scratch.table(buckets.join(sizes, "key"))
    scratch.drop(buckets)
    small, wide = members.where(F.col("m") <= SMALL_BUCKET), members.where(F.col("m") > SMALL_BUCKET).select("key", "id")
    every = small.select("key", F.col("id").alias("a")).join(small.select("key", F.col("id").alias("b")), "key").where("a < b")
    stars = members.where((F.col("m") > SMALL_BUCKET) & (F.col("id") != F.col("a"))).select("a", F.col("id").alias("b"))

    wanted = members.select("id").distinct()
    first = places.join(wanted, "id").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.min_by("line_no", "doc_id").alias("line_no"))
    per_doc = first.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "id")).alias("wanted"))
    picked = docs.join(per_doc, "doc_id").select("text", "wanted").mapInArrow(_pick(k, least), PICKED)
    texts = scratch.table(picked.dropDuplicates(["id"]))
    links = scratch.table(_linked(every.select("a", "b").unionByName(stars).distinct(), texts, k, percent))
    labels = components(links, scratch)

    for turn in range(STARS - 1):
        pairs = scratch.table(_other_stars(wide, labels, turn))
        if pairs.isEmpty():
            break
        more = scratch.table(_linked(pairs, texts, k, percent))
        if not more.isEmpty():
            labels = merged(labels, more, scratch)
        scratch.drop(pairs, more)
    open_ids = unsettled(wide, labels, scratch)
    scratch.drop(members)
    if not open_ids.isEmpty():
        sets = scratch.table(texts.select("id", "line").join(open_ids.select("id"), "id", "left_semi").mapInArrow(_sets(k), SETS))
        pairs = scratch.table(_rare_pairs(sets.join(open_ids, "id"), percent, scratch))
        rest = scratch.table(verified_sets(sets, pairs, percent))
        scratch.drop(sets, pairs)
        if not rest.isEmpty():
            labels = merged(labels, rest, scratch)
    scratch.drop(texts)

    lines = places.join(labels.withColumnRenamed("node", "id"), "id", "left")
    lines = scratch.table(lines.select("doc_id", "line_no", F.coalesce("component", "id").alias("c")))
    several = lines.groupBy("c").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeats = scratch.table(lines.join(several, "c"))
    scratch.drop(places, lines)
    stays = repeats.where("doc_id = least").groupBy("c").agg(F.min("line_no").alias("stays"))
    gone = repeats.join(stays, "c").where("doc_id <> least or line_no <> stays")
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with the lines numbered in ``removed`` (doc_id, removed) taken out of ``text``.

    Other columns stay, whatever their names; rows of a null doc_id or text stay as they are.
    """
    rows = docs.select(F.struct("*").alias("row"))
    gone = removed.select(F.col("doc_id").alias("of"), "removed")
    out = rows.join(gone, F.col("row.doc_id") == F.col("of"), "left").withColumn("lines", F.split("row.text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    joined = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(joined)
    return out.select(*[text.alias(name) if name == "text" else F.col("row").getField(name).alias(name) for name in docs.columns])
