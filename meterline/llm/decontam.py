"""Benchmark decontamination: a prefix-filtered containment join of item windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.scratch import Scratch
from meterline.llm.words import ALNUM, WordReader, runs, slices
from meterline.session import shuffle_width

WINDOWS = "item string, words array<long>, shingles array<long>, k int"
FOUND = "doc_id long, copy long, n_words long, n_hit long, spans array<struct<s:int,e:int>>, classes array<long>"


def _windows(length: int, k: int):
    """Per item its windows: the words' hashes and the hashes of their k-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(ALNUM, fold=True)
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]

        def table(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["item", "words", "shingles", "k"]
            )

        rows = []
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, _, data, offsets in slices(batch.column(1)):
                words = reader.read(data, offsets)
                cut = np.searchsorted(words.row, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    own = words.hash[cut[i] : cut[i + 1]]
                    if not len(own):
                        continue
                    size, kk = min(length, len(own)), min(k, len(own))
                    found = runs(own, np.zeros(len(own), np.int64), kk, seed=kk)[0].astype(np.int64)
                    own = own.astype(np.int64)
                    for at in range(len(own) - size + 1):
                        rows.append((names[first + i], own[at : at + size], found[at : at + size - kk + 1], kk))
                        if len(rows) == 4096:
                            yield table(rows)
                            rows = []
        if rows:
            yield table(rows)

    return run


class _Lookup:
    """Positions of a sorted set's members among many hashes; a bitmap sorts out most others."""

    def __init__(self, members: np.ndarray):
        self.members = members
        self.bits = np.zeros(1 << 20, bool)
        self.bits[members >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        if not len(near) or not len(self.members):
            return near[:0], near[:0]
        where = np.minimum(np.searchsorted(self.members, hashes[near]), len(self.members) - 1)
        hit = self.members[where] == hashes[near]
        return near[hit], where[hit]


def _counts(wanted):
    """How often each wanted shingle occurs: one row for each of them and task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(ALNUM, fold=True)
        sets = {k: (_Lookup(members), np.zeros(len(members), np.int64)) for k, members in wanted.value.items()}
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(1)):
                words = reader.read(data, offsets)
                for k, (lookup, total) in sets.items():
                    _, where = lookup.find(runs(words.hash, words.row, k, seed=k)[0])
                    total += np.bincount(where, minlength=len(total))
        for lookup, total in sets.values():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lookup.members[seen].astype(np.int64)), pa.array(total[seen])], ["shingle", "times"]
            )

    return run


def _hits(index):
    """Per document the spans of item windows in it and the classes of those windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(ALNUM, fold=True)
        tables = {k: (_Lookup(t["shingle"]), t) for k, t in index.value["by_k"].items()}
        for batch in batches:
            n_words, n_hit = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            spans: list = [[] for _ in range(len(batch))]
            classes: list = [[] for _ in range(len(batch))]
            for first, end, data, offsets in slices(batch.column(1)):
                words = reader.read(data, offsets)
                n_words[first:end] = np.bincount(words.row, minlength=end - first)
                edge = np.zeros(len(words.hash) + 1, np.int32)
                marks = []
                for k, (lookup, t) in tables.items():
                    found, at = runs(words.hash, words.row, k, seed=k)
                    near, where = lookup.find(found)
                    for part in range(0, len(near), 1 << 15):
                        marks.append(_verified(words, at[near[part : part + (1 << 15)]], where[part : part + (1 << 15)], t, edge))
                covered = np.cumsum(edge[:-1]) > 0
                if not covered.any():
                    continue
                n_hit[first:end] = np.bincount(words.row[covered], minlength=end - first)
                step = np.diff(np.r_[0, covered, 0].astype(np.int8))
                cut = np.searchsorted(words.row, np.arange(end - first))
                for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
                    while s < e:  # neighbouring rows may touch
                        row = words.row[s]
                        stop = min(e, np.searchsorted(words.row, row, "right"))
                        spans[first + row].append({"s": int(s - cut[row]), "e": int(stop - cut[row])})
                        s = stop
                for row, kind in np.unique(np.concatenate(marks), axis=0):
                    classes[first + row].append(kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n_words), pa.array(n_hit)]
                + [
                    pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                    pa.array([sorted(set(x)) for x in classes], pa.list_(pa.int64())),
                ],
                ["doc_id", "copy", "n_words", "n_hit", "spans", "classes"],
            )

    return run


def _verified(words, at: np.ndarray, where: np.ndarray, t: dict, edge: np.ndarray) -> np.ndarray:
    """Check the windows whose prefix shingle stands at ``at``; mark their words in ``edge``.

    The window has to lie inside its document (positional and length bounds), and all
    its words have to agree. Returns (row, class) of those found.
    """
    many = t["to"][where] - t["from"][where]
    window = np.repeat(t["from"][where], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(at, many)
    start, size = at - t["offset"][window], t["size"][window]
    last = start + size - 1
    ok = (start >= 0) & (last < len(words.row))
    start, window, size, at, last = (x[ok] for x in (start, window, size, at, last))
    ok = (words.row[start] == words.row[at]) & (words.row[last] == words.row[at])
    start, window, size = (x[ok] for x in (start, window, size))
    for j in range(t["words"].shape[1]):
        here = np.minimum(start + j, len(words.hash) - 1)
        ok = (j >= size) | (words.hash[here] == t["words"][window, j])
        start, window, size = start[ok], window[ok], size[ok]
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    return np.unique(np.stack([words.row[start], t["class"][window]], axis=1).reshape(-1, 2), axis=0)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    scratch: Scratch,
    *,
    window: int = 13,
    shingle: int = 3,
    share: int = 20,
    block_windows: int = 500_000,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, items_sha256, spans, contaminated) per document.

    Words are ASCII letters (lower-cased), digits and all non-ASCII characters. An
    item's windows are its runs of ``window`` words, or all its words if fewer. A
    document word inside an occurrence of a window is hit; a document is contaminated
    where share * n_hit >= n_words > 0 and n_hit > 0. ``spans`` holds the hit runs of
    words as [s, e).

    Containment is exact, so the necessary prefix of a window is one shingle: its
    rarest in ``docs``, counted over all of them. Documents are matched on prefix
    shingles only, bounded by position and length, and verified word by word. Windows
    are sent to the tasks in blocks of at most ``block_windows`` (about 150 bytes
    each), one after another, so a larger benchmark takes more passes and no more
    memory. Windows of the same items are one class; tasks see classes alone, and item
    ids are joined once for each set of classes that some document holds.

    Null or wordless texts have no words and are not contaminated; items without words
    or without an id are left out; items of equal id count once. Further columns are
    ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("copy", F.xxhash64("text"))
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    windows = scratch.table(items.repartition(shuffle_width(items.sparkSession)).mapInArrow(_windows(window, shingle), WINDOWS))
    # a window's class: its items, told by sums of their hashes, so no list of them is gathered
    sums = [F.count("*"), F.bit_xor(F.xxhash64("item")), F.bit_xor(F.xxhash64(F.lit(1), "item")), F.sum(F.pmod(F.xxhash64(F.lit(2), "item"), F.lit(1 << 31)))]
    distinct = scratch.table(
        windows.dropDuplicates(["words", "item"]).groupBy("words")
        .agg(F.first("shingles").alias("shingles"), F.first("k").alias("k"), F.xxhash64(*sums).alias("class"))
    )
    least = distinct.groupBy("class").agg(F.min("words").alias("words"))
    members = windows.select("words", "item").join(least, "words").select("class", "item").distinct()
    blocks = -(-distinct.count() // block_windows) or 1
    parts = []
    for block in range(blocks):
        own = distinct.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)
        parts.append(_block(docs, own, window))
    found = scratch.table(parts[0]) if blocks == 1 else scratch.table(_merged(docs, parts, scratch))
    sets = found.where("size(classes) > 0").select("classes").distinct()
    flat = sets.select("classes", F.explode("classes").alias("class")).join(members, "class")
    named = flat.groupBy("classes").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # most documents hold none; they stay out of the join
    none = found.where("size(classes) = 0").withColumn("items", F.array().cast("array<string>"))
    told = found.where("size(classes) > 0").join(named, "classes").unionByName(none)
    return told.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "spans",
        F.expr(f"n_hit > 0 and {share} * n_hit >= n_words").alias("contaminated"),
    )


def _block(docs: DataFrame, own: DataFrame, window: int) -> DataFrame:
    """The pass over all documents for one block of windows."""
    context = docs.sparkSession.sparkContext
    flat = own.select("k", F.posexplode("shingles").alias("offset", "shingle"), "words", "class")
    wanted = flat.select("k", "shingle").distinct().toPandas()
    members = {int(k): np.sort(x["shingle"].to_numpy().astype(np.uint64)) for k, x in wanted.groupby("k")}
    counted = docs.mapInArrow(_counts(context.broadcast(members)), "shingle long, times long")
    times = counted.groupBy("shingle").agg(F.sum("times").alias("times"))
    rarest = F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "shingle", "offset"))
    prefix = flat.join(times, "shingle", "left").groupBy("words", "k", "class").agg(rarest.alias("p"))
    table = prefix.where("p.times > 0").select("k", "words", "class", "p.shingle", "p.offset").toPandas()
    by_k = {}
    for k, t in table.groupby("k"):
        keys = t["shingle"].to_numpy().astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        t, keys = t.iloc[order], keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        padded = np.zeros((len(t), window), np.uint64)
        for i, some in enumerate(t["words"]):
            padded[i, : len(some)] = np.asarray(some, np.int64).astype(np.uint64)
        by_k[int(k)] = {
            "shingle": keys[first], "from": first, "to": np.r_[first[1:], len(t)], "words": padded,
            "offset": t["offset"].to_numpy().astype(np.int64), "size": np.array([len(x) for x in t["words"]]),
            "class": t["class"].to_numpy().astype(np.int64),
        }
    index = context.broadcast({"by_k": by_k})
    return docs.mapInArrow(_hits(index), FOUND)


def _merged(docs: DataFrame, parts: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Union of the spans and classes that several blocks found in each document.

    Rows of equal id and text have equal results and are one row until the end.
    """
    found = scratch.table(reduce(DataFrame.unionByName, [part.distinct() for part in parts]))
    merged = found.groupBy("doc_id", "copy", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes")
    )
    grown = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")
        ),
    )
    merged = merged.withColumn("n_hit", grown["n"].cast("long"))
    rows = docs.select("doc_id", "copy").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.copy").eqNullSafe(F.col("m.copy"))
    return rows.join(merged.alias("m"), same).select("d.doc_id", "n_words", "n_hit", "spans", "classes")
