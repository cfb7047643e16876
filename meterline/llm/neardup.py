"""Near-duplicate documents: one-permutation MinHash, banded buckets, verified stars."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.graph import components, merged, shared
from meterline.llm.scratch import Scratch
from meterline.llm.words import SPACED, WordReader, constants, mix, runs, slices

SIGNED = "doc_id long, set_key binary, n long, bands array<long>"
SETS = "id long, shingles array<long>, marks array<long>"
MARKS = 8  # words of 64 bits


class OnePermutation:
    """One hash per shingle; the range of hashes is cut into bins, each keeps its least.

    An empty bin takes the value of the first filled bin in an order of its own, the
    same for all sets (optimal densification), so two sets still agree in a bin with
    a probability equal to their Jaccard similarity.
    """

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.bins = bands * rows
        self.order = np.argsort(mix(np.arange(self.bins**2, dtype=np.uint64)).reshape(self.bins, -1), axis=1)
        self.factors = constants(rows, 11)
        self.salts = constants(bands, 13)

    def signature(self, ordered: np.ndarray) -> np.ndarray:
        """The bins' values of a set, given as its distinct hashes in ascending order."""
        place = ((ordered >> np.uint64(40)) * np.uint64(self.bins)) >> np.uint64(24)
        least = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        out = np.zeros(self.bins, np.uint64)
        filled = np.zeros(self.bins, bool)
        where = place[least].astype(np.int64)
        out[where] = ordered[least]
        filled[where] = True
        if len(where) < self.bins:
            empty = np.flatnonzero(~filled)
            choice = self.order[empty]
            out[empty] = out[choice[np.arange(len(empty)), filled[choice].argmax(axis=1)]]
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit key per set and band: equal where all rows of the band agree."""
        cut = signatures.reshape(len(signatures), self.bands, self.rows)
        return mix((cut * self.factors).sum(axis=2, dtype=np.uint64) + self.salts).astype(np.int64)


def shingle_sets(column: pa.Array, reader: WordReader, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``k`` words, as ascending hashes.

    A text of fewer words gives one shingle, the whole sequence; without words none.
    """
    for first, end, data, offsets in slices(column):
        words = reader.read(data, offsets)
        hashes, at = runs(words.hash, words.row, k)
        cut = np.searchsorted(words.row[at], np.arange(end - first + 1))
        span = np.searchsorted(words.row, np.arange(end - first + 1))
        for i in range(end - first):
            if span[i] == span[i + 1]:
                yield hashes[:0]
            elif cut[i] == cut[i + 1]:
                few = words.hash[span[i] : span[i + 1]]
                yield mix((few * constants(len(few), 1)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(few)))
            else:
                yield np.unique(hashes[cut[i] : cut[i + 1]])


def _signed(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, hasher = WordReader(SPACED, fold=True), OnePermutation(bands, rows)
        for batch in batches:
            sizes, names, signs = [], [], []
            for found in shingle_sets(batch.column(1), reader, k):
                sizes.append(len(found))
                if len(found):
                    names.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    signs.append(hasher.keys(hasher.signature(found)[None])[0])
                else:
                    names.append(None)
            n = np.array(sizes, np.int64)
            values = np.concatenate(signs) if signs else np.empty(0, np.int64)
            ends = np.r_[0, np.cumsum((n > 0) * bands)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(names, pa.binary()),
                    pa.array(n),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                ],
                ["doc_id", "set_key", "n", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(SPACED, fold=True)
        for batch in batches:
            held: list[np.ndarray] = []
            ids, size = [], 0
            for name, found in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), reader, k), strict=True):
                ids.append(name)
                held.append(found)
                size += len(found)
                if size > 1 << 19 or len(ids) >= 4096:
                    yield set_rows(pa.array(ids, pa.int64()), held)
                    held, ids, size = [], [], 0
            if ids:
                yield set_rows(pa.array(ids, pa.int64()), held)

    return run


def set_rows(ids: pa.Array, held: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of ``SETS``: each set's distinct hashes, and its marks."""
    ends = np.r_[0, np.cumsum([len(x) for x in held])].astype(np.int32)
    flat = np.concatenate(held)
    marks = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * MARKS), pa.array(marked(flat, ends).reshape(-1)))
    return pa.RecordBatch.from_arrays(
        [ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64))), marks], ["id", "shingles", "marks"]
    )


def marked(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each set ``MARKS`` words, whose bits tell if an odd number of its hashes falls there.

    Shared hashes turn the same bits of both sets, so two sets differ in no more bits
    than there are hashes in only one of them.
    """
    own = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    size = MARKS * 64
    bits = np.bincount(own * size + (flat % np.uint64(size)).astype(np.int64), minlength=(len(ends) - 1) * size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64).reshape(-1, MARKS)


def may_be_linked(percent: int) -> str:
    """Whether ``marks`` and ``marks_a`` of two sets of ``n`` and ``n_a`` hashes allow a link; no link is missed."""
    differing = " + ".join(f"bit_count(marks[{i}] ^ marks_a[{i}])" for i in range(MARKS))
    return f"{100 + percent} * (n + n_a - ({differing})) >= {2 * percent} * (n + n_a)"


def near_duplicates(
    docs: DataFrame, scratch: Scratch, *, k: int = 5, percent: int = 80, bands: int = 50, rows: int = 7
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Words are runs of non-space characters with A-Z lower-cased; a document is the set
    of its ``k``-word shingles (see ``shingle_sets``). Documents are linked where
    100 * intersection >= percent * union, confirmed on full sets; component_id is the
    smallest doc_id reachable over links, and the document of that id is kept.

    Candidates come from banded MinHash buckets: with 50 bands of 7 rows a pair at
    similarity 0.8 shares none with probability 8e-6. Equal sets are one node from the
    start. Each bucket links its members to its smallest id, a star, so there are no
    more pairs than members. Other members of a bucket that still lie in several
    components then go through an exact join on their rarest shingles
    (``_rare_pairs``), so a bucket loses no link that its star does not show.

    Null or wordless texts have no shingles and are linked with nothing. Rows of
    equal doc_id are one document for linking. A null doc_id is linked with nothing:
    its component_id is null and it is kept. Further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.table(docs.mapInArrow(_signed(k, bands, rows), SIGNED))
    known = signed.where("set_key is not null and doc_id is not null")
    same = scratch.table(known.groupBy("set_key").agg(F.min("doc_id").alias("id")))
    leads = known.join(same.select("set_key", F.col("id").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    buckets = shared(leads.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), "n"), scratch)

    members = scratch.table(buckets.groupBy("id").agg(F.max("n").alias("n")))
    texts = docs.join(members.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    sets = scratch.table(texts.mapInArrow(_sets(k), SETS))
    hubs = buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"))
    pairs = (
        buckets.join(hubs, "key").where("id <> hub.id")
        .where(f"100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")
        .select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
    )
    links = scratch.table(_verified(sets, pairs, percent))
    # Rows of one id may have several sets; those are then one document.
    several = known.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low < high")
    several = known.join(several.select("doc_id"), "doc_id", "left_semi").join(same, "set_key")
    links = links.unionByName(several.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct())

    labels = components(links, scratch)
    open_ids = unsettled(buckets, labels, scratch)
    scratch.drop(buckets, members)
    if not open_ids.isEmpty():
        rest = scratch.table(_verified(sets, _rare_pairs(sets.join(open_ids, "id"), percent, scratch), percent))
        scratch.drop(sets)
        if not rest.isEmpty():
            labels = merged(labels, rest, scratch)
    place = same.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "set_key", F.coalesce("component", "id").alias("component")
    )
    return (
        signed.select("doc_id", "set_key", "n").join(place, "set_key", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def unsettled(buckets: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, c): members, with their components, of buckets not settled by their star.

    The star compared the smallest id with all others of a bucket; it is open if those
    others lie in several components.
    """
    hubs = buckets.groupBy("key").agg(F.min("id").alias("hub"))
    marked = buckets.join(hubs, "key").where("id <> hub").join(labels.withColumnRenamed("node", "id"), "id", "left")
    marked = marked.select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = marked.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    return scratch.table(marked.join(mixed.select("key"), "key", "left_semi").select("id", "c").distinct())


def _rare_pairs(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components ``c`` that may be linked; no link is missed.

    ``sets`` holds (id, shingles, marks, c). In any order of shingles, two linked sets
    share one among the first n - ceil(n * percent / 100) + 1 of each, and what follows
    the first shared one leaves room for the overlap they need. The order is by rarity,
    so the prefix of a set that is linked with nothing is made of its own edits and
    meets no other. Shingles of the very same sets, such as those across one rare word,
    stand together in that order, and the first shared shingle heads its run; so only
    the head of each run is joined. Runs are told by a hash, and a clash of hashes only
    adds candidates. Where a shingle joins several components, members of the largest
    are compared with members of the others, and the others with each other, but no
    component with itself. Near misses fall in the join itself: bits in which the
    ``marks`` of two sets differ are a lower bound of the shingles that one of them
    lacks (``marked``), so hardly a pair but the links is made.
    """
    flat = sets.select("id", F.explode("shingles").alias("s"))
    times = flat.groupBy("s").agg(F.count("*").alias("times"), F.bit_xor(F.xxhash64("id")).alias("holders")).where("times > 1")
    some = flat.join(times, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("times", "holders"))).alias("some"))
    ranked = (
        sets.select("id", "c", "marks", F.size("shingles").alias("n")).join(some, "id")
        .withColumn("own", F.expr("n - size(some)"))
        .withColumn("take", F.expr(f"n - (n * {percent} + 99) div 100 + 1 - own"))
        .where("take > 0")
        .withColumn("some", F.expr("slice(some, 1, cast(least(take, size(some)) as int))"))
    )
    placed = F.transform("some", lambda p, i: F.struct(i.alias("i"), p["holders"].alias("s")))
    heads = F.filter(placed, lambda p: (p["i"] == 0) | (F.get("some", p["i"] - 1)["holders"] != p["s"]))
    prefix = scratch.table(
        ranked.select("id", "c", "n", "own", "marks", F.explode(heads).alias("p"))
        .select("id", "c", "n", "marks", F.expr("n - own - p.i").alias("room"), "p.s")
    )
    share = prefix.groupBy("s", "c").agg(F.count("*").alias("m"))
    most = share.groupBy("s").agg(F.max(F.struct("m", "c")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = prefix.join(most.select("s", F.col("most.c").alias("main")), "s")
    others = mixed.where("c <> main").select("s", "main", *(F.col(x).alias(f"{x}_a") for x in ("id", "c", "n", "room", "marks")))
    return (
        others.join(mixed.drop("main"), "s").where("c <> c_a and (c = main or id < id_a)")
        .where(f"{100 + percent} * least(room, room_a) >= {percent} * (n + n_a)")
        .where(may_be_linked(percent))
        .select(F.least("id_a", "id").alias("a"), F.greatest("id_a", "id").alias("b")).distinct()
    )


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full shingle sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return (
        pairs.join(right, "b").join(left, "a")
        .select("a", "b", F.size(F.array_intersect("x", "y")).alias("m"), (F.size("x") + F.size("y")).alias("total"))
        .where(F.col("m") * 100 >= percent * (F.col("total") - F.col("m")))
        .select("a", "b").distinct()
    )
