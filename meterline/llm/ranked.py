"""Ranked lexical search over an index whose documents are grouped by their length normaliser."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.llm.scratch import Scratch
from meterline.llm.words import ALNUM, WordReader, slices, word_counts
from meterline.session import shuffle_width

#: Term occurrences of a part of a stratum, about: what a task sorts at a time.
PART_TERMS = 1 << 19
#: Postings that a search holds at a time, about.
SEARCH_POSTINGS = 1 << 22
#: What holding one slice of postings costs, counted in postings.
SLICE_COST = 40
#: What stands for a null doc_id in the index.
NOBODY = -(1 << 63)
#: Items that are searched for in one pass over the index.
ITEMS = 1024

INDEX = "m long, docs array<long>, terms array<long>, runs array<int>, tfs array<int>, counts array<int>, posts array<int>"
BAG = "doc_id long, n long, terms array<long>, tfs array<int>"


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of every text, as ascending 64-bit hashes, and how often each stands there."""
    reader = WordReader(ALNUM, fold=True)
    for batch in batches:
        for first, end, data, offsets in slices(batch.column(1)):
            words = reader.read(data, offsets)
            names = words.hash.astype(np.int64)
            order = np.lexsort((names, words.row))
            names, rows = names[order], words.row[order]
            new = np.ones(len(names), bool)
            new[1:] = (names[1:] != names[:-1]) | (rows[1:] != rows[:-1])
            at = np.flatnonzero(new)
            bounds = np.searchsorted(rows[at], np.arange(end - first + 1)).astype(np.int32)
            n = np.bincount(rows, minlength=end - first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, end - first),
                    pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(names[at])),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.diff(np.r_[at, len(names)]).astype(np.int32))),
                ],
                ["doc_id", "n", "terms", "tfs"],
            )


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, docs): how many texts of a batch have n terms, for each n but 0."""
    for batch in batches:
        counts = [word_counts(ALNUM, data, offsets) for _, _, data, offsets in slices(batch.column(0))]
        n, docs = np.unique(np.concatenate([np.empty(0, np.int64), *counts]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(n[n > 0], pa.int64()), pa.array(docs[n > 0], pa.int64())], ["n", "docs"])


def _stratum(part: pa.Table) -> pa.RecordBatch:
    """One index row: a part's terms, each with its documents by falling tf."""
    part = part.combine_chunks()
    docs = part.column("doc_id").to_numpy()
    lists = [_flat(part, name) for name in ("terms", "tfs")]
    sizes = np.diff(lists[0][0])
    names, tfs = lists[0][1], lists[1][1]
    place = np.argsort(docs, kind="stable")
    rank = np.empty(len(docs), np.int64)
    rank[place] = np.arange(len(docs))
    owner = np.repeat(rank, sizes)
    order = np.lexsort((owner, -tfs, names))
    names, tfs, owner = names[order], tfs[order], owner[order]
    new_term = np.ones(len(names), bool)
    new_term[1:] = names[1:] != names[:-1]
    new_run = new_term.copy()
    new_run[1:] |= tfs[1:] != tfs[:-1]
    run_at = np.flatnonzero(new_run)
    term_at = np.flatnonzero(new_term)
    values = [
        docs[place], names[term_at], np.diff(np.r_[np.searchsorted(run_at, term_at), len(run_at)]),
        tfs[run_at], np.diff(np.r_[run_at, len(names)]), owner,
    ]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    lists = [pa.array([value], pa.list_(kind)) for value, kind in zip(values, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([part.column("m").chunk(0).slice(0, 1), *lists], ["m", "docs", "terms", "runs", "tfs", "counts", "posts"])


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = table.column(name).chunk(0)
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten().to_numpy()


def _strata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        m, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.r_[0, np.flatnonzero((m[1:] != m[:-1]) | (part[1:] != part[:-1])) + 1, len(m)]
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if high == low:
                continue
            piece = batch.slice(low, high - low)
            if held and (held[0].column(0)[0], held[0].column(1)[0]) != (piece.column(0)[0], piece.column(1)[0]):
                yield _stratum(pa.Table.from_batches(held))
                held = []
            held.append(piece)
    if held:
        yield _stratum(pa.Table.from_batches(held))


class Index(NamedTuple):
    strata: DataFrame  # one row per part of a stratum, see INDEX
    n_docs: int
    n_terms: int


def length_index(docs: DataFrame, scratch: Scratch) -> Index:
    """The index of every document (doc_id, text) that holds a term.

    Terms are maximal runs of characters outside ASCII and of ASCII letters and digits,
    A-Z lower-cased, told apart by 64-bit hashes. With N documents that hold a term, L
    terms in all and n in a document, its normaliser is m = 10 + (90 * n * N) div L.
    Documents of equal m are a stratum. Strata are cut into parts of about
    ``PART_TERMS`` terms, so one length that very many documents have is no hot group,
    and dealt to tasks in order of m by sums of terms. A part lists for each of its
    terms runs of documents of equal tf, the largest first.

    Null texts hold no term. Documents of a null doc_id count in N, L and document
    frequencies, but are no results. Repeated rows are documents of their own.
    """
    name = F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY))
    docs = docs.select(name.alias("doc_id"), F.col("text").cast("string").alias("text"))
    lengths = docs.select("text").mapInArrow(_lengths, "n long, docs long")
    sizes = scratch.table(lengths.groupBy("n").agg(F.sum("docs").alias("docs")))
    n_docs, n_terms = sizes.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("docs")), F.lit(0))).first()
    m = F.expr(f"10 + (90 * n * {n_docs}L) div {max(n_terms, 1)}L")
    width = shuffle_width(docs.sparkSession)
    # One row per stratum: few beside the documents, as m has no more values than a document has terms.
    strata = sizes.groupBy(m.alias("m")).agg(F.sum(F.col("n") * F.col("docs")).alias("terms"))
    strata = strata.select("m", "terms", F.expr(f"1 + terms div {PART_TERMS}").alias("parts"))
    before = F.sum("terms").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1))
    strata = scratch.table(strata.withColumn("before", F.coalesce(before, F.lit(0))))

    bags = docs.mapInArrow(_bags, BAG).where("n > 0").withColumn("m", m).withColumn("draw", F.xxhash64("doc_id", "terms", "tfs"))
    dealt = bags.join(strata.withColumnRenamed("terms", "share"), "m").withColumn("part", F.expr("pmod(draw, parts)"))
    task = F.expr(f"cast(least({width - 1}, (before + (share * part) div parts) div {-(-max(n_terms, 1) // width)}) as int)")
    dealt = dealt.repartitionById(width, task).select("m", "part", "doc_id", "terms", "tfs")
    return Index(scratch.table(dealt.sortWithinPartitions("m", "part").mapInArrow(_strata, INDEX)), n_docs, n_terms)


def _counted(wanted: np.ndarray):
    """(term, df) of each index row for the wanted terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for row in range(len(batch)):
                terms, runs, counts = (_list(batch, name, row) for name in ("terms", "runs", "counts"))
                at, there = _found(terms, wanted)
                bounds = np.r_[0, np.cumsum(runs)]
                sums = np.r_[0, np.cumsum(counts, dtype=np.int64)]
                total[there] += sums[bounds[at + 1]] - sums[bounds[at]]
        yield pa.RecordBatch.from_arrays([pa.array(wanted), pa.array(total)], ["term", "df"])

    return run


def _list(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy()


def _found(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``terms`` of those wanted terms that are there, and which they are; both ascend."""
    at = np.searchsorted(terms, wanted)
    there = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == wanted)
    return at[there], there


class Block:
    """Some parts of strata, with the impacts of the wanted terms.

    ``where[t]`` lists the parts that hold term t, ascending, with the greatest impact
    of the term there and the slice of its postings.
    """

    def __init__(self, n_wanted: int):
        self.docs: list[np.ndarray] = []
        self.size = 0
        self.found: list[list[tuple]] = [[] for _ in range(n_wanted)]

    def add(self, m: int, docs, at, there, runs, tfs, counts, posts) -> None:
        part = len(self.docs)
        self.docs.append(docs)
        run_at = np.r_[0, np.cumsum(runs)]
        post_at = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        kinds, which = np.unique(tfs, return_inverse=True)
        once = (1_000_000_000 * kinds.astype(np.int64)) // (1000 * kinds.astype(np.int64) + 8 * m)
        impacts = once[which]
        for i, t in zip(at.tolist(), there.tolist(), strict=True):
            low, high = run_at[i], run_at[i + 1]
            own = slice(post_at[low], post_at[high])
            self.found[t].append((part, impacts[low], posts[own], impacts[low:high], counts[low:high]))
            self.size += int(own.stop - own.start) + SLICE_COST

    def close(self) -> None:
        self.where = []
        for own in self.found:
            parts = np.array([x[0] for x in own], np.int64)
            self.where.append((parts, np.array([x[1] for x in own], np.int64), {x[0]: x[2:] for x in own}))
        self.found = []


def _best(scores: np.ndarray, docs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest scores above 0 and their documents, ties by ascending document."""
    some = np.flatnonzero(scores > 0)
    if len(some) > 4 * most:
        edge = np.partition(scores[some], len(some) - most)[len(some) - most]
        some = some[scores[some] >= edge]
    order = np.lexsort((docs[some], -scores[some]))[:most]
    return scores[some][order], docs[some][order]


def _visit(block: Block, terms: np.ndarray, weights: np.ndarray, scores: np.ndarray, docs: np.ndarray, most: int):
    """The best of a block and of what was found before (scores, docs).

    Parts are visited in the order of their bounds, the sums of weights times greatest
    impacts. The first part whose bound lies below the last place ends the visits.
    """
    bounds = np.zeros(len(block.docs), np.int64)
    for t, w in zip(terms, weights, strict=True):
        parts, top, _ = block.where[t]
        bounds[parts] += w * top
    for part in np.argsort(-bounds, kind="stable"):
        if bounds[part] == 0 or len(scores) == most and bounds[part] < scores[-1]:
            break
        ids = block.docs[part]
        sums = np.zeros(len(ids), np.int64)
        for t, w in zip(terms, weights, strict=True):
            own = block.where[t][2].get(part)
            if own:
                posts, impacts, counts = own
                sums[posts] += w * (impacts[0] if len(impacts) == 1 else np.repeat(impacts, counts))
        sums[ids == NOBODY] = 0
        more, names = _best(sums, ids, most)
        if len(scores):
            more, names = _best(np.r_[scores, more], np.r_[docs, names], most)
        scores, docs = more, names
    return scores, docs


def _searched(wanted: np.ndarray, weights: np.ndarray, items: list[np.ndarray], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]

        def visit(block: Block) -> None:
            block.close()
            for i, terms in enumerate(items):
                best[i] = _visit(block, terms, weights[terms], *best[i], most)

        block = Block(len(wanted))
        for batch in batches:
            for row in range(len(batch)):
                at, there = _found(_list(batch, "terms", row), wanted)
                if len(there):
                    rest = (_list(batch, name, row) for name in ("runs", "tfs", "counts", "posts"))
                    block.add(batch.column("m")[row].as_py(), _list(batch, "docs", row), at, there, *rest)
                if block.size > SEARCH_POSTINGS:
                    visit(block)
                    block = Block(len(wanted))
        if block.size:
            visit(block)
        sizes = [len(scores) for scores, _ in best]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(items)), sizes)),
                pa.array(np.concatenate([docs for _, docs in best]), pa.int64()),
                pa.array(np.concatenate([scores for scores, _ in best]), pa.int64()),
            ],
            ["place", "doc_id", "score"],
        )

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def ranked(index: Index, items: DataFrame, scratch: Scratch, most: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its ``most`` best documents.

    A document's score is the sum, over the item's distinct terms, of
    w * ((1000000000 * tf) div (1000 * tf + 8 * m)), with
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))). Only scores above 0 count; equal
    ones rank by ascending doc_id. Rows of one item_id are one item with the terms of
    all of them. Items of a null item_id or without a term have no results.

    Items are taken ``ITEMS`` at a time, whatever their number; for each such block the
    index is read once for document frequencies and once for scores. A task keeps the
    best documents of the block's items, never all scores, and skips strata that cannot
    reach them.
    """
    spark = items.sparkSession
    texts = items.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text"))
    names = scratch.table(texts.select("item_id").distinct())
    kind = names.schema["item_id"].dataType
    hashed = texts.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(_item_terms, "item string, terms array<long>")
    terms = scratch.table(
        hashed.select("item", F.explode("terms").alias("term")).distinct().groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    )
    empty = spark.createDataFrame([], "item string, doc_id long, score long")
    found = [empty]
    rows = terms.orderBy("item").toLocalIterator()  # a block of items at a time comes to the driver
    while block := [row for _, row in zip(range(ITEMS), rows)]:
        found.append(scratch.table(_block_results(spark, index, [(r.item, np.array(r.terms, np.int64)) for r in block], most)))
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    top = every.withColumn("rank", F.row_number().over(order)).where(f"rank <= {most}")
    return top.select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bag in _bags(batches):
        yield pa.RecordBatch.from_arrays([bag.column(0), bag.column(2)], ["item", "terms"])


def _block_results(spark, index: Index, block: list[tuple[str, np.ndarray]], most: int) -> DataFrame:
    wanted = np.unique(np.concatenate([terms for _, terms in block]))
    counts = index.strata.select("terms", "runs", "counts").mapInArrow(_counted(wanted), "term long, df long")
    dfs = dict(counts.groupBy("term").agg(F.sum("df").alias("df")).collect())
    weights = np.array([weight(index.n_docs, dfs.get(t, 0)) for t in wanted.tolist()], np.int64)
    items = [np.searchsorted(wanted, terms) for _, terms in block]
    results = index.strata.mapInArrow(_searched(wanted, weights, items, most), "place long, doc_id long, score long")
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], "place long, item string")
    return results.join(F.broadcast(names), "place").select("item", "doc_id", "score")
