"""Toxicity: averaged subword embeddings and a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.labelled import is_held_out, judged, plain, sampled
from meterline.llm.words import ALNUM, WordReader, constants, slices

BITS = 20
LONGEST = 5  # character n-grams of 3, 4 and 5 bytes, borders included


def subwords(data: np.ndarray, offsets: np.ndarray, reader: WordReader):
    """The words' rows and hashes, and for each n the buckets of all runs of n bytes.

    Every byte outside of words counts as one border sign, so the runs of a word
    start at the border before it and end with the one behind it. Returns (row,
    word bucket, [(buckets of all positions, first, end) for each n]).
    """
    # one border between rows, so that no run depends on the neighbouring text
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wide = np.full(len(data) + len(offsets) + LONGEST, 32, np.uint8)
    wide[np.arange(len(data)) + own + 1] = data
    bounds = offsets + np.arange(len(offsets))
    words = reader.read(wide[: bounds[-1] + 1], bounds)
    letters = np.where(reader.is_word[wide], reader.values[wide], np.uint64(12345))
    total = np.zeros(len(wide) - LONGEST, np.uint64)
    kinds = []
    for j, factor in enumerate(constants(LONGEST, 29)):
        total += letters[j : j + len(total)] * factor
        if j >= 2:
            n = j + 1
            low = words.start - 1
            kinds.append(((total * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64), low, np.maximum(words.end + 2 - n, low)))
    return words.row, (words.hash >> np.uint64(64 - BITS)).astype(np.int64), kinds


def word_scores(value: np.ndarray, word: np.ndarray, kinds) -> np.ndarray:
    """For each word the mean of ``value`` over its buckets."""
    total, many = value[word].astype(np.float64), np.ones(len(word))
    for buckets, low, high in kinds:
        run = np.r_[0.0, np.cumsum(value[buckets], dtype=np.float64)]
        total += run[high] - run[low]
        many += high - low
    return total / many


class SubwordModel:
    """Embeddings of buckets, averaged by word and then by text, under a linear softmax."""

    def __init__(self, texts: list[np.ndarray], labels: np.ndarray, weights: list[np.ndarray], *, size: int = 4, epochs: int = 12, rate: float = 0.6, least: int = 3, seed: int = 9):
        """texts: bucket ids of each text; weights: each one's share in the text's mean."""
        random = np.random.default_rng(seed)
        self.vectors = np.zeros((1 << BITS, size), np.float32)  # unseen n-grams say nothing
        self.out = random.normal(0, 0.5, (size, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        # a bucket of few texts would only learn them by heart; like unseen ones it says nothing
        seen_in = np.zeros(1 << BITS, np.int32)
        for ids in texts:
            seen_in[ids] += 1
        known = seen_in >= least
        squares = np.full((1 << BITS, 1), 1e-6, np.float32)
        out_squares, bias_squares = np.full((size, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
        for _ in range(epochs):
            order = random.permutation(len(texts))
            for at in range(0, len(order), 32):
                batch = order[at : at + 32]
                ids = np.concatenate([texts[i] for i in batch])
                share = np.concatenate([weights[i] for i in batch]).astype(np.float32)
                cuts = np.r_[0, np.cumsum([len(texts[i]) for i in batch])[:-1]]
                rows = self.vectors[ids]
                mean = np.add.reduceat(rows * share[:, None], cuts, axis=0)
                raw = mean @ self.out + self.bias
                raw -= raw.max(axis=1, keepdims=True)
                slope = np.exp(raw)
                slope /= slope.sum(axis=1, keepdims=True)
                slope[np.arange(len(batch)), labels[batch]] -= 1
                back = slope @ self.out.T
                grad_out, grad_bias = mean.T @ slope, slope.sum(axis=0)
                seen, inverse = np.unique(ids, return_inverse=True)
                lengths = np.diff(np.r_[cuts, len(ids)])
                pushed = np.repeat(back, lengths, axis=0) * share[:, None]
                grad = np.stack([np.bincount(inverse, pushed[:, c], len(seen)) for c in range(size)], axis=1).astype(np.float32)
                grad *= known[seen, None]
                squares[seen] += (grad**2).mean(axis=1, keepdims=True)
                self.vectors[seen] -= rate * grad / np.sqrt(squares[seen])
                out_squares += grad_out**2
                bias_squares += grad_bias**2
                self.out -= 0.1 * grad_out / np.sqrt(out_squares)
                self.bias -= 0.1 * grad_bias / np.sqrt(bias_squares)

    def linear(self) -> tuple[np.ndarray, float]:
        """The log odds as a mean of one number per bucket, and a constant."""
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def _bags(column: pa.Array, reader: WordReader) -> tuple[list[np.ndarray], list[np.ndarray]]:
    texts, weights = [], []
    for _, _, data, offsets in slices(column):
        row, word, kinds = subwords(data, offsets, reader)
        many = np.ones(len(word))
        for _, low, high in kinds:
            many += high - low
        ids, words = [word], [np.arange(len(word))]
        for buckets, low, high in kinds:
            n = high - low
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            ids.append(buckets[at])
            words.append(np.repeat(np.arange(len(word)), n))
        ids, words = np.concatenate(ids), np.concatenate(words)
        count = np.bincount(row, minlength=len(offsets) - 1)
        share = 1 / (many[words] * count[row[words]])
        order = np.argsort(row[words], kind="stable")
        ids, share, rows = ids[order], share[order], row[words][order]
        cut = np.searchsorted(rows, np.arange(len(offsets)))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own, inverse = np.unique(ids[a:b], return_inverse=True)
            texts.append(own)
            weights.append(np.bincount(inverse, share[a:b], len(own)))
    return texts, weights


def _sample_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = WordReader(ALNUM, fold=True)
    for batch in batches:
        ids, weights = _bags(batch.column(2), reader)
        packed = [pa.array([x.astype(kind).tobytes() for x in column], pa.binary()) for column, kind in ((ids, "<i4"), (weights, "<f4"))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], ["doc_id", "kind", "ids", "weights"])


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; higher is more toxic.

    A word is the mean of the vectors of itself and of its character n-grams, a text
    the mean of its words, so a misspelling unseen in training shares most n-grams
    with the word it hides. Words are runs of ASCII letters (lower-cased), digits and
    non-ASCII characters. The fit uses at most ``per_class`` labelled documents of
    either class, chosen by a hash of the id, never held-out ones (crc32 of the id,
    modulo 4, is 2). Their bags are made by the tasks; the driver gets each bucket of a text
    once, in 8 bytes. The bias is set back to the classes' shares among the labels.

    Null, empty and wordless texts get the score of the bias alone. Documents with
    several label rows count as toxic if one of them says 1; of rows with one id, one trains. With fewer than 4
    documents in a class every score is 0. Further columns are ignored.
    """
    docs = plain(docs)
    known = (
        labels.where("doc_id is not null and toxic is not null").where(~is_held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    picks = sampled(known.where("toxic = 1").select("doc_id"), per_class).withColumn("kind", F.lit(1))
    picks = picks.unionByName(sampled(known.where("toxic = 0").select("doc_id"), per_class).withColumn("kind", F.lit(0)))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    sample = docs.join(F.broadcast(picks), "doc_id").groupBy("doc_id", "kind").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    bags = sample.mapInArrow(_sample_bags, "doc_id long, kind int, ids binary, weights binary")
    # one partition at a time, so the driver's JVM never holds all of them
    bags = sorted(bags.toLocalIterator(), key=lambda row: row.doc_id)
    kind = np.array([row.kind for row in bags], np.int64)
    linear = None
    if (kind == 1).sum() >= 4 and (kind == 0).sum() >= 4:
        texts, weights = [np.frombuffer(row.ids, "<i4") for row in bags], [np.frombuffer(row.weights, "<f4") for row in bags]
        some = np.flatnonzero([len(x) > 0 for x in texts])
        value, bias = SubwordModel([texts[i] for i in some], kind[some], [weights[i] for i in some]).linear()
        drawn = kind[some].mean()
        linear = (value, bias + float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(ALNUM, fold=True)
        for batch in batches:
            values = np.zeros(len(batch))
            if linear is not None:
                for first, end, data, offsets in slices(batch.column(1)):
                    row, word, kinds = subwords(data, offsets, reader)
                    total = np.bincount(row, weights=word_scores(linear[0], word, kinds), minlength=end - first)
                    many = np.maximum(np.bincount(row, minlength=end - first), 1)
                    values[first:end] = 1 / (1 + np.exp(-np.clip(total / many + linear[1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "score"])

    return judged(docs.mapInArrow(score, "doc_id long, score double"), threshold)
