"""Document quality from trusted positives and unlabelled text (non-negative PU risk)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.labelled import is_held_out, judged, plain, sampled
from meterline.llm.words import SPACED, WordReader, runs, slices


def features(column: pa.Array, reader: WordReader) -> np.ndarray:
    """Shape of each text: one row per text, all shares in 0..1 but for three logarithms."""
    groups = {
        "symbol": b"#*$%&|<>", "bang": b"!", "pipe": b"|", "digit": b"0123456789",
        "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "mark": b".,;:?'\"()-", "other": bytes(range(128, 256)),
    }
    tables = []
    for members in groups.values():
        table = np.zeros(256)
        table[np.frombuffer(members, np.uint8)] = 1
        tables.append(table)
    symbol = tables[0] + tables[1]
    out = []
    for first, end, data, offsets in slices(column):
        n = end - first
        size = np.maximum(np.diff(offsets), 1)
        words = reader.read(data, offsets)
        count = np.bincount(words.row, minlength=n)
        many = np.maximum(count, 1)
        cut = np.searchsorted(words.row, np.arange(n + 1))

        def per_word(values, row=words.row, n=n, many=many):
            return np.bincount(row, weights=values, minlength=n) / many

        columns = [np.log1p(count), np.log1p(size)]
        for table in tables:
            total = np.r_[0, np.cumsum(table[data])]
            columns.append((total[offsets[1:]] - total[offsets[:-1]]) / size)
        length = words.end - words.start
        columns.append(per_word(length) / 20)
        columns.append(per_word(length <= 3))
        columns.append(per_word(symbol[data[np.maximum(words.end - 1, 0)]]))
        same = np.r_[False, (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])]
        columns.append(per_word(same))
        for k in (1, 3):
            found, at = (words.hash, np.arange(len(words.hash))) if k == 1 else runs(words.hash, words.row, k)
            bounds = np.searchsorted(at, cut)
            distinct = [len(np.unique(found[a:b])) / max(b - a, 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns.append(np.array(distinct) if k == 1 else np.where(np.diff(bounds) > 0, distinct, 1.0))
        breaks = np.searchsorted(np.flatnonzero(data == 10), offsets)
        columns.append(np.log1p(count / (1 + np.diff(breaks))))
        out.append(np.stack(columns, axis=1))
    return np.concatenate(out) if out else np.empty((0, 17))


class PUModel:
    """A small network trained on the non-negative unbiased PU risk, in numpy."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, hidden: int = 16, steps: int = 1500, seed: int = 5):
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-3
        random = np.random.default_rng(seed)
        d = both.shape[1]
        self.weights = [random.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), random.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        p, u = self._scaled(positive), self._scaled(unlabelled)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        for step in range(1, steps + 1):
            one, two = p[random.integers(0, len(p), 512)], u[random.integers(0, len(u), 512)]
            x = np.concatenate([one, two])
            inner, raw = self._forward(x)
            share = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            a, b = share[: len(one)], share[len(one) :]
            loss = lambda s: -np.log(np.maximum(1 - s, 1e-12)).mean()  # noqa: E731  of being called negative
            slack = loss(b) - prior * loss(a)
            slope = np.zeros(len(x))
            # the positives' own risk
            if slack >= 0:
                slope[: len(one)] = prior * (a - 1) / len(one) - prior * a / len(one)
                slope[len(one) :] = b / len(two)
            else:  # the negatives' risk fell below zero: step back from it
                slope[: len(one)] = prior * a / len(one)
                slope[len(one) :] = -b / len(two)
            back = np.outer(slope, self.weights[2]) * (1 - inner**2)
            grads = [x.T @ back, back.sum(axis=0), inner.T @ slope, slope.sum(keepdims=True)]
            for w, g, (m, v) in zip(self.weights, grads, moments, strict=True):
                g = g + 1e-4 * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = np.tanh(x @ self.weights[0] + self.weights[1])
        return inner, inner @ self.weights[2] + self.weights[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward(self._scaled(x))[1], -30, 30)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled.

    A model that tells one half of both apart scores the other half. Above any score
    the unlabelled hold at least the prior times the positives' share, with equality
    where no negatives reach; the least ratio, each with a margin of one standard
    error, estimates the prior.
    """
    half_p, half_u = len(positive) // 2, len(unlabelled) // 2
    model = PUModel(positive[:half_p], unlabelled[:half_u], 0.5, steps=600)
    p, u = np.sort(model.score(positive[half_p:])), np.sort(model.score(unlabelled[half_u:]))
    levels = np.quantile(p, np.linspace(0, 0.5, 101))
    of_p = 1 - np.searchsorted(p, levels) / len(p)
    of_u = 1 - np.searchsorted(u, levels) / len(u)
    error = np.sqrt(of_u * (1 - of_u) / len(u) + 1 / len(u) ** 2) + np.sqrt(of_p * (1 - of_p) / len(p))
    return float(np.clip(((of_u + error) / of_p).min(), 0.05, 0.95))


def fitted(docs: DataFrame, labels: DataFrame, *, positives: int = 4000, unlabelled: int = 8000) -> PUModel | None:
    """A model from at most so many trusted positives and unlabelled documents of ``docs``.

    Both are chosen by a hash of the id; only their feature rows reach the driver. The
    unlabelled side is drawn from all documents that are neither held out nor one of those
    positives; labels that say otherwise are not read. With fewer than 8 of either there is
    no model.
    """
    docs = plain(docs)
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    free = docs.where("doc_id is not null").where(~is_held_out()).select("doc_id")
    good = sampled(known.where("quality = 1").where(~is_held_out()).select("doc_id"), positives)
    rest = sampled(free.join(good, "doc_id", "left_anti"), unlabelled)
    picks = good.withColumn("kind", F.lit(1)).unionByName(rest.withColumn("kind", F.lit(0)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(SPACED, fold=True)
        for batch in batches:
            found = features(batch.column(0), reader)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(found.reshape(-1)), found.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), flat], ["kind", "x"])

    # the picks are at most positives + unlabelled ids: a bounded side
    sample = docs.join(F.broadcast(picks), "doc_id").select("text", "kind").mapInArrow(measure, "kind int, x array<double>").toPandas()
    if not len(sample):
        return None
    x, kind = np.stack(sample["x"].to_numpy()), sample["kind"].to_numpy()
    order = np.lexsort([*x.T, kind])  # rows arrive in any order
    order = order[np.random.default_rng(3).permutation(len(order))]
    x, kind = x[order], kind[order]
    if min((kind == 1).sum(), (kind == 0).sum()) < 8:
        return None
    return PUModel(x[kind == 1], x[kind == 0], estimated_prior(x[kind == 1], x[kind == 0]))


def _scores(model: PUModel | None, column: pa.Array, reader: WordReader) -> np.ndarray:
    return np.full(len(column), 0.5) if model is None else model.score(features(column, reader))


def quality_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **sizes: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; higher is better.

    Trusted positives are documents labelled quality 1, the rest of the evidence is
    text whose labels are not read; labels of 0 are not used. Rows that are held out (crc32 of the id,
    modulo 4, is 2) train nothing. The class prior is estimated from the same samples,
    see ``fitted`` for their bounds.

    Null and empty texts are scored like any text. Documents with several label rows
    are positive if one of them says 1. Without a model every score is 0.5. Further
    columns are ignored.
    """
    model = fitted(docs, labels, **sizes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(SPACED, fold=True)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1), reader))], ["doc_id", "score"])

    return judged(plain(docs).mapInArrow(score, "doc_id long, score double"), threshold)


def good_rows(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **sizes: int) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, as they are; all without a model."""
    model = fitted(docs, labels, **sizes)
    if model is None:
        return docs
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(SPACED, fold=True)
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(place), reader) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
