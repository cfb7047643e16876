"""License scans: exact phrases, and short notices found with a bounded number of edits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.words import ALNUM, WordReader, slices

# Phrases whose words stand consecutively, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short notices as they are usually written, and their labels.
NOTICES = {
    "licensed under the apache license, version 2.0": "apache-2.0",
    "licensed under the gnu general public license, version 3": "gpl-3.0",
    "licensed under the gnu general public license, version 2": "gpl-2.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "licensed under the bsd 3-clause license": "bsd-3-clause",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by-nc 4.0": "cc-by-nc-4.0",
    "licensed under cc by-sa 4.0": "cc-by-sa-4.0",
    "licensed under cc by 4.0": "cc-by-4.0",
    "permission is hereby granted, free of charge": "mit-text",
}

FOUND = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, spans array<struct<label:string,start:int,end:int,edits:int>>"
)


class NoticeFinder:
    """Bounded-error search for notices.

    A text within k edits of a notice holds at least one of k + 1 pieces of it
    unchanged, so exact hits of the pieces say where to look. Around them the regex
    library matches the whole notice with up to k edits, the fewest first.
    """

    def __init__(self, notices: dict[str, str], per_edit: int):
        import regex

        self.rules, self.seeds = [], {}
        for i, (notice, label) in enumerate(notices.items()):
            k = len(notice) // per_edit
            pattern = regex.compile(rb"(?b)(?:%s){e<=%d}" % (regex.escape(notice.encode()), k))
            self.rules.append((label, len(notice), k, pattern))
            cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                self.seeds.setdefault(notice[a:b].encode(), []).append((i, a))

    def find(self, text: bytes, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, rule, start, end, edits) of matches in lower-cased ``text`` of several rows."""
        areas: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for seed, uses in self.seeds.items():
            at = text.find(seed)
            while at >= 0:
                row = int(np.searchsorted(bounds, at, "right")) - 1
                if at + len(seed) <= bounds[row + 1]:
                    for rule, offset in uses:
                        _, size, k, _ = self.rules[rule]
                        low, high = max(at - offset - k, bounds[row]), min(at - offset + size + k, bounds[row + 1])
                        areas.setdefault((row, rule), []).append((int(low), int(high)))
                at = text.find(seed, at + 1)
        out = []
        for (row, rule), spans in areas.items():
            spans.sort()
            merged = [list(spans[0])]
            for low, high in spans[1:]:
                if low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            while merged:  # the best match of an area may have others on both sides
                low, high = merged.pop()
                if (m := self.rules[rule][3].search(text, low, high)) and m.end() > m.start():
                    out.append((row, rule, m.start(), m.end(), sum(m.fuzzy_counts)))
                    merged += [[low, m.start()], [m.end(), high]]
        return out


def license_notices(
    docs: DataFrame, *, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, per_edit: int = 12
) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Base labels come from ``phrases`` whose words (ASCII letters lower-cased, digits,
    non-ASCII) stand consecutively; ``n_base`` counts all places, first_word and
    last_word are their least and largest start in words. Notices add labels where
    the text comes within one edit for each ``per_edit`` characters; ``spans`` gives
    each such place in characters of the text. Of notices that overlap in the same
    place the one with the fewest edits for its length counts. ``score`` is 1 with a
    base label, else the best 1 - edits / length of a notice, 0 without any.

    Null and empty texts have no words, no labels (empty strings) and score 0. Rows
    stay as they are, equal or not. Further columns are ignored.
    """
    phrases = PHRASES if phrases is None else phrases
    notices = NOTICES if notices is None else notices
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, finder = WordReader(ALNUM, fold=True), NoticeFinder(notices, per_edit)
        wanted = []
        for phrase, label in phrases.items():
            data = np.frombuffer(phrase.encode(), np.uint8)
            wanted.append((reader.read(data, np.array([0, len(data)])).hash, label))
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        span_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
        for batch in batches:
            n = len(batch)
            n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
            low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            base: list[set] = [set() for _ in range(n)]
            more: list[list] = [[] for _ in range(n)]
            score = np.zeros(n)
            for first, end, data, offsets in slices(batch.column(1)):
                data = lower[data]
                words = reader.read(data, offsets)
                n_words[first:end] = np.bincount(words.row, minlength=end - first)
                cut = np.searchsorted(words.row, np.arange(end - first))
                for parts, label in wanted:
                    last = len(words.hash) - len(parts) + 1
                    at = np.flatnonzero(words.hash[: max(last, 0)] == parts[0])
                    for j in range(1, len(parts)):
                        at = at[(words.hash[at + j] == parts[j]) & (words.row[at + j] == words.row[at])]
                    for a in at:
                        row = words.row[a]
                        place, i = a - cut[row], first + row
                        n_base[i] += 1
                        base[i].add(label)
                        low[i] = place if low[i] < 0 else min(low[i], place)
                        high[i] = max(high[i], place)
                text = data.tobytes()
                found = sorted(finder.find(text, offsets), key=lambda m: (m[0], m[4] / finder.rules[m[1]][1], m[2] - m[3]))
                taken: dict[int, list] = {}
                for row, rule, start, stop, edits in found:
                    others = taken.setdefault(row, [])
                    if any(start < e and s < stop for s, e in others):
                        continue
                    others.append((start, stop))
                    label, size, _, _ = finder.rules[rule]
                    before = len(text[offsets[row] : start].decode("utf-8", "ignore"))
                    length = len(text[start:stop].decode("utf-8", "ignore"))
                    more[first + row].append({"label": label, "start": before, "end": before + length, "edits": edits})
                    score[first + row] = max(score[first + row], 1 - edits / size)
            score[n_base > 0] = 1.0
            labels = [",".join(sorted(b | {m["label"] for m in s})) for b, s in zip(base, more, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(low, mask=low < 0), pa.array(high, mask=high < 0),
                    pa.array([",".join(sorted(b)) for b in base]), pa.array(labels), pa.array(score),
                    pa.array([sorted(s, key=lambda m: m["start"]) for s in more], span_type),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.mapInArrow(run, FOUND)
