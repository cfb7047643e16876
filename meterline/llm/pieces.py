"""SentencePiece encoding by a Viterbi search shared between words, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.words import slices

MARK = "▁"
#: Words, of this many characters each at most, whose ids a task remembers; as many older ones stay while asked for.
CACHED_WORDS, CACHED_CHARS = 100_000, 64
TEXT_BYTES = 1 << 19


def load_model(path: str) -> dict:
    """What encoding and decoding need of a model file: pieces, scores and kinds."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models with the identity normalizer are supported")
    if model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("models that mark word ends are not supported")
    return {
        "pieces": [p.piece for p in model.pieces],
        "scores": [p.score for p in model.pieces],
        "kinds": [p.type for p in model.pieces],
        "prefix": spec.add_dummy_prefix,
        "fallback": model.trainer_spec.byte_fallback,
    }


class Encoder:
    """Best segmentations of marked words under the sum of the pieces' scores."""

    def __init__(self, model: dict):
        normal, unknown, raw = 1, 2, 6  # kinds of pieces in a model file
        self.entries: dict[str, tuple[float, int] | None] = {}
        scores = []
        for i, (piece, score, kind) in enumerate(zip(model["pieces"], model["scores"], model["kinds"], strict=True)):
            if kind == normal:
                for end in range(1, len(piece)):
                    self.entries.setdefault(piece[:end], None)
                self.entries[piece] = (score, i)
                scores.append(score)
        if any(MARK in piece.lstrip(MARK) for piece in self.entries):
            raise ValueError("a piece has a mark behind other characters")
        self.unknown_score = min(scores) - 10
        self.unknown_id = model["kinds"].index(unknown)
        self.bytes = [i for i, kind in enumerate(model["kinds"]) if kind == raw] if model["fallback"] else []
        self.prefix = model["prefix"]
        # a line break that no piece has is a word of its own
        self.words = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if not any("\n" in p for p in self.entries) else f"{MARK}*[^{MARK}]+|{MARK}+")

    def split(self, text: str) -> list[str]:
        """Marked words; no piece reaches over the end of one, so each has a best path of its own."""
        if not text:
            return []
        return self.words.findall((MARK if self.prefix else "") + text.replace(" ", MARK))

    def encode(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each of the sorted distinct ``words``.

        Sorted words are a depth-first walk over their trie: what two neighbours have
        in common is the path down to where they part. The forward scores on that path
        stay on the stack, only those below it are worked out anew.
        """
        find, missing, unknown = self.entries.get, (), self.unknown_score
        best, back = [0.0], [(0, 0)]  # by depth: score, (start, id) of the last piece
        open_at: list[list[int]] = [[]]  # by depth: starts from which a piece may go on
        last = ""
        for word in words:
            depth, most = 0, min(len(word), len(last))
            while depth < most and word[depth] == last[depth]:
                depth += 1
            del best[depth + 1 :], back[depth + 1 :], open_at[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                top, step, going = None, None, []
                for start in open_at[end - 1]:
                    entry = find(word[start:end], missing)
                    if entry is not missing:
                        going.append(start)
                        if entry is not None:
                            score = best[start] + entry[0]
                            if top is None or score > top:
                                top, step = score, (start, entry[1])
                entry = find(word[end - 1], missing)
                if entry is not missing:
                    going.append(end - 1)
                if entry is None or entry is missing:
                    score = best[end - 1] + unknown
                    if top is None or score > top:
                        top, step = score, (end - 1, -1)
                else:
                    score = best[end - 1] + entry[0]
                    if top is None or score > top:
                        top, step = score, (end - 1, entry[1])
                best.append(top)
                back.append(step)
                open_at.append(going)
            ids, end = [], len(word)
            while end:
                start, piece_id = back[end]
                if piece_id >= 0:
                    ids.append(piece_id)
                elif self.bytes:
                    ids.extend(self.bytes[b] for b in reversed(word[start].encode()))
                else:
                    ids.append(self.unknown_id)
                end = start
            ids.reverse()
            last = word
            yield ids


class Decoder:
    """Texts of ids: all pieces' bytes laid out behind each other."""

    def __init__(self, model: dict):
        raw, control, unknown = 6, 3, 2
        out = []
        for piece, kind in zip(model["pieces"], model["kinds"], strict=True):
            if kind == raw:
                out.append(bytes([int(piece[3:5], 16)]))
            elif kind == control:
                out.append(b"")
            else:
                out.append(" ⁇ ".encode() if kind == unknown else piece.replace(MARK, " ").encode())
        self.flat = np.frombuffer(b"".join(out), np.uint8)
        self.size = np.array([len(x) for x in out])
        self.at = np.cumsum(self.size) - self.size
        self.prefix = model["prefix"]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The text of each run ids[bounds[i]:bounds[i + 1]]."""
        size = self.size[ids]
        ends = np.r_[0, np.cumsum(size)]
        where = np.arange(ends[-1]) + np.repeat(self.at[ids] - ends[:-1], size)
        data = self.flat[where].tobytes()
        texts = [data[ends[a] : ends[b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [t[1:] if self.prefix and t.startswith(b" ") else t for t in texts]


class _Words:
    """Ids of the words met by one task. When full, words not asked for since the last time go."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.older = self.place, self.flat, self.at

    def _turn(self) -> None:
        older = self.place, self.flat, self.at
        self.clear()
        self.older = older

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > CACHED_WORDS or len(self.flat) > 16 * CACHED_WORDS:
            self._turn()
        split = [self.encoder.split(t) for t in texts]
        place, known = self.place, len(self.at) - 1
        missing = set(chain.from_iterable(split)).difference(place)
        old_place, old_flat, old_at = self.older
        kept = [w for w in missing if w in old_place]
        fresh = sorted(missing.difference(kept))
        again, sizes = _runs(old_flat, old_at, np.array([old_place[w] for w in kept], np.int64))
        parts = list(self.encoder.encode(fresh))
        new = np.fromiter(chain.from_iterable(parts), np.int32)
        self.flat = np.concatenate([self.flat, again, new])
        sizes = np.r_[sizes, np.fromiter(map(len, parts), np.int64, len(parts))]
        self.at = np.r_[self.at, self.at[-1] + np.cumsum(sizes, dtype=np.int64)]
        place.update(zip(chain(kept, fresh), range(known, known + len(missing)), strict=True))
        index = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64)
        flat, size = _runs(self.flat, self.at, index)
        for word in fresh:
            if len(word) > CACHED_CHARS:
                del place[word]
        ends = np.r_[0, np.cumsum(size)]
        words = np.r_[0, np.cumsum([len(w) for w in split])]
        return flat, ends[words]


def _runs(flat: np.ndarray, at: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[at[i]:at[i + 1]] behind each other, for each i of ``index``, and their sizes."""
    size = at[index + 1] - at[index]
    ends = np.r_[0, np.cumsum(size)]
    return flat[np.arange(ends[-1]) + np.repeat(at[index] - ends[:-1], size)], size


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) for every row of ``docs`` (doc_id, text).

    Text is marked as the model file says (spaces become marks, one in front) and cut
    into marked words, which no piece reaches over. The distinct words of some 512 KB of
    text at a time are sorted and walked as a trie, see ``Encoder.encode``. Scores add
    up as log-probabilities, so a BPE model's file is used as a unigram model with the
    same pieces and scores. Of equal paths the one whose last piece is longest wins.
    Characters that no piece has become their bytes.

    ``round_trip`` tells whether decoding gives the text back; it does but for a
    literal mark sign in the text. Null and empty texts have no tokens and do. Rows
    stay as they are, equal or not. Further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, decoder = _Words(Encoder(model.value)), Decoder(model.value)
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1), TEXT_BYTES):
                raw = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                flat, bounds = words.ids([t.decode("utf-8", "replace") for t in raw])
                same = [a == b for a, b in zip(decoder.decode(flat, bounds), raw, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat)),
                        pa.array(np.diff(bounds)),
                        pa.array(same),
                    ],
                    ["doc_id", "ids", "n_tokens", "round_trip"],
                )

    return docs.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""
    model = rows.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.value)
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                own = None if not ids.is_valid else ids.values.to_numpy(zero_copy_only=False).astype(np.int64)
                texts.append(None if own is None else decoder.decode(own, np.array([0, len(own)]))[0].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
