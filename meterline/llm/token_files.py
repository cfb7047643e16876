"""Token ids in Parquet files: encoded lists, small pages and a page index for selective reads.

A set of token files is a folder with ``tokens``, one file per chunk of the order of
doc_id, and ``chunks``, one small row per chunk that says where its ids begin.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_letters, punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.llm.words import SPACED, slices
from meterline.operators.ordered import CHUNK, ordered_chunks
from meterline.session import shuffle_width

TOKENS = "chunk int, doc_id long, start long, stop long, n_tokens long, ids array<int>"
CHUNKS = "chunk int, base long, tokens long, docs long"

#: Documents of a file, about.
FILE_DOCS = 1 << 16
#: Bytes of distinct words, with their ids, that a worker remembers.
REMEMBERED = 8 << 24
#: Bytes of text that are encoded at a time.
SLICE = 1 << 22
#: Words that go to the tokenizer in one text, with this one between them.
TOGETHER, BETWEEN = 256, "|"
#: Steps before a model that leave a word of letters whole, see them one by one if they are Latin, and cut it from symbols.
FORMS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
LATIN = ascii_letters + "".join(chr(i) for i in range(0xC0, 0x100) if chr(i).isalpha())
CUTS = [
    {
        "type": "Split", "behavior": "Removed", "invert": True,
        "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    },
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


class Encoder:
    """Ids of texts by a ``tokenizers`` file, given as its JSON.

    With ``by_word`` texts are cut at ASCII white space and each distinct word is encoded
    once. That gives the ids of the whole text for tokenizers that drop white space and
    let no token reach over it, whatever stands around. Words are also cut between an
    ASCII letter and one of ``marks``, for tokenizers that let no token reach over such a
    place; marks that stand in one of the tokenizer's added tokens are left out.
    """

    def __init__(self, model: str, by_word: bool, marks: str = ""):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.by_word = by_word
        added = {ch for token in self.tokenizer.get_added_tokens_decoder().values() for ch in token.content}
        self.kind = np.zeros(256, np.uint8)
        self.kind[[*range(65, 91), *range(97, 123)]] = 1
        self.kind[[ord(ch) for ch in marks if ch not in added]] = 2
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # what was known before, as long as it is asked for
        self.size = 0
        self.between = self._arrays([BETWEEN])[0].tolist()
        parts = json.loads(model)
        forms, cuts = (parts[step] or {} for step in ("normalizer", "pre_tokenizer"))
        # With known steps, and if no added token stands in a word of letters, the model can get the word at once.
        self.is_known = forms.get("normalizers") == FORMS and cuts.get("pretokenizers") == CUTS
        self.is_known &= not any(token.content.isalpha() for token in self.tokenizer.get_added_tokens_decoder().values())
        if self.is_known:
            form, cut = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.letters = {ord(ch): cut(form(ch))[0][0] for ch in LATIN}
            tail = "".join(ch for ch in punctuation if ch != "'" and ch not in added)
            self.plain_word = re.compile(f"([{LATIN}]+)([{re.escape(tail)}]*)")
        suffix = parts["model"].get("end_of_word_suffix")
        names = {i: name for name, i in self.tokenizer.get_vocab().items()} if suffix else {}
        self.closes = np.zeros(max(names, default=-1) + 1, bool)  # ids that end a word
        self.closes[[i for i, name in names.items() if name.endswith(suffix)]] = True

    def _arrays(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(one.ids, "<u4") for one in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        return [ids.tobytes() for ids in self._arrays([text.decode("utf-8", "replace") for text in texts])]

    def _many(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words by few calls: many words are put in one text and their ids parted again.

        Words of ASCII letters are parted behind each id that ends a word, if the
        tokenizer has such; others by the id of a mark put between any two, which no word
        without the mark's character has. Where the number of parts is not that of the
        words, they are encoded one by one. If the steps before the tokenizer's model are
        known, it gets words of Latin letters at once, and symbols behind them apart.
        """
        out: dict[bytes, bytes] = {}
        if self.is_known:
            ids_of, letters = self.tokenizer.model.tokenize, self.letters
            found = [self.plain_word.fullmatch(word.decode("utf-8", "replace")) for word in words]
            tails = list({match[2] for match in found if match})
            tails = dict(zip(tails, [ids.tobytes() for ids in self._arrays(tails)], strict=True))
            for word, match in zip(words, found, strict=True):
                if match:
                    out[word] = array("I", [token.id for token in ids_of(match[1].translate(letters))]).tobytes() + tails[match[2]]
            words = [word for word in words if word not in out]
        plain = [word for word in words if word.isalpha()] if self.closes.any() else []
        other = [word for word in words if not word.isalpha()] if plain else words
        groups = [(plain[i : i + TOGETHER], b" ") for i in range(0, len(plain), TOGETHER)]
        groups += [(other[i : i + TOGETHER], f" {BETWEEN} ".encode()) for i in range(0, len(other), TOGETHER)]
        found = self._arrays([glue.join(group).decode("utf-8", "replace") for group, glue in groups])
        for (group, glue), ids in zip(groups, found, strict=True):
            raw, end = ids.tobytes(), 4 * len(ids)
            if glue == b" ":
                stops = 4 * (np.flatnonzero(self.closes[ids]) + 1)
                is_parted = len(stops) == len(group) and stops[-1] == end
                starts = np.r_[0, stops[:-1]]
            else:
                marks = 4 * np.flatnonzero(ids == self.between[0]) if len(self.between) == 1 else []
                is_parted = len(marks) == len(group) - 1 and BETWEEN.encode() not in b"".join(group)
                starts, stops = np.r_[-4, marks] + 4, np.r_[marks, end]
            if is_parted:
                out.update((word, raw[low:high]) for word, low, high in zip(group, starts.tolist(), stops.tolist(), strict=True))
            else:
                out.update(zip(group, self._ids(group), strict=True))
        return out

    def _words(self, distinct: list[bytes]) -> list[bytes]:
        if self.size > REMEMBERED // 2:
            self.known, self.older, self.size = {}, self.known, 0
        known, older = self.known, self.older
        found = [*map(known.get, distinct)]
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            asked = {distinct[i] for i in missing}
            fresh = {word: older[word] for word in asked if word in older}
            fresh.update(self._many([word for word in asked if word not in fresh]))
            known.update(fresh)
            self.size += 150 * len(fresh) + sum(map(len, fresh)) + sum(map(len, fresh.values()))
            for i in missing:
                found[i] = fresh[distinct[i]]
        return found

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words, or their parts, start, and the first of them that is not before each offset."""
        kind, inside = self.kind[data], SPACED[data]
        cut = inside.copy()
        cut[1:] &= ~inside[:-1]
        cut[1:] |= (kind[1:] | kind[:-1]) == 3  # a letter and a mark
        heads = offsets[offsets < len(data)]
        cut[heads] = inside[heads]
        starts = np.flatnonzero(cut)
        return starts, np.searchsorted(starts, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some rows in a run, and how many each row has."""
        if self.by_word:
            starts, cuts = self._cut(data, offsets)
            if not len(starts):
                return np.empty(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
            # From one start to the next, and then without the white space behind the word.
            bounds = np.r_[starts, len(data)].astype(np.int32)
            spans = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
            spans = spans.dictionary_encode()
            which, distinct = spans.indices.to_numpy(), spans.dictionary
            raw, ends = distinct.buffers()[2].to_pybytes(), np.frombuffer(distinct.buffers()[1], np.int32)[: len(distinct) + 1].tolist()
            parts = self._words([raw[low:high].rstrip() for low, high in zip(ends[:-1], ends[1:], strict=True)])
        else:
            raw = data.tobytes()
            parts = self._ids([raw[low:high] for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            which, cuts = np.arange(len(parts)), np.arange(len(parts) + 1)
        flat = np.frombuffer(b"".join(parts), "<u4")
        size = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        first = np.cumsum(size) - size
        many = size[which]
        ends = np.r_[0, np.cumsum(many)]
        at = np.arange(ends[-1]) + np.repeat(first[which] - ends[:-1], many)
        return flat[at], np.diff(ends[cuts])


@lru_cache(maxsize=1)
def _encoder(model: str, by_word: bool, marks: str) -> Encoder:
    """The encoder of this Python worker, which goes on to the worker's next task with the words it knows."""
    return Encoder(model, by_word, marks)


def _encoded(model: str, end_id: int, by_word: bool, marks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, chunk, at = None, None, 0
        for batch in batches:
            encoder = encoder or _encoder(model, by_word, marks)
            chunks = batch.column(0).to_numpy()
            for first, end, data, offsets in slices(batch.column(2), SLICE):
                ids, sizes = encoder.encode(data, offsets)
                ids = np.insert(ids.astype(np.int32), np.cumsum(sizes), end_id)
                sizes = sizes + 1
                stop = np.cumsum(sizes)
                own = chunks[first:end]
                # Each chunk counts from 0; the first of the slice may go on from the last slice.
                new = np.flatnonzero(np.r_[own[0] != chunk, own[1:] != own[:-1]])
                since = np.zeros(len(own), np.int64)
                since[:] = -at
                for place in new:
                    since[place:] = stop[place] - sizes[place]
                chunk, at = own[-1], int(stop[-1] - since[-1])
                bounds = np.r_[0, stop].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own), batch.column(1).slice(first, end - first), pa.array(stop - sizes - since),
                        pa.array(stop - since), pa.array(sizes), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids)),
                    ],
                    ["chunk", "doc_id", "start", "stop", "n_tokens", "ids"],
                )

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    end_id: int = 1,
    by_word: bool = False,
    marks: str = "",
    group_docs: int = 4096,
    page_docs: int = 64,
) -> None:
    """Encode every text of ``docs`` (doc_id, text) and write the ids, each list closed by ``end_id``.

    Documents are written in ascending doc_id; rows of equal doc_id follow one another
    by a hash of their texts, and null ids come first. Null texts are empty and bytes
    that are no UTF-8 count as replacement characters. Further columns are ignored, and
    an empty table gives a set without chunks.

    Columns: doc_id; n_tokens; start and stop, the places of the document's ids among
    those of its chunk; ids. Ids are dictionary encoded, the numbers delta encoded. A row
    group holds ``group_docs`` documents at most and a page ``page_docs``; page bounds
    stand in the file's page index, so a reader of some documents decodes their pages alone.

    The order is cut into even chunks by bounds from a sample, so one shuffle of texts
    places each row, a third of all rows under one doc_id included as far as their texts
    differ. Texts are encoded by the task that writes them; it holds a slice of them.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        model = file.read()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("draw", F.xxhash64("text"))
    files = max(shuffle_width(spark), -(-docs.count() // FILE_DOCS))
    chunks = ordered_chunks(docs, [], ["doc_id", "draw"], chunks=files)
    dealt = chunks.repartitionById(files, F.col(CHUNK)).sortWithinPartitions(CHUNK, "doc_id", "draw", "text")
    ids = dealt.select(F.col(CHUNK).alias("chunk"), "doc_id", "text").mapInArrow(_encoded(model, end_id, by_word, marks), TOKENS)
    writer = (
        ids.write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.row.count.limit", group_docs)
        .option("parquet.page.row.count.limit", page_docs)
    )
    for name in ("doc_id", "start", "stop", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.parquet(f"{path}/tokens")
    # Written last: a folder without it is an unfinished set.
    sizes = _rows(spark, path).groupBy("chunk").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    before = F.sum("tokens").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    sizes.select("chunk", F.coalesce(before, F.lit(0)).alias("base"), "tokens", "docs").coalesce(1).write.parquet(f"{path}/chunks")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS).parquet(f"{path}/tokens")


def token_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, base, tokens, docs): one row per file; ``base`` is the place of its first id."""
    return spark.read.schema(CHUNKS).parquet(f"{path}/chunks")


def token_lists(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a set; ``start`` counts from the set's first id.

    Columns not asked for are not read: metadata come without any id, and a filter on
    doc_id reaches row groups and pages.
    """
    base = token_chunks(spark, path).select("chunk", "base")
    return _rows(spark, path).join(base, "chunk").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def token_span(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """(doc_id, start, ids): the ``count`` ids from place ``first`` on, by document.

    Places are looked up among the chunks (one small row per file met) and become
    filters on start and stop, which reach the pages of the ids wanted.
    """
    end = first + count
    met = token_chunks(spark, path).where((F.col("base") < end) & (F.col("base") + F.col("tokens") > first)).collect()
    inside = F.lit(False)
    for row in met:
        inside = inside | ((F.col("chunk") == row.chunk) & (F.col("start") < end - row.base) & (F.col("stop") > first - row.base))
    base = F.element_at(F.create_map(*[F.lit(x) for row in met for x in (row.chunk, row.base)]), F.col("chunk")) if met else F.lit(0)
    rows = _rows(spark, path).where(inside).withColumn("start", F.col("start") + base)
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    wanted = F.least(F.col("n_tokens"), F.lit(end) - F.col("start")) - skip
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), wanted.cast("int")).alias("ids"))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        flat = np.ascontiguousarray(ids.flatten().to_numpy().astype("<u4")).view(np.uint8)
        bounds = ids.offsets.to_numpy().astype(np.int64)
        bounds = 4 * (bounds - bounds[0])
        sums = [zlib.crc32(flat[low:high]) for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(lists: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): crc32 of the ids as little-endian 32-bit integers."""
    rows = lists.select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(_checked, "doc_id long, start long, n_tokens long, ids_crc32 long")
