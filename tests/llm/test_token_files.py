"""Token files against the tokenizers library on whole texts, read whole and in part."""

import glob
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import meterline.llm.token_files as token_files
from meterline.llm.queries import MARKS, QUERIES, TOKENIZER
from meterline.session import scratch_dir
from tests.compare import TESTDATA

BYTES = TOKENIZER.replace("word_bpe_49k", "byte_bpe_50k")


def plain(rows, tokenizer=TOKENIZER, end_id=1):
    """(doc_id, ids) of whole texts in the order of the files, ties left in any order."""
    library = Tokenizer.from_file(tokenizer)
    rows = sorted(rows, key=lambda row: (row[0] is not None, row[0]))
    return [(name, library.encode(text or "", add_special_tokens=False).ids + [end_id]) for name, text in rows]


def checked(found, want):
    """The same lists under each id, and places that follow one another in the order of ids."""
    at, got = 0, sorted(found, key=lambda row: row.start)
    assert [row.doc_id for row in got] == [name for name, _ in want]
    for row in got:
        assert row.start == at
        at += row.n_tokens
    lists = sorted((str(row.doc_id), tuple(row.ids)) for row in got)
    assert lists == sorted((str(name), tuple(ids)) for name, ids in want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    rows = spark.read.parquet(f"{TESTDATA}/{sf}/documents.parquet").select("doc_id", "text").collect()
    at, want = 0, []
    for name, ids in plain([tuple(row) for row in rows]):
        want.append((name, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = QUERIES["op13_token_files"](spark, f"{TESTDATA}/{sf}")
    assert sorted(tuple(row) for row in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


ODD_WORDS = [
    "a<|endoftext|>b  <|startoftext|> ", "é ́x é y z", "x" * 3000 + " 'LL don't İI ΣΑΣ ς", "１２ 12a_b--c\x1c\x85d", "a|b | c |", "x.y,.z's.'ll (e\u0301)! -\u0301a .\u0338b;\u037e k.K\u212a", "한 ᆫ 漢字 🙂🙂 a\tb\r\nc",
]


@pytest.mark.parametrize("tokenizer, by_word, marks", [(TOKENIZER, True, ""), (TOKENIZER, True, MARKS + "<|>"), (TOKENIZER, False, ""), (BYTES, False, "")])
def test_odd_rows(spark, docs, monkeypatch, tokenizer, by_word, marks):
    """Nulls, empty and very long texts, repeated ids, odd characters, clashing names, little memory."""
    monkeypatch.setattr(token_files, "REMEMBERED", 2000)
    extra = spark.createDataFrame(list(enumerate(ODD_WORDS, 5000)) + [(5000, "x"), (None, "")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    frame = rows.selectExpr("*", "1 as chunk", "2 as start", "3 as ids", "4 as _chunk", "5 as draw")
    path = scratch_dir(spark, "tokens")
    token_files.write_token_files(frame, path, tokenizer, by_word=by_word, marks=marks, end_id=7)
    checked(token_files.token_lists(spark, path).collect(), plain([tuple(row) for row in rows.collect()], tokenizer, 7))


def test_layout_and_selective_reads(spark):
    path = scratch_dir(spark, "tokens")
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    token_files.write_token_files(docs, path, TOKENIZER, by_word=True, group_docs=40, page_docs=8)
    files = sorted(glob.glob(f"{path}/tokens/part-*".removeprefix("file:")))
    last = -1
    for name in files:
        file = pq.ParquetFile(name)
        for group in range(file.metadata.num_row_groups):
            row_group = file.metadata.row_group(group)
            assert row_group.num_rows <= 40
            columns = {row_group.column(i).path_in_schema: row_group.column(i) for i in range(row_group.num_columns)}
            assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
            for number in ("doc_id", "start", "stop", "n_tokens"):
                assert columns[number].encodings == ("DELTA_BINARY_PACKED",)
                assert columns[number].has_offset_index and columns[number].has_column_index
            assert columns["doc_id"].statistics.min > last  # files and groups follow the order
            last = columns["doc_id"].statistics.max

    lists = token_files.token_lists(spark, path)
    whole = {row.doc_id: row for row in lists.collect()}
    assert "ids" not in lists.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1]
    some = lists.where("doc_id between 100 and 103")
    assert "GreaterThanOrEqual(doc_id,100)" in some._jdf.queryExecution().executedPlan().toString()
    assert {row.doc_id: row for row in some.collect()} == {name: row for name, row in whole.items() if 100 <= name <= 103}

    flat = [i for row in sorted(whole.values(), key=lambda row: row.start) for i in row.ids]
    assert token_files.token_chunks(spark, path).agg({"tokens": "sum", "docs": "sum"}).first() == (len(whole), len(flat))
    for first, count in ((0, 1), (12345, 9000), (len(flat) - 5, 100), (len(flat), 3), (0, len(flat)), (7, 0)):
        span = sorted(token_files.token_span(spark, path, first, count).collect(), key=lambda row: row.start)
        assert [i for row in span for i in row.ids] == flat[first : first + count]
        assert all(flat[row.start : row.start + len(row.ids)] == row.ids for row in span)


def test_empty_table(spark):
    path = scratch_dir(spark, "tokens")
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, TOKENIZER)
    assert token_files.token_digests(token_files.token_lists(spark, path)).collect() == []
    assert token_files.token_span(spark, path, 0, 5).collect() == []


def test_words_of_much_text_are_looked_up_once(monkeypatch):
    """Cuts by arrays alone give the ids of whole texts; 2 MB of text are one slice."""
    encoder = token_files.Encoder(open(TOKENIZER).read(), True, MARKS)
    plain = token_files.Encoder(open(TOKENIZER).read(), False)
    texts = ["", " ", "a.b,c", "end.", " the (the) ", ".", "naïve—x", "x\n\ny"]
    raw = [text.encode() for text in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
    for got, want in zip(encoder.encode(data, offsets), plain.encode(data, offsets), strict=True):
        assert got.tolist() == want.tolist()
    asked, words = [], token_files.Encoder._words
    monkeypatch.setattr(token_files.Encoder, "_words", lambda self, distinct: asked.append(len(distinct)) or words(self, distinct))
    column = pa.array(["the same few words " * 50] * 2200)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 2200, pa.int32()), pa.array(range(2200), pa.int64()), column], ["chunk", "doc_id", "text"])
    out = list(token_files._encoded(open(TOKENIZER).read(), 1, True, MARKS)([batch]))
    assert sum(x.num_rows for x in out) == 2200 and asked == [4]


def test_a_worker_goes_on_with_the_words_it_knows(monkeypatch):
    """A task that follows another in one worker loads no tokenizer and encodes only new words."""
    model = open(TOKENIZER).read() + " "
    asked, many = [], token_files.Encoder._many
    monkeypatch.setattr(token_files.Encoder, "_many", lambda self, words: asked.append(sorted(words)) or many(self, words))
    want = token_files.Encoder(model, False)
    for texts in (["one two"], ["two three one", None], ["three"]):
        batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts), pa.int32()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["chunk", "doc_id", "text"])
        (out,) = token_files._encoded(model, 1, True, MARKS)([batch])
        assert out.column(5).to_pylist() == [want.tokenizer.encode(text or "").ids + [1] for text in texts]
    assert asked == [[b"one", b"two"], [b"three"]]


@pytest.mark.parametrize("change", [None, {"normalizer": None}, {"added": "wor"}, {"pre_tokenizer": {"type": "WhitespaceSplit"}}])
def test_words_of_letters_by_the_model(change):
    """The model alone gives the library's ids; with other steps before it, or an added token of letters, it is not asked alone."""
    model = json.loads(open(TOKENIZER).read())
    if change and "added" in change:
        model["added_tokens"].append({**model["added_tokens"][0], "id": 49408, "content": change["added"]})
    else:
        model |= change or {}
    encoder = token_files.Encoder(json.dumps(model), True)
    assert encoder.is_known == (change is None)
    words = [b"word", b"Word", b"WORDS", b"x" * 700, b"don", b"s", b"ll", "naïve".encode(), b"swords", b"<|endoftext|>", b"it's"]
    words += [word.encode() for word in ("ÀÉÎÕÜß", "ÿ×÷þÞ", "Ciónllñ,", "a$$$", "x.***", "é\u0301", "e\u0301!", "a.\u0338", "z=\u0338", "a|", "b<|>", "don't", "l'", "ŝĥo", "µªº", "x\u212a", "a_b", "a1!", "!!")]
    library = Tokenizer.from_str(json.dumps(model))
    got = encoder._many(words)
    assert {word: np.frombuffer(ids, "<u4").tolist() for word, ids in got.items()} == {word: library.encode(word.decode(), add_special_tokens=False).ids for word in words}
