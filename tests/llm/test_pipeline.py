"""Stages of the pipeline on odd tables, and faults of operators that it or its queries had."""

import pytest

import corpus_pipeline
from meterline.llm.lines import without_lines
from meterline.llm.pieces import CACHED_CHARS, Encoder, _Words, load_model
from meterline.llm.pu_quality import quality_scores
from meterline.llm.queries import MODEL
from meterline.llm.redirects import page_verdicts

SF = "/root/testdata/sf0.001"
LINE = "one line of many words that stands in two of these documents"
TEXT = " ".join(f"word{i}" for i in range(60))
CLASHES = ["'r' as removed", "'l' as lines", "'o' as of", "1 as n", "'k' as key", "2 as id", "3 as component", "'w' as row", "'x' as _lines", "5 as copies"]


def odd(spark):
    rows = [(1, TEXT), (1, TEXT), (2, TEXT), (3, None), (4, ""), (4, ""), (None, TEXT), (None, TEXT), (5, LINE + "\n" + "a b c " * 50), (6, LINE), (7, " \n\t"), (8, "long " * 40000), (9, "é\u0000ß"), (10, TEXT + " and a tail")]
    return spark.createDataFrame([(*row, len(row[1] or "")) for row in rows], "doc_id long, text string, n_chars long").selectExpr("*", *CLASHES)


def content(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text is not None, r.text or "") for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, name, stage):
    docs = odd(spark).limit(0)
    out = stage(spark, docs, SF)
    assert out.count() == 0
    assert name == "pieces" or out.columns == docs.columns


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_keeps_columns_of_any_name(spark, name, stage):
    docs = odd(spark)
    plain, more = stage(spark, docs.select("doc_id", "text", "n_chars"), SF), stage(spark, docs, SF)
    if name == "pieces":
        assert more.where("round_trip").count() == plain.count() == docs.count()
        return
    assert more.columns == docs.columns and content(more) == content(plain)
    for column in ("removed", "lines", "of", "row"):
        assert {r[0] for r in more.select(column).collect()} <= {r[0] for r in docs.select(column).collect()}


def test_lines_and_near_copies_of_odd_rows(spark):
    docs = odd(spark)
    assert [r for r in content(corpus_pipeline.line_dedup(spark, docs, SF)) if r[1] in (5, 6)] == [(False, 5, True, docs.where("doc_id = 5").first().text)]
    rows = content(corpus_pipeline.near_dedup(spark, docs, SF))
    assert [r[1] for r in rows if not r[0]] == [1, 3, 4, 5, 6, 7, 8, 9]  # one row of ids 1 and 4, no 2 and no 10
    assert sum(r[0] for r in rows) == 2


def test_lines_taken_out(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "x"), (2, "a", "y"), (None, "a", "z"), (3, None, "w")], "doc_id long, text string, removed string")
    gone = spark.createDataFrame([(1, [0, 2]), (2, [0]), (3, [0])], "doc_id long, removed array<int>")
    got = {r.removed: r.text for r in without_lines(docs, gone).collect()}
    assert got == {"x": "b", "y": "", "z": "a", "w": None}


def test_quality_where_every_document_is_labelled(spark):
    """Labels cover the table; the unlabelled side is drawn from all of it, labels unread."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    every = docs.select("doc_id").join(known, "doc_id", "left").selectExpr("doc_id", "coalesce(quality, 0) as quality")
    scored = quality_scores(docs, every).where("held_out").join(known, "doc_id").collect()
    good, poor = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    assert sum(g > p for g in good for p in poor) > 0.97 * len(good) * len(poor)


def test_a_host_keeps_its_only_name(spark, scratch):
    link = '<link rel="canonical" href="http://blocked.com/de/">'
    urls = ["mobile.de/auto", "amp.de/auto", "de/auto", "m.net/a", "www.net/a", "net/a", "www.x.net/b", "m.x.net/b", "x.net/b"]
    for linked, same in ((0, {0}), (3, {3}), (6, {6, 7, 8})):
        rows = [(i, f"http://{url}", link if i == linked else None) for i, url in enumerate(urls)]
        got = page_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch)
        assert {r.page_id for r in got.collect() if r.verdict == "block"} == same


def test_words_are_remembered_within_bounds(monkeypatch):
    import meterline.llm.pieces as pieces

    monkeypatch.setattr(pieces, "CACHED_WORDS", 20)
    words, fresh = _Words(Encoder(load_model(MODEL))), _Words(Encoder(load_model(MODEL)))
    for i in range(40):
        texts = [f"some words {j} and {'x' * (CACHED_CHARS + j)} again" for j in range(i, i + 5)]
        fresh.clear()
        for got, want in zip(words.ids(texts), fresh.ids(texts), strict=True):
            assert got.tolist() == want.tolist()
        assert len(words.place) < 60 and max(map(len, words.place)) <= CACHED_CHARS


def test_words_asked_for_are_not_worked_out_again(monkeypatch):
    import meterline.llm.pieces as pieces

    monkeypatch.setattr(pieces, "CACHED_WORDS", 20)
    words, seen = _Words(Encoder(load_model(MODEL))), []
    search = words.encoder.encode
    monkeypatch.setattr(words.encoder, "encode", lambda some: seen.extend(some) or search(some))
    for i in range(40):
        words.ids([f"common words and rare{i}{j}" for j in range(8)])
    assert all(seen.count(word) == 1 for word in ("▁common", "▁words", "▁and"))
    assert len(words.place) < 60
