"""Ranked search against its SQL, and against plain loops on odd tables with small parts and blocks."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest

import meterline.llm.ranked as ranked
from meterline.llm.queries import QUERIES
from meterline.llm.sql import ORACLE_SQL
from tests.compare import TESTDATA, oracle, oracle_rows, spark_rows


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, most=10):
    bags = [(name, Counter(words(text))) for name, text in docs]
    bags = [(name, bag, sum(bag.values())) for name, bag in bags if bag]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(w for _, bag, _ in bags for w in bag)
    wanted = {}
    for name, text in items:
        if name is not None:
            wanted.setdefault(name, set()).update(words(text))
    for name, terms in wanted.items():
        scores = []
        for doc, bag, n in bags:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * bag[w] // (1000 * bag[w] + 8 * m))
                for w in terms if w in bag
            )
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        for rank, (score, doc) in enumerate(sorted(scores)[:most], 1):
            yield name, rank, doc, -score


def found(spark, scratch, docs, items, **more):
    result = ranked.ranked(ranked.length_index(docs, scratch), items, scratch, **more)
    return sorted(tuple(row) for row in result.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    with oracle(sf) as connection:
        names, want = oracle_rows(connection, ORACLE_SQL["op12_ranked_search"])
    assert (names, want) == spark_rows(QUERIES["op12_ranked_search"](spark, f"{TESTDATA}/{sf}"))


def test_odd_rows_small_parts_and_blocks(spark, scratch, docs, plain_docs, monkeypatch):
    """Null and repeated ids, empty and very long texts, one length that most documents have."""
    monkeypatch.setattr(ranked, "PART_TERMS", 500)
    monkeypatch.setattr(ranked, "SEARCH_POSTINGS", 3000)
    monkeypatch.setattr(ranked, "ITEMS", 7)
    copies = [(2000 + i, f"The same LENGTH é{i % 7}") for i in range(150)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + copies
    frame = spark.createDataFrame([(*row, 1, 2, 3, "x") for row in rows], "doc_id long, text string, n int, terms int, m int, part string")
    items = [(f"i{i}", text) for i, (_, text) in enumerate(plain_docs[:20])]
    items += [("i3", "more of word"), ("none", None), ("none2", " ,.!"), (None, "the word"), ("odd", "É é3 THE zzz same"), ("word", "word")]
    asked = spark.createDataFrame([(*item, 1, 2) for item in items], "item_id string, text string, doc_id int, score int")
    assert found(spark, scratch, frame, asked) == sorted(plain(rows, items))
    assert found(spark, scratch, frame, asked, most=1) == sorted(plain(rows, items, 1))


def test_empty_tables(spark, scratch):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a", "b")], "item_id string, text string")
    some = spark.createDataFrame([(1, "b"), (2, None)], "doc_id long, text string")
    assert found(spark, scratch, docs, items) == []
    assert found(spark, scratch, some, items.limit(0)) == []
    assert found(spark, scratch, some, items) == [("a", 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // 1800))]


def test_lengths_are_counted_over_bytes():
    """As many terms as plain loops find, whatever stands at the ends of rows and slices; null and empty texts have no length."""
    texts = ["", None, "a", " a", "a ", "Zé9", "z", "[é]`x`@y", "\x00\x7f", "é" * 5, "a b " * 70000, "b", " ", "0/9:A", "漢 字-ß_"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts).slice(1)], ["text"])
    got = Counter()
    for out in ranked._lengths([batch, batch.slice(3, 6), batch.slice(0, 0)]):
        got.update(dict(zip(*(column.to_pylist() for column in out.columns), strict=True)))
    want = Counter(len(words(text)) for text in texts[1:] + texts[4:10])
    assert got == Counter({n: docs for n, docs in want.items() if n})


def test_no_pattern_is_matched_over_the_texts(spark, scratch, docs, monkeypatch):
    """A pattern over every text took more time than all the rest of the search."""
    plans, table = [], scratch.table
    monkeypatch.setattr(scratch, "table", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or table(df))
    ranked.length_index(docs, scratch)
    assert plans and not any("regexp" in plan for plan in plans)
