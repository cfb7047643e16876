"""Operators against plain Python over small tables, odd rows included."""

import hashlib
import random
import re
from collections import Counter

import pytest

from meterline.llm.decontam import contamination
from meterline.llm.ledger import POLICY, ablation, ledger, passes
from meterline.llm.lines import repeated_lines, without_lines
from meterline.llm.neardup import near_duplicates


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def joined(sets, percent=80):
    """Least member of each set's component over links of enough similarity."""
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = {}
    for x, own in sets.items():
        for s in own:
            having.setdefault(s, []).append(x)
    for x, own in sets.items():
        for y, m in Counter(y for s in own for y in having[s] if y < x).items():
            if 100 * m >= percent * (len(own) + len(sets[y]) - m):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {x: find(x) for x in sets}


def test_near_duplicates(docs, plain_docs, scratch):
    sets = {}
    for name, text in plain_docs:
        words = spaced(lower(text))
        sets[name] = {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) > 3 else {tuple(words)} - {()}
    want = joined({k: v for k, v in sets.items() if k is not None})
    got = near_duplicates(docs, scratch, k=4).collect()
    assert len(got) == len(plain_docs)
    for row in got:
        assert row.n_shingles == len(sets[row.doc_id])
        assert row.component_id == want.get(row.doc_id)
        assert row.kept == (row.doc_id is None or row.doc_id == row.component_id)


def test_repeated_lines(docs, plain_docs, scratch):
    places = {}
    for name, text in plain_docs:
        for i, line in enumerate(text.split("\n")):
            line = line.strip(" \t\n\v\f\r")
            if len(line) >= 25 and name is not None:
                places.setdefault(line, set()).add((name, i))
    group = joined({x: {x[i : i + 8] for i in range(len(x) - 7)} for x in places})
    first, want = {}, {}
    for line, own in places.items():
        first[group[line]] = min(min(own), first.get(group[line], min(own)))
    for line, own in places.items():
        for name, i in own - {first[group[line]]}:
            want.setdefault(name, []).append(i)
    removed = repeated_lines(docs, scratch)
    assert {r.doc_id: list(r.removed) for r in removed.collect()} == {k: sorted(v) for k, v in want.items()}
    after = without_lines(docs, removed)
    assert after.columns == docs.columns
    assert after.count() == len(plain_docs)


SHORT = [
    (910, "Home\nAll rights reserved.\n版权所有 保留一切权利\nBack to the top page\n\n--"),
    (911, "All rights reserved.\n Home\t\nhome\n版权所有 保留一切权利\nBack to the top pages\n--"),
    (912, "版权所有 保留一切权\n\u00a0\nHome page\nHome\nSkip to content"),
    (913, "Skip to content\nSkip to contents\nNext\n\n\u00a0"),
]


def test_repeated_lines_of_any_length(spark, docs, plain_docs, scratch):
    more = spark.createDataFrame(SHORT, "doc_id long, text string")
    places = {}
    for name, text in plain_docs + SHORT:
        for i, line in enumerate(text.split("\n")):
            line = line.strip(" \t\n\v\f\r")
            if line and name is not None:
                places.setdefault(line, set()).add((name, i))
    group = joined({x: {x[i : i + 8] for i in range(len(x) - 7)} or {x} for x in places})
    first, want = {}, {}
    for line, own in places.items():
        first[group[line]] = min(min(own), first.get(group[line], min(own)))
    for line, own in places.items():
        for name, i in own - {first[group[line]]}:
            want.setdefault(name, []).append(i)
    removed = repeated_lines(docs.select("doc_id", "text").unionByName(more), scratch, least=1)
    got = {r.doc_id: list(r.removed) for r in removed.collect()}
    assert got == {k: sorted(v) for k, v in want.items()}
    assert {0, 1, 3, 5} <= set(got[911]) and 2 not in got[911]


def test_registered_line_queries_compare_short_lines(spark, tmp_path):
    import __spark_entry__
    import corpus_pipeline

    docs = spark.createDataFrame(SHORT, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed for r in __spark_entry__.queries()["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert got[910] == [] and {0, 1, 3, 5} <= set(got[911])
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert "All rights" in left[910] and "All rights" not in left[911]


@pytest.mark.parametrize("block", [500_000, 700])
def test_contamination(spark, docs, plain_docs, scratch, block):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("item_id", "text", "1 as n")
    items = items.unionByName(spark.createDataFrame([(70, "and again", 1), (71, None, 1), (72, "", 1), (None, "word", 1)], items.schema))
    windows = {}
    for r in items.where("item_id is not null").collect():
        own = words(r.text or "")
        for i in range(max(1, len(own) - 12) if own else 0):
            windows.setdefault(tuple(own[i : i + 13]), set()).add(str(r.item_id))
    got = contamination(docs, items, scratch, block_windows=block).collect()
    assert len(got) == len(plain_docs)
    found = {(r.doc_id, r.n_words): r for r in got}
    for name, text in plain_docs:
        own, hit, names = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                if some := windows.get(tuple(own[i : i + size])):
                    names |= some
                    hit.update(range(i, i + size))
        r = found[name, len(own)]
        assert (r.n_hit, r.n_items) == (len(hit), len(names))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert r.contaminated == (bool(hit) and 20 * len(hit) >= len(own))


def test_ledger_and_ablation(docs, plain_docs):
    book = ledger(docs).cache()
    rows = book.withColumn("kept", passes(POLICY)).collect()
    assert len(rows) == len(plain_docs)
    by_key = {(r.doc_id, r.n_words): r for r in rows}
    for name, text in plain_docs:
        own = spaced(text)
        times = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
        again = {j for i in range(len(own) - 2) if times[tuple(own[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert by_key[name, len(own)].n_repeat_words == len(again)
    for r in ablation(book, POLICY).collect():
        assert r.n_kept == sum(x.kept for x in rows)
        assert r.n_kept_without == r.n_kept + r.n_only


def test_lines_of_a_large_group_are_not_all_paired(spark, scratch, monkeypatch):
    """Lines of one large group in many components: few pairs go to the exact join, and none is lost."""
    import meterline.llm.lines as lines

    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200))

    def edited():
        at = rng.sample(range(len(base)), rng.randint(0, 4))
        return "".join("#" if i in at else ch for i, ch in enumerate(base))

    texts = [edited() for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rare, made = lines._rare_pairs, []

    def counted(sets, percent, folder):
        pairs = rare(sets, percent, folder)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(lines, "_rare_pairs", counted)
    got = {r.doc_id for r in repeated_lines(docs, scratch).collect()}

    sets = [{t.strip()[i : i + 8] for i in range(len(t.strip()) - 7)} for t in texts]
    lowest = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((lowest[i], lowest[j]))
                lowest = [low if x == high else x for x in lowest]
    assert got == {i for i, low in enumerate(lowest) if low != i}
    assert sum(made) < len(texts)
