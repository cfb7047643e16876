"""Round trips, held-out accuracy, small fixtures, and the registered queries."""

import ipaddress
import os
import re

import numpy as np
import pytest
import regex

import __spark_entry__ as entry_module
import corpus_pipeline
from meterline.llm.labelled import is_held_out
from meterline.llm.notices import NoticeFinder, license_notices
from meterline.llm.pieces import Encoder, decoded, encoded, load_model
from meterline.llm.pu_quality import good_rows, quality_scores
from meterline.llm.queries import MODEL
from meterline.llm.redirects import page_verdicts
from meterline.llm.surrogates import ANY, KINDS, pseudonymised
from meterline.llm.toxicity import toxicity_scores
from tests.compare import oracle, oracle_rows, spark_rows

SF = "/root/testdata/sf0.01"
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")


@needs_model
def test_pieces_round_trip(docs, plain_docs):
    rows = encoded(docs, MODEL).cache()
    assert rows.where("round_trip").count() == len(plain_docs)
    back = decoded(rows, MODEL).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in back) == sorted((a is None, a or 0, b) for a, b in plain_docs)


@needs_model
def test_shared_search_equals_plain_search():
    model = load_model(MODEL)
    coder = Encoder(model)
    score = {p: (s, i) for i, (p, s, k) in enumerate(zip(model["pieces"], model["scores"], model["kinds"], strict=True)) if k == 1}
    words = sorted(set(coder.split("the then thenable theñ ñandú\nnaïve  two   spaces 執筆 x☃y ☃☃ unbelievably")))
    for word, ids in zip(words, coder.encode(words), strict=True):
        best = [(0.0, [])] + [None] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - 16), end):
                piece = word[start:end]
                gain = score.get(piece) or ((coder.unknown_score, None) if end - start == 1 else None)
                if gain and (best[end] is None or best[start][0] + gain[0] > best[end][0]):
                    raw = [gain[1]] if gain[1] is not None else [coder.bytes[b] for b in piece.encode()]
                    best[end] = (best[start][0] + gain[0], best[start][1] + raw)
        assert ids == best[-1][1]


def test_quality_and_toxicity_on_held_out_rows(spark, docs):
    rows, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for scored, column, least in ((quality_scores(rows, labels), "quality", 0.98), (toxicity_scores(rows, labels), "toxic", 0.9)):
        told = scored.where("held_out").join(labels, "doc_id").selectExpr(f"avg(cast(predicted = {column} as int))").first()[0]
        assert told >= least
    assert toxicity_scores(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert quality_scores(docs, labels.limit(0)).where("score <> 0.5").count() == 0
    assert good_rows(docs, labels.limit(0)).count() == docs.count()
    assert docs.where(is_held_out()).count() > 0


def test_surrogates(spark, scratch):
    text = "Mail a.b@x1.org or A.B@x1.org, call +1 (283) 555-6500, 10.1.2.3, 4111 1111 1111 1111. Mrs Anna Berg met г-н Иван Петров."
    rows = [(1, text), (2, text + " a.b@x1.org"), (3, None), (4, ""), (4, ""), (None, "x a.b@x1.org")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as entity", "2 as told")
    got = {r.doc_id: r for r in pseudonymised(frame, scratch, key="k").collect()}
    assert got[3].text is None and got[4].text == ""
    old, new = re.findall(r"\S+@\S+(?<!,)", text), re.findall(r"[\w.]+@[\w.]+", got[1].text)
    assert len(set(new)) == 2 and not set(new) & set(old)
    assert got[2].text == got[1].text + " " + new[0] and got[None].text == "x " + new[0]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1].text) and "555-6500" not in got[1].text
    digits = [int(d) for d in re.search(r"4\d{3} \d{4} \d{4} \d{4}", got[1].text)[0] if d != " "][::-1]
    assert sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2]) in range(0, 999, 10)
    assert re.search(r"Mrs [A-Z][a-z]+ [A-Z][a-z]+ met г-н [А-Я][а-яё]+ [А-Я][а-яё]+\.$", got[1].text)
    assert ANY and got[1].n_entities == 7


def test_surrogates_of_one_entity_in_several_formats(spark, scratch):
    same = [
        ("Mrs Anna Berg", "Mrs Berg", "Mrs. Berg", "Mr. Berg", "Mr Berg"), ("4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"),
        ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000"), ("+49 (30) 123-4567", "+49 30 123 45 67", "+49301234567"),
    ]
    rows = [(i, " ; ".join(mentions)) for i, mentions in enumerate(same)]
    rows += [(8, "Password: ________ and token = ......"), (9, "Mr " + " ; Mr ".join("Berg" + c for c in "abcdefgh"))]
    got = {r.doc_id: r for r in pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), scratch, key="k").collect()}
    assert [got[i].n_entities for i in range(4)] == [len(m) for m in same]
    assert len({m.split()[-1] for m in got[0].text.split(" ; ")}) == 1 and "Berg" not in got[0].text
    for i in (1, 2, 3):
        fresh = got[i].text.split(" ; ")
        assert len({re.sub(r"[^0-9A-Z]", "", m) for m in fresh}) == 1 and got[i].text != rows[i][1]
        assert [re.sub(r"[0-9]", "0", m) for m in fresh] == [re.sub(r"[0-9]", "0", m) for m in same[i]]
    assert (got[8].text, got[8].n_entities) == (rows[4][1], 0)
    assert len(set(got[9].text.split(" ; "))) == 8


def test_names_without_their_title(spark, scratch):
    rows = [
        (1, "Anna Berg ; Mrs Anna Berg ; ANNA BERG ; Berg ; Bergen ; Dr. Anna Berg ; a berg"), (2, "Anna Berg and Berg, untitled"),
        (3, "Mr Jean-Luc Picard ; Ms O'Neil ; Mrs ANNA BERG ; Picard's ; O'Neil"), (4, "Prof Wu Li ; 5 M USD ; Sr. ENGINEER"), (5, None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' as names", "1 as bare")
    got = {r.doc_id: r for r in pseudonymised(frame, scratch, key="k").collect()}
    fresh = got[1].text.split(" ; ")
    given, family = fresh[0].split(" ")
    assert fresh == [f"{given} {family}", f"Mrs {given} {family}", f"{given} {family}".upper(), family, "Bergen", f"Dr. {given} {family}", "a berg"]
    assert {given, family} & {"Anna", "Berg"} == set() and got[1].n_entities == 5
    assert (got[2].text, got[2].n_entities) == (rows[1][1], 0)
    picard, neil, anna, again, neil_again = got[3].text.split(" ; ")
    assert not re.search("Luc|Jean|Picard|Neil|Socen.*-", got[3].text) and again == picard.split(" ")[2] + "'s"
    assert neil == "Ms " + neil_again and anna == "Mrs " + f"{given} {family}".upper()
    assert got[4].text.endswith(" ; 5 M USD ; Sr. ENGINEER") and got[4].n_entities == 1 and "Li" not in got[4].text.split(" ")


def test_secrets_by_value_and_addresses_by_meaning(spark, scratch):
    rows = [
        (1, 'password=hunter22 ; pwd: hunter22 ; Password = "hunter22" ; token=hunter23'), (2, "A.B@X1.org ; A.B@x1.org ; a.b@x1.org"),
        (3, "2001:db8::1 ; 2001:0DB8:0:0:0:0:0:1 ; 2001:db8::2 ; fe80::a:b ; at 10:20:30 ; std::cd ; a::b"),
    ]
    got = {r.doc_id: r for r in pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), scratch, key="k").collect()}
    a, b, c, d = (re.sub(r'^[A-Za-z]+ ?[=:] ?"?|"$', "", x) for x in got[1].text.split(" ; "))
    assert a == b == c != d and "hunter" not in got[1].text and got[1].text.startswith("password=") and ' ; Password = "' in got[1].text
    one, two, three = got[2].text.split(" ; ")
    assert one == two != three and "X1" not in one
    v6 = got[3].text.split(" ; ")
    assert ipaddress.ip_address(v6[0]) == ipaddress.ip_address(v6[1]) != ipaddress.ip_address(v6[2]) and "::" in v6[0] and "::" not in v6[1]
    assert len({*v6[:4]} | {*rows[2][1].split(" ; ")[:4]}) == 8 and v6[4:] == ["at 10:20:30", "std::cd", "a::b"]


def test_surrogates_over_a_whole_table(spark, scratch):
    """No entity stays, one surrogate for each entity, different ones for different entities."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    new = {r.doc_id: r for r in pseudonymised(rows, scratch, key="k").collect()}
    told = {}
    for row in rows.collect():
        found = [m[0] for m in regex.finditer(ANY.replace("IsCyrillic", "Cyrillic"), row.text or "")]
        if not any(regex.match(KINDS["name"], m) for m in found):
            assert new[row.doc_id].n_entities == len(found)
            at, text = 0, new[row.doc_id].text
            for around, m in zip(regex.split(ANY, row.text or ""), [*found, ""], strict=True):
                assert text.startswith(around, at)
                at += len(around)
                fresh = regex.compile(ANY).match(text, at)
                if m:
                    assert fresh and fresh[0] != m
                    told.setdefault(m, set()).add(fresh[0])
                    at = fresh.end()
    assert told and all(len(x) == 1 for x in told.values())
    assert len({next(iter(x)) for x in told.values()}) == len(told)


def test_surrogates_of_a_used_up_space(spark, scratch):
    names = [(1, f"token=_____{c}") for c in "abcdefghijklmnopqrstuvwxyz"] + [(1, f"Mr {a} Berg") for a in ("Aa Bb Cc Dd Ee Ff Gg Hh Ii Jj Kk Ll Mm Nn Oo Pp Qq Rr").split()]
    text = " ; ".join(n for _, n in names)
    out = pseudonymised(spark.createDataFrame([(1, text)], "doc_id long, text string"), scratch, key="k").first()
    fresh = out.text.split(" ; ")
    assert out.n_entities == len(names) == len(set(fresh)) and not set(fresh) & {n for _, n in names}


def test_url_verdicts(spark, scratch):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://a.example.com/de/1", None), (2, "http://b.example.net/x?ref=q", link("http://a.example.com/de/1")),
        (3, "https://www.b.example.net/x/", ""), (4, "http://c.example.org/en/1", ""), (5, "http://c.example.org/fr/1", link("http://a.example.com/de/1")),
        (6, None, None), (7, "nothing", "x"), (8, "http://d.net/y", link("http://c.example.org/es/2")), (9, "HTTP://E.Example.COM/fr/", "x"),
        (10, "http://f.net/z?to=http%3A%2F%2Fg.com%2Fde%2F", "x"), (10, "http://f.net/z?to=http%3A%2F%2Fg.com%2Fde%2F", "x"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as node", "2 as own")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in page_verdicts(frame, scratch).collect()}
    assert got[1][1:] == ("com/de/", "block") and got[4][1:] == ("example.org/en/1", "block")
    assert got[5] == ("c.example.org", "org/", "allow")
    # page 5 is an explicitly allowed alias of the blocked page, so the others stay open
    assert got[2][1:] == (None, "allow") and got[3][1:] == (None, "allow")
    assert got[6] == ("", None, "allow") and got[7] == ("", None, "allow")
    assert got[8][1:] == (None, "block") and got[10][1:] == (None, "block") and got[9][:2] == ("e.example.com", "com/fr/")
    assert page_verdicts(frame.limit(0), scratch).count() == 0


def test_relative_link_targets(spark, scratch):
    cases = [
        ("/", "de/home", True), ("", "de/home", True), ("/a", "./de/home", True), ("/a/b/c", "../../de/x?q=1", True), ("/a/b/c", "../../../de/x?q=1", True),
        ("/a/b", "../../../de/", True), ("/de", "de/", True), ("/a/", "de/home", False), ("/a", "/b/../de/x", True), ("/a", "//y.com/de/", True),
        ("/a", "https://y.com/de/", True), ("/a", "mailto:de/", False), ("/a", "#de/", False),
    ]
    forms = ('<link rel=canonical href="{}">', '<meta http-equiv=refresh content="0;url={}">')
    rows = [(100 * f + i, f"http://h{i}-{f}.com{path}", form.format(target)) for f, form in enumerate(forms) for i, (path, target, _) in enumerate(cases)]
    got = page_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch).collect()
    assert {r.page_id: r.verdict == "block" for r in got} == {100 * f + i: blocked for f in (0, 1) for i, (_, _, blocked) in enumerate(cases)}


def test_targets_by_query_base_and_ampersand(spark, scratch):
    rows = [
        (1, "http://x.net/p?id=1", '<link rel=canonical href="http://y.com/de/">'), (2, "http://x.net/p", "<meta http-equiv=refresh content='0;url=?id=1'>"),
        (3, "http://x.net/q?a=1&b=2", '<link rel=canonical href="http://y.com/de/">'), (4, "http://x.net/r", '<link rel="canonical" href="/q?a=1&amp;b=2">'),
        (5, "http://x.net/s/t", '<base href="http://y.com/de/"><link rel="canonical" href="index.html">'), (6, "http://x.net/s/u", '<link rel="canonical" href="index.html">'),
    ]
    got = page_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch)
    assert {r.page_id for r in got.collect() if r.verdict == "block"} == {1, 2, 3, 4, 5}


def test_notices(spark, docs, plain_docs):
    rows = [(1, "Relased under the MIT Licence. x"), (2, "MIT license, mit License"), (3, None), (4, "ä Licensed under CC BY-NC 4.0")]
    got = {r.doc_id: r for r in license_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit-notice" and got[1].n_base == 0 and 0.8 < got[1].score < 1 and got[1].spans[0].start == 0
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (2, 0, 2, "mit")
    assert (got[3].labels, got[3].score, got[3].first_word) == ("", 0.0, None)
    assert got[4].labels == "cc-by,cc-by-nc-4.0" and got[4].spans[0].start == 2
    assert license_notices(docs).count() == len(plain_docs)


def test_notices_on_both_sides_of_the_best_match():
    text = b"relased under the mit license; released under the mit license. releasd under the mit license"
    found = NoticeFinder({"released under the mit license": "mit-notice"}, 12).find(text, np.array([0, len(text)]))
    assert sorted(m[4] for m in found) == [0, 1, 1]


@pytest.mark.parametrize("name", sorted(n for n in entry_module.oracle_sql() if n.startswith(("op", "rule_"))))
def test_query_matches_sql(spark, name):
    with oracle("sf0.01") as connection:
        want = oracle_rows(connection, entry_module.oracle_sql()[name])
    assert spark_rows(entry_module.queries()[name](spark, SF)) == want


@needs_model
def test_pipeline_stages_keep_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert kept.join(labels.where("quality = 0"), "doc_id").count() <= 2
    assert kept.join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * labels.where("quality = 1").count()
    assert corpus_pipeline.decontamination(spark, docs, SF).columns == docs.columns
    out = entry_module.queries()["pipeline"](spark, SF)
    assert out.where("not round_trip").count() == 0 and 0 < out.count() < docs.count()
