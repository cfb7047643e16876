"""The prefix tree against its SQL, and against plain loops on odd tables and many shards."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

import meterline.llm.prefix_tree as prefix_tree
from meterline.llm.queries import QUERIES
from meterline.llm.sql import ORACLE_SQL
from tests.compare import TESTDATA, oracle, oracle_rows, spark_rows

KIND = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(sequences):
    """Nodes of (conv_id, [(turn, words)]) pairs, straight from the definition."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in sequences:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key, own in members.items():
        if key:
            kids[key[:-1]] += 1
        for d in range(len(key) + 1):
            leaves[key[:d]] += not any(len(c) > len(key) and c[: len(key)] == key for c in ends)
            saved[key[:d]] += (len(own) - 1) * (key[-1][1] if key else 0)
    return sorted(
        (min(own), len(key), min(members[key[:-1]]) if key else -1, len(own), kids[key], leaves[key], saved[key],
         hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest())
        for key, own in members.items()
    )


def nodes(df):
    return sorted(tuple(-1 if row[c] is None else row[c] for c in COLUMNS) for row in df.select(*COLUMNS).collect())


def turns_of(spark, sequences):
    rows = [(c, [(i, hashlib.md5(str(t).encode()).digest(), t[1]) for i, t in enumerate(turns)]) for c, turns in sequences]
    return spark.createDataFrame(rows, "conv_id long, turns array<struct<turn: long, id: binary, words: int>>")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    with oracle(sf) as connection:
        names, want = oracle_rows(connection, ORACLE_SQL["op11_prefix_tree"])
    assert (names, want) == spark_rows(QUERIES["op11_prefix_tree"](spark, f"{TESTDATA}/{sf}"))


@pytest.mark.parametrize("columns", [64, 2])
def test_common_openings_over_many_shards(spark, scratch, monkeypatch, columns):
    """Copies, one hot conversation, nested ones and a long one; shards end inside all of them."""
    monkeypatch.setattr(prefix_tree, "COLUMNS", columns)
    draw = random.Random(3)
    word = lambda: (draw.randrange(3), draw.randrange(4))
    many = [(i, [word() for _ in range(draw.randrange(6))]) for i in range(150)]
    many += [(200 + i, [(1, 1), (0, 2), (2, 3)]) for i in range(80)]
    many += [(400 + i, [(1, 1)] * i) for i in range(40)] + [(500, []), (501, []), (-7, [(9, 5)] * 200), (-8, [(9, 5)] * 170)]
    monkeypatch.setattr(prefix_tree, "SHARD_TURNS", 40)
    assert nodes(prefix_tree.prefix_tree(turns_of(spark, many), scratch)) == plain(many)


def test_small_tables(spark, scratch):
    for rows in ([], [(5, [])], [(5, []), (4, [])], [(5, [(1, 0)])], [(5, [(1, 2)]), (5, [(1, 2)])]):
        assert nodes(prefix_tree.prefix_tree(turns_of(spark, rows), scratch)) == plain(rows)


def test_openings_and_odd_rows(spark, scratch):
    """Null turns, roles, texts and ids; repeated rows; a very long text; more columns."""
    rows = [(None, 1, "user", "lost")] + [(0, i, "user", f"base {i}") for i in range(2)]
    rows += [(c, t, r, x) for c in (1, 2, 3, 5, 7, 25, 45, -5) for t, r, x in ((3, "a", "z"), (None, None, None), (3, "a", "z"), (2, "b", "w " * 50000), (1, "c", " \t\n"))]
    frame = spark.createDataFrame(rows, KIND).selectExpr("*", "'x' as id", "1 as words", "2 as key", "3 as turns", "'s' as side")
    own = defaultdict(list)
    for c, t, r, x in rows:
        name = hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest()
        own[c].append(((t is not None, t or 0, name), (name, len((x or "").split()))))
    own.pop(None)
    ordered = {c: [turn for _, turn in sorted(turns)] for c, turns in own.items()}
    built = []
    for c, turns in ordered.items():
        h = crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built.append((c, ordered.get(base, [])[:h] + turns[h:]))
    got = prefix_tree.prefix_tree(prefix_tree.with_openings(prefix_tree.turn_lists(frame)), scratch)
    assert nodes(got) == plain(built)
