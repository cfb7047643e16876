"""The prefix tree of conversations: padded turn-id matrices, sorted and reduced depth by depth.

Conversations are sequences of turns. Every distinct sequence of the first d turns of
some conversation is a node of depth d, from the root (d = 0); its members are the
conversations that start with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.llm.scratch import Scratch
from meterline.operators.ordered import CHUNK, ordered_chunks
from meterline.session import shuffle_width

#: Columns of a padded matrix: longer conversations are taken this many turns at a time.
COLUMNS = 64
#: Turns of a shard, about: what one task holds at a time.
SHARD_TURNS = 1 << 20

ROWS = "conv_id long, ids array<binary>, words array<int>"
FOUND = (
    "shard int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, ends string, key binary, parent_key binary"
)


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (turn, id, words).

    Turns are ordered by ``turn``, null first; those of equal ``turn`` by id. ``id`` is
    a 128-bit digest of role and text, and ``words`` counts runs of characters other
    than ASCII white space. Null roles and texts are empty. Rows of a null conv_id are
    of no conversation and left out. Further columns are ignored.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    # The length of the role keeps (role, text) apart from other cuts of the same characters.
    name = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", name.alias("id"), words.alias("words")).alias("t")
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_openings(lists: DataFrame, family: int = 20, most: int = 3) -> DataFrame:
    """Conversations that open as the first of their family does.

    Conversation c takes its first h turns from conversation c - c % ``family`` (all it
    has, if fewer; none, if it does not exist), and its own turns after the first h;
    h is the unsigned crc32 of c in decimal, modulo ``most`` + 1.
    """
    openings = lists.where(F.col("conv_id") % family == 0)
    openings = openings.select(F.col("conv_id").alias("opens"), F.slice("turns", 1, most).alias("opening"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    own = lists.withColumn("opens", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", taken)
    joined = own.join(openings, "opens", "left").withColumn("opening", F.expr("coalesce(opening, slice(turns, 1, 0))"))
    return joined.select("conv_id", F.expr("concat(slice(opening, 1, h), slice(turns, h + 1, greatest(size(turns) - h, 0)))").alias("turns"))


class Shard(NamedTuple):
    """Sorted rows: real ones, and neighbours of the first and last that guard the ends."""

    real: np.ndarray
    conv: np.ndarray
    first: np.ndarray  # where the row's turns start in the flat arrays
    size: np.ndarray
    alike: np.ndarray  # turns in common with the row before; -1 for the first row
    words: np.ndarray  # sums of words before each flat turn
    digests: bytes


def _padded(ids: np.ndarray, first: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
    """The turn ids from ``depth`` on, one row each, 0 behind the last."""
    left = size - depth
    place = np.arange(min(COLUMNS, int(left.max())))
    there = place < left[:, None]
    at = np.where(there, first[:, None] + depth + place, 0)
    return np.where(there, ids[at], 0)


def _dense(digests: bytes) -> np.ndarray:
    """The digests' ranks from 1 on."""
    halves = np.frombuffer(digests, ">u8").reshape(-1, 2)
    high, low = halves[:, 0].astype(np.uint64), halves[:, 1].astype(np.uint64)
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    ranks = np.empty(len(order), np.int32)
    ranks[order] = np.cumsum(new)
    return ranks


def _in_order(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each row the place of its first equal in the order of turn-id sequences.

    Rows that still have equals are told apart by the next columns: a lexsort within
    their group. Rows that end there come before those that go on.
    """
    place = np.zeros(len(size), np.int64)
    many = np.full(len(size), len(size))
    rows, depth = np.arange(len(size)), 0
    while len(rows := rows[(size[rows] > depth) & (many[rows] > 1)]):
        block = _padded(ids, first[rows], size[rows], depth)
        order = np.lexsort((*block.T[::-1], place[rows]))
        rows, block = rows[order], block[order]
        group = np.r_[True, place[rows][1:] != place[rows][:-1]]
        part = group.copy()
        part[1:] |= (block[1:] != block[:-1]).any(axis=1)
        at = np.arange(len(rows))
        group_at, part_at = at[group], at[part]
        going_on = np.diff(np.r_[group_at, len(rows)])
        in_group, in_part = np.cumsum(group) - 1, np.cumsum(part) - 1
        ended = many[rows] - going_on[in_group]
        place[rows] += ended + part_at[in_part] - group_at[in_group]
        many[rows] = np.diff(np.r_[part_at, len(rows)])[in_part]
        depth += COLUMNS
    return place


def _alike(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Turns in common with the row before, read off column masks accumulated by OR."""
    common = np.zeros(len(size), np.int64)
    common[:1] = -1
    rows, depth = np.arange(1, len(size)), 0
    while len(rows := rows[np.minimum(size[rows], size[rows - 1]) > depth]):
        ours = _padded(ids, first[rows], size[rows], depth)
        theirs = _padded(ids, first[rows - 1], size[rows - 1], depth)
        width = min(ours.shape[1], theirs.shape[1])
        changed = (ours[:, :width] != theirs[:, :width]) | (ours[:, :width] == 0)
        changed = np.logical_or.accumulate(changed, axis=1)
        common[rows] += (~changed).sum(axis=1)
        rows = rows[~changed[:, -1]]
        depth += COLUMNS
    return common


def _shard(table: pa.Table) -> Shard:
    table = table.combine_chunks()
    side, conv = table.column("side").to_numpy(), table.column("conv_id").to_numpy()
    lists = [table.column(name).combine_chunks() for name in ("ids", "words")]
    lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
    bounds = lists[0].offsets.to_numpy().astype(np.int64)
    digests = b"".join(lists[0].flatten().to_pylist())
    words = np.r_[0, np.cumsum(lists[1].flatten().to_numpy().astype(np.int64))]
    ids = _dense(digests)
    first, size = bounds[:-1] - bounds[0], np.diff(bounds)
    order = np.lexsort((conv, side, _in_order(ids, first, size)))
    first, size = first[order], size[order]
    return Shard(side[order] == 0, conv[order], first, size, _alike(ids, first, size), words, digests)


def _nodes(shard: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Nodes of a shard's rows; those that other shards share, told by a key, as parts."""
    s = _shard(table)
    n = len(s.size)
    ids = np.where(s.real, s.conv, np.iinfo(np.int64).max)
    # A row ends a leaf where the next row does not start with it.
    leaf = s.real & (np.r_[s.alike[1:], -1] < s.size)
    own = np.cumsum(s.real)
    fresh_run = ~((s.alike == s.size) & np.r_[False, s.size[:-1] == s.size[1:]])
    run_end = np.r_[np.flatnonzero(fresh_run)[1:], n]
    run_end = run_end[np.cumsum(fresh_run) - 1]
    guards = np.flatnonzero(~s.real)
    paths = [hashlib.blake2b(digest_size=16) for _ in guards]
    nothing = hashlib.sha256(b"").hexdigest()

    node_of = np.full(n, -1)  # the row's node one level up
    up_open: list[bytes | None] = []
    up_conv = np.empty(0, np.int64)
    for depth in range(int(s.size.max()) + 1):
        rows = np.flatnonzero(s.size >= depth)
        starts = np.flatnonzero(s.alike[rows] < depth)
        of = lambda values: np.add.reduceat(values.astype(np.int64), starts)
        real = s.real[rows]
        members = of(real)
        conv = np.minimum.reduceat(ids[rows], starts)
        children = of(real & (s.size[rows] > depth) & (s.alike[rows] <= depth))
        till = np.maximum(s.alike[rows], max(depth - 1, 0))
        saved = of(np.where(real, s.words[s.first[rows] + till] - s.words[s.first[rows] + max(depth - 1, 0)], 0))
        leaves = of(leaf[rows])

        node = np.empty(n, np.int64)
        node[rows] = np.cumsum(s.alike[rows] < depth) - 1
        keys: list[bytes | None] = [None] * len(starts)
        for path, guard in zip(paths, guards, strict=True):
            if s.size[guard] >= depth:
                if depth:
                    at = 16 * (s.first[guard] + depth - 1)
                    path.update(s.digests[at : at + 16])
                keys[node[guard]] = path.digest()
        head = rows[starts]
        hashes, ends = [nothing] * len(starts), [None] * len(starts)
        for i in np.flatnonzero(s.size[head] == depth):
            run = slice(head[i], run_end[head[i]])
            names = ",".join(map(str, s.conv[run][s.real[run]].tolist()))
            if keys[i] is None:
                hashes[i] = hashlib.sha256(names.encode()).hexdigest()
            elif names:
                ends[i] = names
        parent = node_of[head] if depth else np.full(len(starts), -1)
        parent_keys = [up_open[p] if p >= 0 else None for p in parent]
        known = [None if p < 0 or k is not None else int(up_conv[p]) for p, k in zip(parent, parent_keys, strict=True)]
        keep = np.flatnonzero(members > 0)
        if len(keep):
            columns = [
                pa.array(np.full(len(starts), shard, np.int32)), pa.array(np.full(len(starts), depth)), pa.array(conv),
                pa.array(known, pa.int64()), pa.array(members), pa.array(children), pa.array(leaves), pa.array(saved),
                pa.array(hashes, pa.string()), pa.array(ends, pa.string()), pa.array(keys, pa.binary()), pa.array(parent_keys, pa.binary()),
            ]
            names = [column.split()[0] for column in FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([column.take(pa.array(keep)) for column in columns], names)
        node_of, up_open, up_conv = node, keys, conv


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shards = batch.column(0).to_numpy()
        cuts = np.r_[0, np.flatnonzero(shards[1:] != shards[:-1]) + 1, len(shards)]
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if high == low:
                continue
            part = batch.slice(low, high - low)
            if held and held[0].column(0)[0] != part.column(0)[0]:
                yield from _nodes(held[0].column(0)[0].as_py(), pa.Table.from_batches(held))
                held = []
            held.append(part)
    if held:
        yield from _nodes(held[0].column(0)[0].as_py(), pa.Table.from_batches(held))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each key's texts, comma-joined in the order they come; one text is held at a time."""
    key, state = None, None
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if name != key:
                if key is not None:
                    yield _hash_row(key, state)
                key, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.as_buffer())
    if key is not None:
        yield _hash_row(key, state)


def _hash_row(key: bytes, state) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "whole"])


def prefix_tree(lists: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per node of the prefix tree of conversations (conv_id, turns).

    ``turns`` holds (turn, id, words) in order, see ``turn_lists``; a conversation may
    have none and is then a member of the root alone. Returns conv_id (the smallest
    member), depth, parent_conv_id (the parent's conv_id, null for the root), n_convs
    (members), n_children, n_leaves (childless nodes of the subtree), saved_tokens
    (over the subtree, words of a node's last turn times its members but one) and
    ends_sha256 (of the conv_ids, ascending and comma-joined, that end here). An empty
    table has no node. Repeated rows of a conv_id are conversations of their own.

    The order of turn-id sequences is cut into even shards, so a common opening spreads
    over as many as it needs. Each shard is sorted as a padded matrix with its two
    neighbours in that order, which tells what is counted elsewhere; figures of nodes
    that shards share are sums of the shards' parts. Nothing but a conversation itself
    is held whole, and the ids that end in one node are hashed as they stream by.
    """
    rows = scratch.table(
        lists.select(
            "conv_id", F.transform("turns", lambda t: t["id"]).alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words")
        )
    )
    turns = rows.agg(F.sum(F.size("ids").cast("long"))).first()[0] or 0
    width = shuffle_width(rows.sparkSession)
    shards = ordered_chunks(rows, [], ["ids", "conv_id"], chunks=max(width, -(-turns // SHARD_TURNS)))
    row = F.struct("ids", "conv_id", "words")
    ends = shards.groupBy(CHUNK).agg(F.min(row).alias("low"), F.max(row).alias("high"))
    along = Window.orderBy(CHUNK)  # one row per shard
    near = ends.select(CHUNK, F.lag("high").over(along).alias("before"), F.lead("low").over(along).alias("after"))
    guards = near.select(CHUNK, F.explode(F.array(F.struct(F.lit(-1).alias("side"), F.col("before").alias("r")), F.struct(F.lit(1).alias("side"), F.col("after").alias("r")))).alias("g"))
    guards = guards.where("g.r is not null").select(CHUNK, "g.side", "g.r.conv_id", "g.r.ids", "g.r.words")
    guarded = shards.select(CHUNK, F.lit(0).alias("side"), "conv_id", "ids", "words").unionByName(guards)
    dealt = guarded.repartitionById(width, F.col(CHUNK) % width).sortWithinPartitions(CHUNK)
    found = scratch.table(dealt.mapInArrow(_by_shard, FOUND))

    figures = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    opened = scratch.table(
        found.where("key is not null").groupBy("key", "depth", "parent_key")
        .agg(F.min("conv_id").alias("conv_id"), *[F.sum(name).alias(name) for name in figures])
    )
    texts = found.where("ends is not null").select("key", "ends", "shard")
    texts = texts.repartition(width, "key").sortWithinPartitions("key", "shard").select("key", "ends")
    hashed = texts.mapInArrow(_hashed, "key binary, whole string")
    shared = opened.join(hashed, "key", "left").withColumn("ends_sha256", F.coalesce("whole", F.sha2(F.lit("").cast("binary"), 256)))
    names = ("depth", "conv_id", "parent_conv_id", *figures, "ends_sha256", "parent_key")
    both = found.where("key is null").select(*names).unionByName(shared.select(*[n for n in names if n != "parent_conv_id"]), allowMissingColumns=True)
    parents = opened.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    return both.join(parents, "parent_key", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "up").alias("parent_conv_id"), *figures, "ends_sha256"
    )
