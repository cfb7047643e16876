"""Connected components by contraction, and bucket stars, on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.scratch import Scratch
from meterline.session import shuffle_width


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Label every node of ``edges`` (a, b) with the least node it is connected to.

    Each round every node points to the node of least random rank in its
    neighbourhood, and edges are redrawn between the targets. Whole stars vanish in
    one round and paths shrink by a constant factor, so rounds grow with the
    logarithm of the longest path. Minima are combined before each shuffle and
    joins are splittable, so a hub with most of the edges is no hot task.

    Self loops make single nodes; edges with a null end are ignored. Returns
    (node, component), one row per node.
    """
    kind = edges.schema["a"].dataType
    edges = edges.select(F.col("a").cast(kind), F.col("b").cast(kind)).where("a is not null and b is not null")
    labels, given = None, True
    turn = 0
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        both = both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("rank"), F.col(c).alias("id"))
        target = F.least(F.min(rank("other")), F.min(rank("node")))
        step = scratch.table(both.groupBy("node").agg(target.alias("t")).select("node", F.col("t.id").alias("to")))
        if labels is None:
            labels = step.withColumnRenamed("to", "root")
        else:
            moved = step.select(F.col("node").alias("root"), "to")
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        before, labels = labels, scratch.table(labels)
        turn += 1
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        spent, edges = edges, scratch.table(
            edges.join(left, "a").join(right, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        scratch.drop(step, before, None if given else spent)
        given = False
        if edges.isEmpty():
            break
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    out = scratch.table(labels.join(least, "root").select("node", "component"))
    scratch.drop(labels, edges)
    return out


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels of ``components`` after further ``links`` (a, b), worked out between components only."""
    name = labels.select(F.col("node").alias("a"), F.col("component").alias("x"))
    other = labels.select(F.col("node").alias("b"), F.col("component").alias("y"))
    edges = links.join(name, "a", "left").join(other, "b", "left")
    edges = edges.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).distinct()
    further = components(edges, scratch)
    lower = further.select(F.col("node").alias("component"), F.col("component").alias("lower"))
    moved = labels.join(lower, "component", "left").select("node", F.coalesce("lower", "component").alias("component"))
    # A component's least node bears its name, so nodes not labelled yet are those of no component.
    return scratch.table(moved.unionByName(further.join(labels, "node", "left_anti")))


def shared(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Of (key, id, ...) rows those whose key has several ids; one wide shuffle.

    Rows are dealt by ranges of (key, id), so a key with a third of all rows is cut
    over many tasks. Inside a task equal rows and equal keys are neighbours; what tasks
    saw several times, such as a common line, goes there. The first and last key
    of a task may go on in the next one, so their rows are kept as they are; singles
    among them go in the small count that follows.
    """
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), "key", "id").sortWithinPartitions("key", "id")
    near = scratch.table(dealt.mapInArrow(_neighbours, rows.schema))
    many = near.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    out = scratch.table(near.join(many.select("key"), "key", "left_semi"))
    scratch.drop(near)
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = before = first = None  # the last row waits until its successor is known
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        key = table.column("key").to_numpy()
        columns = [column.to_numpy() for column in table.columns]
        alike = np.logical_and.reduce([column[1:] == column[:-1] for column in columns])
        if alike.any():
            once = np.r_[True, ~alike]
            table, key = table.filter(pa.array(once)).combine_chunks(), key[once]
        first = key[0] if first is None else first
        same = np.r_[before is not None and before == key[0], key[1:] == key[:-1]]
        keep = same[:-1] | same[1:] | (key[:-1] == first)
        if keep.any():
            yield from table.slice(0, len(key) - 1).filter(pa.array(keep)).to_batches()
        held = table.slice(len(key) - 1, 1).to_batches()[0]
        before = key[-2] if len(key) > 1 else before
    if held is not None:
        yield held
