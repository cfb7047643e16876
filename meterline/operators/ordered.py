"""Work along a total order without bringing a key's rows into one task.

A window partitioned by a run (or by nothing) puts all of that run's rows into
one task. Here rows are first cut into even chunks of the total order (key,
then order columns), so that one run spreads over as many chunks as its size
needs. Windows then work inside chunks, and what has to cross a chunk border
travels in a table of at most one row per chunk.

The chunk of a row is a function of the row: its place among bounds that come
from a hash sample of bounded size, so every evaluation cuts alike and nothing
needs writing out. Rows are shuffled once, chunk by chunk; the carry table is
made of partial sums taken before that shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.session import shuffle_width

CHUNK = "_chunk"

# Rows that the bounds are taken from, per chunk. They decide how even chunks are, not what comes out.
SAMPLE_PER_CHUNK = 20


def ordered_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None = None
) -> DataFrame:
    """Add ``_chunk``: contiguous, evenly filled slices of the order (keys, order).

    ``order`` should identify a row within its key: equal rows stay together, and
    one place held by very many rows makes the sample coarser.
    """
    count = chunks or shuffle_width(df.sparkSession)
    place = F.struct(*keys, *order)
    picked = (
        df.select(place.alias("place"))
        .orderBy(F.xxhash64("place"), "place")
        .limit(SAMPLE_PER_CHUNK * count)
        .agg(F.sort_array(F.collect_list("place")).alias("places"))
    )
    cuts = F.transform(
        F.sequence(F.lit(1), F.lit(max(count - 1, 1))),
        lambda i: F.get("places", F.floor(i * F.size("places") / F.lit(count)).cast("int")),
    )
    bounds = picked.select(cuts.alias("bounds")).scalar()
    # The number of bounds below a row, by halving.
    steps = [1 << i for i in reversed(range(max(count - 1, 1).bit_length()))]
    below = F.aggregate(
        F.array(*[F.lit(step) for step in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get("_bounds", at + step - 1) < F.col("_place"), at + step).otherwise(at),
    )
    marked = df.withColumn("_bounds", bounds).withColumn("_place", place)
    return marked.withColumn(CHUNK, below).drop("_bounds", "_place")


def placed(chunks: DataFrame) -> DataFrame:
    """Rows of one chunk together, chunks dealt evenly over tasks: the one shuffle of full rows."""
    return chunks.repartitionById(shuffle_width(chunks.sparkSession), F.col(CHUNK))


def last_known(
    chunks: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    current: bool = False,
    is_placed: bool = False,
) -> DataFrame:
    """Add the last non-null ``value`` of earlier rows of the same key.

    With ``current`` the row's own value counts too. ``is_placed`` says that rows of a
    chunk lie together already, as in a result of this function.
    """
    tail = F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    rows = chunks if is_placed else placed(chunks)
    return _carried(
        rows,
        _handed_over(chunks, keys, tail, F.last("_tail", ignorenulls=True)),
        keys,
        order,
        F.last(value, ignorenulls=True),
        F.coalesce,
        name,
        0 if current else -1,
    )


def greatest_before(
    chunks: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Add the greatest ``value`` of earlier rows of the same key."""
    handed = _handed_over(chunks, keys, F.max(value), F.max("_tail"))
    return _carried(placed(chunks), handed, keys, order, F.max(value), F.greatest, name)


def _carried(rows, handed, keys, order, running: Column, combine, name: str, end: int = -1) -> DataFrame:
    along = [F.col(column).asc_nulls_first() for column in order]
    inside = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(*along)
        .rowsBetween(Window.unboundedPreceding, end)
    )
    same_key = F.col(CHUNK) == F.col("_to_chunk")
    for key in keys:
        same_key = same_key & F.col(key).eqNullSafe(F.col(f"_to_{key}"))
    scanned = rows.withColumn("_inside", running.over(inside))
    # At most one row per chunk: only the first key of a chunk can have begun earlier.
    joined = scanned.join(F.broadcast(handed), same_key, "left")
    return joined.select(*rows.columns, combine(F.col("_inside"), F.col("_handed")).alias(name))


def _handed_over(chunks: DataFrame, keys: Sequence[str], tail: Column, across: Column) -> DataFrame:
    """Per chunk, what its first key brings along from earlier chunks."""
    tails = chunks.groupBy(*keys, CHUNK).agg(tail.alias("_tail"))
    earlier = (
        Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    handed = tails.withColumn("_handed", across.over(earlier))
    return handed.where(F.col("_handed").isNotNull()).select(
        F.col(CHUNK).alias("_to_chunk"),
        *[F.col(key).alias(f"_to_{key}") for key in keys],
        "_handed",
    )


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Add the 1-based place of every row in a total order over all rows."""
    chunks = ordered_chunks(df, [], order)
    along = [F.col(column).asc_nulls_first() for column in order]
    inside = F.row_number().over(Window.partitionBy(CHUNK).orderBy(*along))
    # One row per chunk, so the unpartitioned window and the broadcast are small.
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        chunks.groupBy(CHUNK)
        .agg(F.count("*").alias("_rows"))
        .select(CHUNK, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    ranked = placed(chunks).withColumn("_inside", inside).join(F.broadcast(starts), CHUNK)
    return ranked.select(*df.columns, (F.col("_start") + F.col("_inside")).alias(name))
