"""Work on keyed, ordered rows when one key may hold a large part of the table.

A window over a key puts all of its rows into one task. The helpers here cut the rows of busy keys into
pieces along the order column and carry the state that enters each piece separately, so that the result is
the same and no task gets more than a small share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelayer.session import written

# A key is busy when it has more rows than FLOOR and more than one SHARE-th of all rows. So there are
# never more than SHARE busy keys, whatever the size of the table, and a frame of them can be broadcast.
FLOOR = 1_000_000
SHARE = 100_000
# Pieces are of equal length in time, not in rows; cutting finer leaves room for bursts.
SPARE = 8
# A dimension counted to have no more rows than this is broadcast.
SMALL = 500_000


def busy_keys(
    df: DataFrame, keys: Sequence[str], order: str | None = None, *, floor: int = FLOOR, share: int = SHARE
) -> DataFrame:
    """Busy keys with the number of pieces to cut each into; at most ``share`` rows.

    Columns are ``_busy_<key>`` and ``_pieces``, and with ``order`` also ``_from`` and ``_width``, the start
    and length of a piece. Counts are combined before the shuffle, so a busy key costs one row per task.
    """
    spans = [F.min(order).alias("_from"), F.max(order).alias("_to")] if order else []
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *spans)
    limit = F.greatest(F.lit(floor), F.ceil(counts.agg(F.sum("_n")).scalar() / F.lit(share)))
    busy = counts.where(F.col("_n") > limit).withColumn("_pieces", F.ceil(F.col("_n") / limit) * F.lit(SPARE))
    columns = [F.col(k).alias(f"_busy_{k}") for k in keys] + [F.col("_pieces")]
    if order:
        span = F.timestamp_diff("MICROSECOND", F.col("_from"), F.col("_to")) + F.lit(1)
        columns += [F.col("_from"), F.ceil(span / F.col("_pieces")).alias("_width")]
    return busy.select(*columns)


def known_busy_keys(df: DataFrame, keys: Sequence[str], order: str, **cut: int) -> DataFrame | bool:
    """Count the keys now: False if none is busy, else the busy ones, kept as a small written table.

    One pass over the key and order columns. Passed on as ``busy``, it spares every operator on the same
    keys its own pass, and in the common case of no busy key leaves plain windows.
    """
    busy = busy_keys(df, keys, order, **cut)
    return False if busy.isEmpty() else written(busy, "busy-keys")


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order.

    Spark keeps one row per key in every task before it shuffles (a window group limit), so a busy key
    sends one row per task, not all of its rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def nearest_state(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    state: Column,
    into: str,
    *,
    after: bool = False,
    own: bool = False,
    busy: DataFrame | bool | None = None,
    floor: int = FLOOR,
    share: int = SHARE,
) -> DataFrame:
    """Add ``into``: the nearest non-null ``state`` before each row of the same key (or after it).

    ``order`` names the columns that order the rows of a key, a timestamp first. ``own`` lets a row see its
    own state. ``busy`` takes the result of :func:`known_busy_keys` or :func:`busy_keys` for the same keys and
    any order column, or False where no key can be busy: it only decides where rows are cut, never what
    comes out. Without it busy keys are found as part of the plan.
    """
    sorting = [F.col(c).desc() if after else F.col(c).asc() for c in order]
    if busy is False:
        seen = Window.partitionBy(*keys).orderBy(*sorting).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        return df.withColumn(into, F.last(state, ignorenulls=True).over(seen))
    if busy is None:
        busy = busy_keys(df, keys, order[0], floor=floor, share=share)
    same_key = [F.col(k).eqNullSafe(F.col(f"_busy_{k}")) for k in keys]
    # busy has at most `share` rows by construction, hence the hint.
    rows = df.join(F.broadcast(busy), same_key, "left").withColumns(
        {"_state": state, "_piece": _piece(order[0]), "_own": F.lit(1)}
    )
    kept = [*df.columns, "_state", "_piece", "_own"]

    at = F.struct(*[F.col(c) for c in order])
    known = F.col("_state").isNotNull()
    pick = F.min_by if after else F.max_by
    edges = (
        rows.where(F.col("_width").isNotNull())
        .groupBy(*keys, "_piece")
        .agg(pick(F.col("_state"), F.when(known, at)).alias("_edge"))
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy(F.col("_piece").desc() if after else F.col("_piece").asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    entering = (
        edges.withColumn("_state", F.last("_edge", ignorenulls=True).over(before))
        .where(F.col("_state").isNotNull())
        .select(*keys, "_piece", "_state", F.lit(0).alias("_own"))
    )

    inside = (
        Window.partitionBy(*keys, "_piece")
        .orderBy("_own", *sorting)
        .rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    )
    return (
        rows.select(*kept)
        .unionByName(entering, allowMissingColumns=True)
        .withColumn(into, F.last("_state", ignorenulls=True).over(inside))
        .where("_own = 1")
        .drop("_state", "_piece", "_own")
    )


def _piece(order: str) -> Column:
    """Which piece a row falls into, never decreasing along ``order`` (a null there sorts first).

    Rows outside the span of the busy key join the outermost pieces; other keys have one piece.
    """
    offset = F.timestamp_diff("MICROSECOND", F.col("_from"), F.col(order))
    piece = F.least(F.greatest(F.floor(offset / F.col("_width")), F.lit(-1)), F.col("_pieces"))
    return F.when(F.col("_width").isNotNull(), piece).otherwise(F.lit(0))


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    dim_rows: int | None = None,
    how: str = "left",
) -> DataFrame:
    """Join of facts to one dimension row each, by the counted size of the dimension.

    A small dimension is broadcast and a large one joined by :func:`salted_lookup`, which reads the facts'
    keys once more, so let ``facts`` be a stored table then. Without a count Catalyst chooses.
    """
    if dim_rows is None:
        return facts.join(dim, list(on), how)
    if dim_rows <= SMALL:
        return facts.join(F.broadcast(dim), list(on), how)
    return salted_lookup(facts, dim, on, salt_by, how)


def salted_lookup(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "left",
    *,
    floor: int = FLOOR,
    share: int = SHARE,
) -> DataFrame:
    """Join facts to one dimension row each when the dimension is too large to broadcast.

    Facts of a busy key are spread over pieces by a hash of ``salt_by`` (columns that tell the facts apart,
    such as their id) and its dimension row is repeated once per piece. Adaptive execution splits skewed
    joins by itself where both sides come straight from a shuffle; use this where one does not, such as a
    dimension joined with its own aggregates.
    """
    busy = F.broadcast(busy_keys(facts, on, floor=floor, share=share))

    def marked(df: DataFrame) -> DataFrame:
        same_key = [F.col(k).eqNullSafe(F.col(f"_busy_{k}")) for k in on]
        return df.join(busy, same_key, "left").withColumn("_pieces", F.coalesce("_pieces", F.lit(1)))

    left = (
        marked(facts)
        .withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.col("_pieces")))
        .select(*facts.columns, "_salt")
    )
    right = (
        marked(dim)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_pieces") - 1)))
        .select(*dim.columns, "_salt")
    )
    return left.join(right, [*on, "_salt"], how).drop("_salt")
