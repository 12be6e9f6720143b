"""Change history of tracked columns: snapshot diffs, change feeds, versions, as-of reads, rebuilds."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType, TimestampNTZType

from orelayer.functions.columns import HISTORY_COLUMNS, clock, stable_uuid, tracked_columns
from orelayer.functions.skew import latest_per_key, nearest_state
from orelayer.operators.frames import changed

VERSION_ORDER = ["effective_time", "systime", "history_id"]


def history_schema(primary: StructType, exclude: Sequence[str] = ()) -> StructType:
    """The tracked columns of a table with their types, then the four history columns."""
    tracked = set(tracked_columns(primary.names, exclude))
    fields = [StructField(f.name, f.dataType, True) for f in primary if f.name in tracked]
    times: dict[str, DataType] = {"effective_time": TimestampNTZType(), "systime": TimestampNTZType()}
    return StructType(fields + [StructField(c, times.get(c, StringType()), False) for c in HISTORY_COLUMNS])


def snapshot_diff(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    batch_id: str,
    batch_ts: datetime | str,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """History rows that lead from one snapshot of a table to the next.

    A key only in ``new`` is an INSERT and one in both an UPDATE if a tracked column differs, both with the
    new values; a key only in ``old`` is a DELETE with the old values. Several changes between the
    snapshots count as one. ``history_id`` depends on key, batch and operation only, so that a batch that
    runs again gives the same rows. Keys are primary keys: unique and not null in each snapshot. Snapshots
    stored bucketed by key are compared without a shuffle.
    """
    tracked = tracked_columns(new.columns, exclude)
    timed = "effective_time" in new.columns
    columns = [*tracked, "effective_time"] if timed else tracked
    left = old.select(*columns).withColumn("_here", F.lit(True)).alias("old")
    right = new.select(*columns).withColumn("_here", F.lit(True)).alias("new")
    both = left.join(right, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "full_outer")

    values = [c for c in tracked if c not in keys]
    operation = (
        F.when(F.col("old._here").isNull(), "INSERT")
        .when(F.col("new._here").isNull(), "DELETE")
        .when(changed(values, "old", "new"), "UPDATE")
    )

    def kept(name: str) -> Column:
        return F.when(F.col("new._here").isNull(), F.col(f"old.{name}")).otherwise(F.col(f"new.{name}"))

    effective = F.coalesce(kept("effective_time"), clock(batch_ts)) if timed else clock(batch_ts)
    return (
        both.select(
            *[kept(c).alias(c) for c in tracked],
            effective.alias("effective_time"),
            clock(batch_ts).alias("systime"),
            operation.alias("operation_type"),
        )
        .where(F.col("operation_type").isNotNull())
        .withColumn("history_id", stable_uuid(*keys, F.lit(batch_id), "operation_type"))
        .select(*tracked, *HISTORY_COLUMNS)
    )


def history_from_changes(
    changes: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    order: Sequence[str],
    systime: datetime | str,
    *,
    deleted: Column | None = None,
    carried: Column | None = None,
    busy: DataFrame | bool | None = None,
    **cut: int,
) -> DataFrame:
    """History rows from a feed of row states, ordered within a key by ``order`` (a timestamp first).

    The first state of a key is an INSERT and later ones an UPDATE only where a tracked column differs from
    the state before. Rows where ``deleted`` holds end the entity: a DELETE with the last values, after
    which the next state is an INSERT again. The last column of ``order`` tells the rows of a key apart.
    Rows where ``carried`` holds are the state that others start from and give no history themselves.
    """
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    known = F.lit(False) if carried is None else F.coalesce(carried, F.lit(False))
    rows = changes.select(*dict.fromkeys([*keys, *tracked, *order]), gone.alias("_gone"), known.alias("_carried"))
    now = F.struct("_gone", *tracked)
    rows = nearest_state(rows, keys, order, now, "_before", busy=busy, **cut)

    absent = F.col("_before").isNull() | F.col("_before._gone")
    differs = F.lit(False)
    for name in tracked:
        differs = differs | ~F.col(name).eqNullSafe(F.col(f"_before.{name}"))
    operation = (
        F.when(F.col("_gone"), F.when(~absent, "DELETE"))
        .when(absent, "INSERT")
        .when(differs, "UPDATE")
    )
    return (
        rows.withColumn("operation_type", operation)
        .where(F.col("operation_type").isNotNull() & ~F.col("_carried"))
        .select(
            *keys,
            *[F.when(F.col("_gone"), F.col(f"_before.{c}")).otherwise(F.col(c)).alias(c) for c in tracked],
            stable_uuid(*keys, order[-1], "operation_type").alias("history_id"),
            F.col(order[0]).alias("effective_time"),
            clock(systime).alias("systime"),
            "operation_type",
        )
    )


def versions(history: DataFrame, keys: Sequence[str], *, busy: DataFrame | bool | None = None, **cut: int) -> DataFrame:
    """Each state of a key with the span it held: ``valid_from`` to ``valid_to``, which is open now.

    A DELETE ends the version before it and is none itself. Versions of no length, where two changes took
    effect at the same moment, are left out.
    """
    followed = nearest_state(
        history, keys, VERSION_ORDER, F.col("effective_time"), "valid_to", after=True, busy=busy, **cut
    )
    state = [c for c in history.columns if c not in HISTORY_COLUMNS]
    return (
        followed.where(F.col("operation_type") != "DELETE")
        .where(F.col("valid_to").isNull() | (F.col("effective_time") < F.col("valid_to")))
        .select(
            *state,
            F.col("effective_time").alias("valid_from"),
            "valid_to",
            F.col("valid_to").isNull().alias("is_current"),
        )
    )


def as_of(version_rows: DataFrame, moment: datetime | str) -> DataFrame:
    """The version of each key that held at one moment."""
    at = clock(moment)
    return version_rows.where(
        (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    )


def as_of_lookup(
    probes: DataFrame,
    at: str,
    history: DataFrame,
    keys: Sequence[str],
    *,
    busy: DataFrame | bool | None = None,
    **cut: int,
) -> DataFrame:
    """For each probe, the state its key had at the probe's own time; nulls where it had none.

    Probes and history are sorted together once. A range join would pair every probe of a key with every
    version of it first.
    """
    state = [c for c in history.columns if c not in HISTORY_COLUMNS and c not in keys]
    empty = F.lit(None)
    known = history.select(
        *keys,
        F.col("effective_time").alias("_at"),
        F.lit(0).alias("_kind"),
        F.col("systime").alias("_systime"),
        F.col("history_id").alias("_id"),
        F.struct("operation_type", F.col("effective_time").alias("valid_from"), *state).alias("_known"),
    )
    asked = probes.select(
        *keys,
        F.col(at).alias("_at"),
        F.lit(1).alias("_kind"),
        empty.cast("timestamp_ntz").alias("_systime"),
        empty.cast("string").alias("_id"),
        F.struct(*probes.columns).alias("_probe"),
    )
    merged = known.unionByName(asked, allowMissingColumns=True)
    found = nearest_state(
        merged, keys, ["_at", "_kind", "_systime", "_id"], F.col("_known"), "_held", busy=busy, **cut
    ).where("_kind = 1")
    alive = F.col("_held.operation_type") != "DELETE"
    taken = [F.when(alive, F.col(f"_held.{c}")).alias(f"as_of_{c}") for c in [*state, "valid_from"]]
    return found.select("_probe.*", *taken)


def rebuild_current(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table its history describes: the last state of each key that was not deleted."""
    last = latest_per_key(history, keys, *[F.desc(c) for c in VERSION_ORDER])
    return last.where(F.col("operation_type") != "DELETE").drop(*HISTORY_COLUMNS)


def apply_history(current: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A snapshot moved on by one batch of history rows."""
    columns = [c for c in batch.columns if c not in HISTORY_COLUMNS]
    last = latest_per_key(batch, keys, *[F.desc(c) for c in VERSION_ORDER])
    untouched = current.join(last.select(*keys), list(keys), "left_anti").select(*columns)
    return untouched.unionByName(last.where(F.col("operation_type") != "DELETE").select(*columns))


def reconcile(history: DataFrame, primary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where the rebuilt table and the real one differ; no rows means the history is complete."""
    rebuilt = rebuild_current(history, keys)
    difference = snapshot_diff(rebuilt, primary.select(*rebuilt.columns), keys, "reconcile", "1970-01-01 00:00:00")
    return difference.select(*keys, "operation_type")
