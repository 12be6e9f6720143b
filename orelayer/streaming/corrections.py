"""Change history of a stream whose rows arrive in any order: history rows are corrected when a late row changes them.

:func:`orelayer.streaming.changes.history_stream` applies rows in order of arrival. Here a key keeps its rows in list state, sorted by
event time, with what each of them counted as. A row that arrives late is put in its place, and where that changes what a row around
it counts as, the old history row is taken back (``sign`` -1) and the new one given (+1). After any order of arrival the rows that
stand are the history of the ordered run.

Without a horizon state is grouped by buckets of keys, with one entry for each key, so that a micro-batch costs one read and one write
for a key that has new rows, however many rows it keeps.

State is bounded by ``horizon``: event-time timers fold the rows that the watermark has passed into one, the state that later
rows start from. Rows that come later than the horizon are then past correction, and Spark leaves them out: land them beside the table
first (``late`` of :func:`orelayer.streaming.landing.land_arriving`). Without a horizon nothing is folded and no row is left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructField, StructType

from orelayer.functions.columns import clock, nested_columns, record_hash, stable_uuid

# Values pass through the state as JSON, with every digit of a time.
JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
FIELDS = ["at", "seq", "hash", "body", "gone"]
# Rows of a bucket that are held before they are applied.
HELD = 100_000
# Stands for no whole number: with an empty one a whole column would lose its digits on the way into a processor.
NO_NUMBER = -(1 << 63)


def operations(rows: list[tuple], base: tuple | None) -> list[tuple]:
    """What each of a key's sorted rows ``(at, seq, hash, body, gone)`` counts as, and the values it shows: ``(operation or "", body)``."""
    found = []
    known = None if base is None or base[4] else base
    for row in rows:
        if row[4]:
            found.append(("DELETE", known[3]) if known else ("", ""))
            known = None
        else:
            found.append(("INSERT" if known is None else "UPDATE" if known[2] != row[2] else "", row[3]))
            known = row
    return found


def placed(before: dict[tuple, tuple], arrived: Iterable[tuple], base: tuple | None) -> tuple[list[tuple], list[tuple]]:
    """Rows that arrived put among those ``before``, by their places: all rows with what they count as, and signed corrections."""
    merged = {at: r[:5] for at, r in before.items()}
    for row in arrived:
        merged.setdefault(row[:2], row)
    ordered = [merged[at] for at in sorted(merged)]
    counted = operations(ordered, base)
    out = []
    for row, (operation, shown) in zip(ordered, counted):
        old = before.get(row[:2])
        told = (old[5], old[6] if old[5] else "") if old else ("", "")
        if told == (operation, shown if operation else ""):
            continue
        out += [(*row[:2], op, body, sign) for (op, body), sign in ((told, -1), ((operation, shown), 1)) if op]
    return [(*row, *told) for row, told in zip(ordered, counted)], out


class Corrections(StatefulProcessor):
    """Per key its rows in order of event time, each with what it counted as when it was last looked at.

    The first row of a folded key is its base: it counts as nothing and tells the state before the others.
    """

    def __init__(self, seq: str, timed: bool):
        self.seq, self.timed = seq, timed

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", f"at bigint, seq {self.seq}, hash string, body string, gone boolean, operation string, shown string, base boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()]
        base = held[0] if held and held[0][7] else None
        before = {r[:2]: r for r in held if not r[7]}
        arrived = (row for frame in rows for row in zip(*(frame[c].tolist() for c in FIELDS)))
        ordered, out = placed(before, arrived, base)
        if self.timed:
            known = {r[0] for r in before.values()}
            for at in {r[0] for r in ordered} - known:
                self.handle.registerTimer(at // 1000 + 1)
        self._keep(base, [(*row, False) for row in ordered])
        yield from self._given(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Fold the rows the watermark has passed: only the last of them is needed, as the state before the next."""
        held = [tuple(r) for r in self.rows.get()]
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        old, left = [r for r in held if r[7] or r[0] < passed], [r for r in held if not r[7] and r[0] >= passed]
        if len(old) > 1 or old and not old[0][7]:
            self._keep((*old[-1][:7], True), left)
        yield from self._given(key, [])

    def _keep(self, base: tuple | None, rows: list[tuple]) -> None:
        self.rows.put([base, *rows] if base else rows)

    def _given(self, key, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            frame = pd.DataFrame([(*key, *r) for r in out], columns=[*[f"k{i}" for i in range(len(key))], "at", "seq", "operation_type", "body", "sign"])
            yield frame

    def close(self) -> None:
        pass


class BucketCorrections(StatefulProcessor):
    """As :class:`Corrections` without a horizon, for a bucket of keys: the rows of a key are one entry of a map."""

    def init(self, handle) -> None:
        self.rows = handle.getMapState("rows", "name string", "held binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[str, list[tuple]] = {}
        count = 0
        for frame in rows:
            for name, *row in zip(*(frame[c].tolist() for c in ["name", *FIELDS])):
                arrived.setdefault(name, []).append(tuple(row))
            count += len(frame)
            if count >= HELD:
                yield from self._applied(arrived)
                arrived, count = {}, 0
        yield from self._applied(arrived)

    def _applied(self, arrived: dict[str, list[tuple]]) -> Iterator[pd.DataFrame]:
        found = []
        for name, new in arrived.items():
            known = self.rows.getValue((name,)) if self.rows.containsKey((name,)) else None
            held = pickle.loads(known[0]) if known else []
            ordered, out = placed({r[:2]: r for r in held}, new, None)
            if len(ordered) > len(held):  # otherwise all of them arrived before
                self.rows.updateValue((name,), (pickle.dumps(ordered),))
            found += [(name, *r) for r in out]
        if found:
            yield pd.DataFrame(found, columns=["name", "at", "seq", "operation_type", "body", "sign"])

    def close(self) -> None:
        pass


def corrected_history(
    changes: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    order: Sequence[str],
    systime: str,
    *,
    deleted: Column | None = None,
    horizon: str | None = None,
    buckets: int = 4096,
) -> DataFrame:
    """History rows with ``sign``: 1 for a row that is given, -1 for one that is taken back.

    ``order`` is a time and one column, whole numbers or text, that tells the rows of a key apart: a row that arrives again
    changes nothing. Where ``deleted`` holds a row ends its key. ``horizon`` such as ``"7 days"`` is how late a row may come.
    Without it keys are dealt over ``buckets``, which may not change while the checkpoint is in use.
    """
    at, seq = order
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    kind = "string" if changes.schema[seq].dataType.simpleString() == "string" else "bigint"
    rows = changes.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        F.col(at).cast("timestamp").alias("event_time"),
        F.unix_micros(F.col(at).cast("timestamp")).alias("at"),
        F.col(seq).cast(kind).alias("seq"),
        record_hash(list(tracked), nested=[c for c in nested_columns(changes) if c in tracked]).alias("hash"),
        F.to_json(F.struct(*tracked), JSON).alias("body"),
        gone.alias("gone"),
    )
    names = [f"k{i}" for i in range(len(keys))]
    given = f"at bigint, seq {kind}, operation_type string, body string, sign int"
    if horizon:
        told = ", ".join(f"{n} {changes.schema[k].dataType.simpleString()}" for n, k in zip(names, keys))
        found = rows.withWatermark("event_time", horizon).groupBy(*names).transformWithStateInPandas(
            statefulProcessor=Corrections(kind, True),
            outputStructType=StructType.fromDDL(f"{told}, {given}"),
            outputMode="append",
            timeMode="eventTime",
        )
    else:
        numbers = ["at", "seq"] if kind == "bigint" else ["at"]
        dealt = rows.select(
            F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int").alias("bucket"),
            F.to_json(F.struct(*names), JSON).alias("name"),
            *[F.coalesce(c, F.lit(NO_NUMBER)).alias(c) if c in numbers else F.col(c) for c in FIELDS],
        )
        found = dealt.groupBy("bucket").transformWithStateInPandas(
            statefulProcessor=BucketCorrections(),
            outputStructType=StructType.fromDDL(f"name string, {given}"),
            outputMode="append",
            timeMode="none",
        )
        kinds = StructType([StructField(n, changes.schema[k].dataType) for n, k in zip(names, keys)])
        named = F.from_json("name", kinds, JSON)
        found = found.select(
            *[named[n].alias(n) for n in names], *[F.nullif(F.col(c), F.lit(NO_NUMBER)).alias(c) for c in numbers],
            *[c for c in found.columns if c != "name" and c not in numbers],
        )
    values = F.from_json("body", StructType([changes.schema[c] for c in tracked]), JSON)
    shown = found.withColumn("values", values).select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)],
        *[F.col(f"values.{c}").alias(c) for c in tracked],
        F.col("seq").alias(seq),
        F.timestamp_micros("at").cast("timestamp_ntz").alias("effective_time"),
        clock(systime).alias("systime"),
        "operation_type",
        "sign",
    )
    return shown.withColumn("history_id", stable_uuid(*keys, seq, "operation_type")).drop(seq)


def standing(corrections: DataFrame) -> DataFrame:
    """The history rows that were given and not taken back since."""
    columns = [c for c in corrections.columns if c != "sign"]
    return corrections.groupBy(*columns).agg(F.sum("sign").alias("_stands")).where("_stands > 0").drop("_stands")
