"""Versions of keyed states, kept up to date batch by batch.

:func:`orelayer.operators.history.versions` computes every interval anew from the whole history. A :class:`VersionStore` keeps
them in keyed tables and lets a batch close, open and split only intervals of its own keys: a key whose rows all come after what is
known goes on from its last state; a key with late rows is worked out again from the version that its earliest late row falls
into. Any split of a feed into batches, in any order, ends in the versions of the whole feed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelayer.functions.columns import clock
from orelayer.functions.skew import known_busy_keys, latest_per_key
from orelayer.operators.history import history_from_changes, versions
from orelayer.operators.keyed import KeyedTable
from orelayer.session import written


class VersionStore:
    """Versions of the ``tracked`` columns per ``keys``, from rows ordered by ``order``: a time, then what tells rows of one time apart.

    Under ``root`` are three keyed tables: ``log``, every row taken; ``versions``; and ``last``, per key its last row and its open version.
    A batch that was cut short can be applied again: rows already in the log are recognised by their key and order.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], tracked: Sequence[str], order: Sequence[str], systime: str, **layout: int):
        self.spark, self.keys, self.tracked, self.order, self.systime = spark, list(keys), list(tracked), list(order), systime
        self.at = self.order[0]
        self.log = KeyedTable(spark, f"{root}/log", [*keys, *order], indexed=keys, **layout)
        self.versions = KeyedTable(spark, f"{root}/versions", [*keys, "valid_from"], indexed=keys, **layout)
        self.last = KeyedTable(spark, f"{root}/last", keys, **layout)

    def read(self) -> DataFrame:
        """The versions as they are now."""
        return self.versions.read().withColumn("is_current", F.col("valid_to").isNull()).select(*self.keys, *self.tracked, "valid_from", "valid_to", "is_current")

    def apply(self, batch: DataFrame) -> None:
        """Take a batch of rows. Rows need a key and a time; a row without is an error, as it has no place."""
        columns = list(dict.fromkeys([*self.keys, *self.tracked, *self.order]))
        rows = written(batch.select(*columns).dropDuplicates([*self.keys, *self.order]), "versions-batch")
        if not rows.where(" OR ".join(f"`{c}` IS NULL" for c in [*self.keys, self.at])).isEmpty():
            raise ValueError("rows without key or time cannot be placed")
        if not self.last.version():
            self._start(rows)
        first = rows.groupBy(*self.keys).agg(F.min(self.at).alias("_first"))
        known = written(self.last.lookup(first.select(*self.keys)).join(first, self.keys), "versions-known")
        late = F.col("_first") <= F.col(self.at)
        on_time = self._on_time(rows, known.where(~late), known.where(late))
        again, replaced = self._late(rows, known.where(late))
        found = written(on_time.unionByName(again), "versions-new")
        gone = replaced.join(found.select(*self.keys, "valid_from"), [*self.keys, "valid_from"], "left_anti").withColumn("_gone", F.lit(True))

        # Later tables say what earlier ones hold: a batch that stops between two merges starts again from the same last rows.
        self.log.merge(rows)
        self.versions.merge(found.withColumn("_gone", F.lit(False)).unionByName(gone), deleted=F.col("_gone"))
        newest = rows.unionByName(known.select(*columns))
        newest = latest_per_key(newest, self.keys, *[F.desc(c) for c in self.order])
        current = found.where(F.col("valid_to").isNull()).select(*self.keys, F.struct("valid_from", *self.tracked).alias("open"))
        self.last.merge(newest.join(current, self.keys))

    def _start(self, rows: DataFrame) -> None:
        none = rows.limit(0)
        time = none.schema[self.at].dataType.simpleString()
        ends = [F.lit(None).cast(time).alias(c) for c in ("valid_from", "valid_to")]
        self.log.create(none)
        self.versions.create(none.select(*self.keys, *self.tracked, *ends))
        self.last.create(none.withColumn("valid_from", ends[0]).select("*", F.struct("valid_from", *self.tracked).alias("open")).drop("valid_from"))

    def _intervals(self, rows: DataFrame, open_versions: DataFrame | None = None) -> DataFrame:
        """Versions of rows, where ``_seen`` marks those that only tell the state before; ``open_versions`` go on."""
        busy = known_busy_keys(rows, self.keys, self.at)
        changes = history_from_changes(rows, self.keys, self.tracked, self.order, self.systime, carried=F.col("_seen"), busy=busy)
        if open_versions is not None:
            changes = changes.unionByName(open_versions)
        return versions(changes, self.keys, busy=busy).select(*self.keys, *self.tracked, "valid_from", "valid_to")

    def _on_time(self, rows: DataFrame, known: DataFrame, late: DataFrame) -> DataFrame:
        """Rows of keys that are new or whose rows all follow their last one."""
        new = rows.join(late.select(*self.keys), self.keys, "left_anti").withColumn("_seen", F.lit(False))
        before = known.select(*rows.columns).withColumn("_seen", F.lit(True))
        going_on = known.select(
            *self.keys,
            *[F.col(f"open.{c}").alias(c) for c in self.tracked],
            F.lit("").alias("history_id"),
            F.col("open.valid_from").alias("effective_time"),
            clock(self.systime).alias("systime"),
            F.lit("UPDATE").alias("operation_type"),
        )
        return self._intervals(new.unionByName(before), going_on)

    def _late(self, rows: DataFrame, late: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Keys with late rows, from the version before their earliest one on: the versions, and those they replace."""
        if late.isEmpty():
            none = self.versions.read().limit(0)
            return none, none
        held = self.versions.lookup(late.select(*self.keys)).join(late.select(*self.keys, "_first"), self.keys)
        held = written(held, "versions-held")
        before = F.when(F.col("valid_from") < F.col("_first"), F.col("valid_from"))
        start = written(held.groupBy(*self.keys).agg(F.max(before).alias("_start")), "versions-start")
        after = F.col("_start").isNull() | (F.col(self.at) >= F.col("_start"))
        past = self.log.lookup(late.select(*self.keys)).unionByName(rows.join(late.select(*self.keys), self.keys, "left_semi"))
        past = written(past.dropDuplicates([*self.keys, *self.order]).join(start, self.keys), "versions-past")
        carried = latest_per_key(past.where(~after), self.keys, *[F.desc(c) for c in self.order]).withColumn("_seen", F.lit(True))
        tail = past.where(after).withColumn("_seen", F.lit(False)).unionByName(carried).drop("_start")
        replaced = held.join(start, self.keys).where(F.col("_start").isNull() | (F.col("valid_from") >= F.col("_start")))
        return self._intervals(tail), replaced.select(*self.keys, *self.tracked, "valid_from", "valid_to")
