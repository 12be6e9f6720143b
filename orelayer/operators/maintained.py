"""Rollups that follow a feed of changes: rows that are put in and taken out, never the whole table again.

A batch of signed rows leaves, per finest group, the signed count of rows, signed counts of flags and signed sums, and for columns whose least and
largest value are asked for how often each value came and went. Batches add up, so a row taken out by a later batch, or by one that
comes first, leaves nothing behind; and a least value that is taken out gives way to the next one. Batches have folders of their own:
one that runs again replaces itself. :func:`fold` puts all batches so far into one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelayer.functions.columns import TOTAL
from orelayer.session import file_names, path_exists, written
from orelayer.sources.sinks import layer_path, write_batch


class MaintainedRollup:
    """A rollup along ``levels`` with the sums of ``sums``, counts where ``flags`` hold, and bounds of ``bounds``, under ``root``."""

    def __init__(self, spark: SparkSession, root: str, name: str, levels: Sequence[str], sums: Sequence[str], flags: Sequence[str] = (), bounds: Sequence[str] = ()):
        self.spark, self.root, self.name = spark, root, name
        self.levels, self.sums, self.flags, self.bounds = list(levels), list(sums), list(flags), list(bounds)

    def apply(self, rows: DataFrame, batch_id: str, sign: Column | None = None) -> None:
        """Take a batch of rows; ``sign`` is 1 where a row is put in and -1 where it is taken out: by default all are put in.

        An update is two rows: the old one taken out, the new one put in, in the same batch or in any two.
        """
        signed = rows.withColumn("_sign", F.lit(1) if sign is None else sign)
        write_batch(self._totals(signed), self.root, "totals", self.name, batch_id)
        if self.bounds:
            write_batch(self._values(signed), self.root, "values", self.name, batch_id)

    def _totals(self, signed: DataFrame) -> DataFrame:
        amounts = [F.sum(F.col("_sign") * F.col(c)).cast(TOTAL).alias(c) for c in self.sums]
        known = [F.sum(F.when(F.col(c).isNotNull(), F.col("_sign"))).cast("bigint").alias(f"known_{c}") for c in self.sums]
        flags = [F.coalesce(F.sum(F.when(F.col(c), F.col("_sign"))), F.lit(0)).cast("bigint").alias(c) for c in self.flags]
        return signed.groupBy(*self.levels).agg(F.sum("_sign").cast("bigint").alias("rows"), *amounts, *known, *flags)

    def _values(self, signed: DataFrame) -> DataFrame:
        """How often each value of a bounded column came, less how often it went."""
        counted = [
            signed.where(F.col(c).isNotNull()).groupBy(*self.levels, F.lit(c).alias("column"), F.col(c).cast(TOTAL).alias("value")).agg(F.sum("_sign").cast("bigint").alias("n"))
            for c in self.bounds
        ]
        return reduce(DataFrame.unionByName, counted).where("n <> 0")

    def batches(self) -> list[str]:
        return [n.partition("=")[2] for n in file_names(self.spark, f"{layer_path(self.root, 'totals', self.name)}/batch_id=*")]

    def _added(self, kind: str, keys: Sequence[str]) -> DataFrame:
        path = layer_path(self.root, kind, self.name)
        rows = self.spark.read.parquet(path).drop("batch_id")
        sums = [F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(*sums)

    def read(self) -> DataFrame:
        """The rollup as it is now: ``level``, ``rows``, the sums, flags and bounds. Groups that have lost all rows are gone."""
        totals = self._added("totals", self.levels).where("rows <> 0")
        level = F.grouping_id(*self.levels).cast("int").alias("level")
        plain = [F.sum(c).cast("bigint").alias(c) for c in ("rows", *self.flags)]
        # A sum of no known value is null, as it is where the table is summed.
        amounts = [F.when(F.sum(f"known_{c}") != 0, F.sum(c)).cast(TOTAL).alias(c) for c in self.sums]
        found = totals.rollup(*self.levels).agg(level, *plain, *amounts)
        if not self.bounds or not path_exists(self.spark, layer_path(self.root, "values", self.name)):
            return found
        values = self._added("values", [*self.levels, "column", "value"]).where("n > 0")
        ends = [
            end(F.when(F.col("column") == c, F.col("value"))).alias(f"{name}_{c}") for c in self.bounds for name, end in (("least", F.min), ("largest", F.max))
        ]
        bounds = values.rollup(*self.levels).agg(level, *ends)
        same = [found[c].eqNullSafe(bounds[c]) for c in (*self.levels, "level")]
        return found.join(bounds, same, "left").select(*[found[c] for c in found.columns], *[bounds[f"{n}_{c}"] for c in self.bounds for n in ("least", "largest")])

    def fold(self, batch_id: str) -> "MaintainedRollup":
        """A rollup of the same rows that starts from one batch, in a folder beside this one."""
        new = MaintainedRollup(self.spark, f"{self.root}/folded-{batch_id}", self.name, self.levels, self.sums, self.flags, self.bounds)
        write_batch(written(self._added("totals", self.levels).where("rows <> 0"), "folded"), new.root, "totals", self.name, batch_id)
        if self.bounds:
            values = self._added("values", [*self.levels, "column", "value"]).where("n <> 0")
            write_batch(values, new.root, "values", self.name, batch_id)
        return new
