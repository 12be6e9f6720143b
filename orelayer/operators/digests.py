"""Snapshots stored with a tree of digests, so that two of them are compared without reading what is alike.

A row lies in a range of the hash of its key. A range's digest is the number of its rows and the exclusive or of their record hashes, so it
does not depend on row order, and a node's digest follows from those of its children. Two trees are compared from the root down: only
children of nodes that differ are looked at, and only ranges whose digests differ are compared row by row.

Ranges may be small and many. Rows lie in folders of some hundred thousand rows, sorted by range, so their number follows from the size
of the table and not from that of a range; a comparison opens the folders with ranges that differ and keeps the rows of these ranges.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orelayer.functions.columns import nested_columns, record_hash, tracked_columns
from orelayer.operators.history import snapshot_diff
from orelayer.session import written
from orelayer.sources.sinks import balanced, counted

# Children of a node: each level of the tree takes four more bits of the hash.
LEVEL_BITS = 4
DIGEST = "level int, node bigint, rows bigint, low bigint, high bigint"
# A folder has at most so many rows, or one range.
ROWS_PER_FOLDER = 1_000_000
# So many ranges are looked up in files by their bounds; more are joined.
NAMED_RANGES = 100


@dataclass(frozen=True)
class Compared:
    """How a comparison went: nodes looked at and found to differ on every level, rows in ranges to compare and rows in both snapshots."""

    looked_at: list[int]
    differing: list[int]
    rows_read: int
    rows: int


class DigestedSnapshots:
    """Snapshots of one table under ``root``, keyed by ``keys``; ``exclude`` names columns that are not tracked."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], exclude: Sequence[str] = (), rows_per_range: int = 1_000_000):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.exclude, self.rows_per_range = list(exclude), rows_per_range

    def write(self, df: DataFrame, batch_id: str) -> int:
        """Store a snapshot in ranges, then its digests; returns its number of rows. A batch that runs again replaces itself.

        The number of levels follows from the number of rows. Counting them is one pass over the source: give a written frame if that is costly.
        """
        place = f"{self.root}/{batch_id}"
        rows = df.count()
        levels = _levels(rows, self.rows_per_range)
        folders = _levels(rows, max(self.rows_per_range, ROWS_PER_FOLDER))
        ranged = df.withColumn("_range", _node(self.keys, levels)).withColumn("_folder", _above("_range", levels - folders))
        sorted_ = balanced(ranged, ["_folder"]).sortWithinPartitions("_folder", "_range")
        stored = counted(sorted_, lambda r: r.write.mode("overwrite").partitionBy("_folder").parquet(f"{place}/rows"))
        saved = self._rows(batch_id, df.schema)
        tracked = tracked_columns(df.columns, self.exclude)
        whole = record_hash(tracked, nested=[c for c in nested_columns(df) if c in tracked])
        leaves = saved.select("_range", whole.alias("hash")).groupBy("_range").agg(F.count(F.lit(1)).alias("rows"), *_joined(_part(1), _part(16)))
        every = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
        node = F.expr(f"shiftright(_range, {LEVEL_BITS} * ({levels} - level))").alias("node")
        nodes = every.groupBy("level", node).agg(F.sum("rows").alias("rows"), *_joined(F.col("low"), F.col("high")))
        balanced(nodes, ["level"]).write.mode("overwrite").partitionBy("level").parquet(f"{place}/digests")
        note = json.dumps({"levels": levels, "folders": folders, "rows": stored, "schema": df.schema.json()})
        self.spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{place}/note")
        return stored

    def _note(self, batch_id: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/{batch_id}/note").first()[0])

    def _rows(self, batch_id: str, schema: StructType) -> DataFrame:
        kept = StructType([*schema.fields]).add("_range", "long").add("_folder", "long")
        return self.spark.read.schema(kept).parquet(f"{self.root}/{batch_id}/rows")

    def _digests(self, batch_id: str, level: int) -> DataFrame:
        return self.spark.read.schema(DIGEST).parquet(f"{self.root}/{batch_id}/digests").where(F.col("level") == level)

    def read(self, batch_id: str, nodes: DataFrame | None = None, level: int = 0) -> DataFrame:
        """A snapshot, or the ranges of it that lie under the ``node`` of a frame, nodes of a level.

        The driver gets the folders to read, or nodes above them.
        """
        note = self._note(batch_id)
        schema = StructType.fromJson(json.loads(note["schema"]))
        rows = self._rows(batch_id, schema)
        if nodes is not None:
            lower = note["levels"] - level
            deeper = level - note["folders"]
            opened = nodes.select(_above("node", max(deeper, 0)).alias("node")).distinct()
            rows = rows.where(_above("_folder", max(-deeper, 0)).isin([r.node for r in opened.collect()]))
            named = nodes.select("node").limit(NAMED_RANGES + 1).collect() if deeper > 0 else []
            if len(named) > NAMED_RANGES:
                rows = rows.join(nodes.select(F.col("node").alias("_node")), _above("_range", lower) == F.col("_node"), "left_semi")
            elif named:
                bits = LEVEL_BITS * lower
                bounds = [F.col("_range").between(r.node << bits, (r.node + 1 << bits) - 1) for r in named]
                rows = rows.where(reduce(Column.__or__, bounds))
        return rows.select(*schema.names)

    def _differing(self, old: str, new: str) -> tuple[DataFrame, int, Compared]:
        """As :meth:`compare`, with the nodes as a written frame: however many differ, the driver gets their number."""
        notes = self._note(old), self._note(new)
        deepest = min(n["levels"] for n in notes)
        looked_at, differing = [], []
        for level in range(deepest + 1):
            sides = [self._digests(b, level).select("node", "rows", F.struct("rows", "low", "high").alias("digest")) for b in (old, new)]
            if level:
                wanted = found.select(F.col("node").alias("parent"))
                sides = [s.join(wanted, _above("node", 1) == F.col("parent"), "left_semi") for s in sides]
            one, other = (s.withColumnsRenamed({"rows": f"rows_{n}", "digest": n}) for s, n in zip(sides, "ab"))
            both = one.join(other, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
            nodes = both.select("node", (F.coalesce("rows_a", F.lit(0)) + F.coalesce("rows_b", F.lit(0))).alias("n"))
            seen = Observation()
            found = written(nodes.observe(seen, F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")), "differing")
            looked_at.append(differing[-1] << LEVEL_BITS if level else 1)
            differing.append(int(seen.get["nodes"]))
            if not differing[-1]:
                break
        return found, deepest, Compared(looked_at, differing, int(seen.get["rows"]), notes[0]["rows"] + notes[1]["rows"])

    def compare(self, old: str, new: str) -> tuple[list[int], int, Compared]:
        """The nodes that differ on the lowest level that both trees have, that level, and what was looked at.

        The driver gets the nodes: at most one for every range that has to be compared. :meth:`diff` goes without.
        """
        found, level, told = self._differing(old, new)
        return sorted(r.node for r in found.select("node").collect()), level, told

    def diff(self, old: str, new: str, batch_ts: datetime | str) -> DataFrame:
        """The history rows of :func:`orelayer.operators.history.snapshot_diff` from ``old`` to ``new``, from differing ranges only."""
        nodes, level, _ = self._differing(old, new)
        return snapshot_diff(self.read(old, nodes, level), self.read(new, nodes, level), self.keys, new, batch_ts, self.exclude)


def _levels(rows: int, size: int) -> int:
    """Levels below the root until a node has ``size`` rows or fewer."""
    levels = 0
    while rows > size << LEVEL_BITS * levels:
        levels += 1
    return levels


def _above(node: str, levels: int) -> Column:
    """The node so many levels above a node."""
    return F.shiftright(node, LEVEL_BITS * levels)


def _node(keys: Sequence[str], level: int) -> Column:
    """The node of a level that a key's hash falls under: its first bits."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - LEVEL_BITS * level) if level else F.lit(0).cast("bigint")


def _part(start: int) -> Column:
    """15 hexadecimal digits of a record hash as a number."""
    return F.conv(F.substring("hash", start, 15), 16, 10).cast("bigint")


def _joined(low: Column, high: Column) -> list[Column]:
    return [F.bit_xor(low).alias("low"), F.bit_xor(high).alias("high")]
