"""A table kept in files of key ranges, so that a merge reads and rewrites only the files its keys can be in.

Under the table's folder are

* ``data/version=<n>/cell=<c>/sub=<s>``: the files version ``n`` added; such a folder is a *unit*, a range of the leading key;
* ``bloom/version=<n>/...``: of every unit a Bloom filter of its keys, as rows of 64-bit words;
* ``manifest/version=<n>``: the units that make up version ``n``, each with its key bounds and number of rows.

A merge finds candidates by key bounds, tests their filters, and rewrites the units that may hold a changed key. New keys between them
are added as small units; where too many units overlap, the next merge there makes them one again. A unit that is not touched
stays where it is and is listed by the next manifest. The manifest is written last: a merge that fails leaves the table as it was, and
the merge that is run again replaces what the failed one left.

The manifest is metadata, a row per file of ``rows_per_file`` rows, and is planned with on the driver: a table of 10 billion rows has
some ten thousand. Filters and data never go there. Row keys are unique; rows whose leading key is null are kept, never matched.
"""

from __future__ import annotations

import bisect
import json
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orelayer.functions.skew import latest_per_key
from orelayer.session import file_names, path_exists, written
from orelayer.sources.sinks import counted

# Keys per 64-bit word of a filter, and bits that a key sets in its word: about one false positive in a hundred.
KEYS_PER_WORD = 5
BITS = 4


@dataclass(frozen=True)
class Unit:
    """A folder of files with the bounds of its leading key (null where it has none) and its number of rows."""

    path: str
    low: object
    high: object
    rows: int


@dataclass(frozen=True)
class Merged:
    """What a version was made of: units that stayed, were rewritten, and are new; and rows that were read for it."""

    version: int
    kept: int
    rewritten: int
    added: int
    rows_read: int
    rows: int


class KeyedTable:
    """A table under ``root`` keyed by ``keys``, laid out by the first of them.

    Filters are over ``indexed``, the first keys of the key: all by default. With fewer, :meth:`lookup` can ask for those alone.
    """

    def __init__(
        self, spark: SparkSession, root: str, keys: Sequence[str], *, indexed: Sequence[str] | None = None, rows_per_file: int = 1_000_000, overlap: int = 8
    ):
        self.spark, self.root, self.keys, self.indexed = spark, root.rstrip("/"), list(keys), list(indexed or keys)
        self.lead, self.rows_per_file, self.overlap = self.keys[0], rows_per_file, overlap

    # ------------------------------------------------------------ versions

    def version(self) -> int:
        """The newest whole version; 0 if there is none."""
        numbers = sorted((int(n.partition("=")[2]) for n in file_names(self.spark, f"{self.root}/manifest/version=*")), reverse=True)
        return next((n for n in numbers if path_exists(self.spark, f"{self.root}/manifest/version={n}/_SUCCESS")), 0)

    def units(self, version: int | None = None) -> list[Unit]:
        version = self.version() if version is None else version
        if not version:
            return []
        rows = self.spark.read.schema(self._manifest_schema()).parquet(f"{self.root}/manifest/version={version}").collect()
        return sorted((Unit(r.path, r.low, r.high, r.rows) for r in rows), key=lambda u: u.path)

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.root}/schema").first()[0]))

    def _manifest_schema(self) -> StructType:
        kind = self.schema()[self.lead].dataType.simpleString()
        return StructType.fromDDL(f"path string, low {kind}, high {kind}, rows bigint")

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.units(version))

    def _read(self, units: Sequence[Unit]) -> DataFrame:
        if not units:
            return self.spark.createDataFrame([], self.schema())
        return self.spark.read.schema(self.schema()).parquet(*[f"{self.root}/data/{u.path}" for u in units])

    # ------------------------------------------------------------ writing

    def create(self, df: DataFrame) -> Merged:
        """The first version."""
        if self.version():
            raise ValueError(f"{self.root} holds a table already")
        self.spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/schema")
        rows = written(df.withColumn("cell", F.lit(0)), "keyed-rows")
        added = self._add(rows, 1, rows.count())
        return self._commit(1, [], [], added, 0)

    def merge(self, changes: DataFrame, newest_first: Sequence[str] = (), deleted: Column | None = None) -> Merged:
        """The next version: the newest change of every key put in, or taken out where ``deleted`` holds for it.

        Columns that the table lacks are dropped from the changes.
        """
        version, schema = self.version(), self.schema()
        units = self.units(version)
        gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
        newest = changes.withColumn("_gone", gone)
        if newest_first:
            newest = latest_per_key(newest, self.keys, *[F.desc(c) for c in newest_first])
        newest = newest.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], "_gone")
        bounds = sorted({u.low for u in units if u.low is not None})
        rows = written(newest.withColumn("cell", self._cell(bounds)), "keyed-changes")

        candidates = self._candidates(rows, units, bounds)
        chosen = self._hits(candidates) | self._crowded(units, bounds, candidates)
        touched = [u for u in units if u.path in chosen]
        kept = [u for u in units if u.path not in chosen]
        out, read = rows.where("NOT _gone").drop("_gone"), sum(u.rows for u in touched)
        if touched:
            rest = self._read(touched).join(rows.select(*self.keys), self.keys, "left_anti").select(*schema.names)
            out = rest.withColumn("cell", self._cell(bounds)).unionByName(out)
        added = self._add(out, version + 1, read + rows.count())
        return self._commit(version + 1, kept, touched, added, read)

    def lookup(self, asked: DataFrame) -> DataFrame:
        """The rows of the keys in ``asked``, which has the indexed columns; only files that may hold one are read."""
        units = self.units()
        bounds = sorted({u.low for u in units if u.low is not None})
        kinds = {f.name: f.dataType for f in self.schema()}
        keys = asked.select(*[F.col(c).cast(kinds[c]).alias(c) for c in self.indexed]).distinct()
        keys = written(keys.withColumn("cell", self._cell(bounds)), "keyed-lookup")
        hit = self._hits(self._candidates(keys, units, bounds))
        return self._read([u for u in units if u.path in hit]).join(keys.select(*self.indexed), self.indexed, "left_semi")

    # ------------------------------------------------------------ finding files

    def _cell(self, bounds: list) -> Column:
        """How many bounds a row's leading key reaches: its place among them, found by binary search; -1 for null."""
        if not bounds:
            return F.when(F.col(self.lead).isNull(), -1).otherwise(0)
        told = self.spark.sparkContext.broadcast(bounds)

        def place(keys: pd.Series) -> pd.Series:
            return pd.Series([-1 if key is None or key != key else bisect.bisect_right(told.value, key) for key in keys], dtype="int32")

        def places(keys: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(np.asarray(told.value), keys.to_numpy(), side="right").astype("int32"))

        kind = self.schema()[self.lead].dataType.simpleString()
        if kind not in ("int", "bigint", "smallint", "double"):
            return F.pandas_udf(place, "int")(F.col(self.lead))
        # Nulls would turn whole numbers into floating-point ones on their way.
        found = F.pandas_udf(places, "int")(F.coalesce(F.col(self.lead), F.lit(0).cast(kind)))
        return F.when(F.col(self.lead).isNull(), -1).otherwise(found)

    def _spans(self, units: Sequence[Unit], bounds: list) -> list[tuple[int, Unit]]:
        """The cells that each unit reaches into."""
        return [
            (cell, u)
            for u in units
            if u.low is not None
            for cell in range(bisect.bisect_right(bounds, u.low), bisect.bisect_right(bounds, u.high) + 1)
        ]

    def _candidates(self, rows: DataFrame, units: Sequence[Unit], bounds: list) -> DataFrame | None:
        """The pairs of a key and a unit within whose bounds it lies: ``unit``, ``words`` of its filter, the indexed columns."""
        if not bounds:
            return None
        kind = self.schema()[self.lead].dataType.simpleString()
        spans = [(cell, u.path, u.low, u.high, words_of(u.rows)) for cell, u in self._spans(units, bounds)]
        known = self.spark.createDataFrame(spans, f"cell int, unit string, low {kind}, high {kind}, words bigint")
        within = (F.col("low") <= F.col(self.lead)) & (F.col(self.lead) <= F.col("high"))
        found = rows.select(*self.indexed, "cell").join(known, "cell").where(within)
        return written(found.select("unit", "words", "cell", *self.indexed), "keyed-candidates")

    def _hits(self, candidates: DataFrame | None) -> set[str]:
        """The units whose filters may hold one of their candidate keys."""
        paths = [r.unit for r in candidates.select("unit").distinct().collect()] if candidates else []
        if not paths:
            return set()
        word, mask = filter_place(self.indexed)
        asked = candidates.select("unit", word.alias("word"), mask.alias("mask")).distinct()
        filters = self.spark.read.schema("unit string, word bigint, bits bigint").parquet(*[f"{self.root}/bloom/{p}" for p in paths])
        found = asked.join(filters, ["unit", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        return {r.unit for r in found.select("unit").distinct().collect()}

    def _crowded(self, units: Sequence[Unit], bounds: list, candidates: DataFrame | None) -> set[str]:
        """The units of cells that changes fall into and that more than ``overlap`` units share."""
        spans = self._spans(units, bounds)
        shared = Counter(cell for cell, _ in spans)
        full = {cell for cell, n in shared.items() if n > self.overlap}
        if not full or not candidates:
            return set()
        changed = {r.cell for r in candidates.select("cell").distinct().collect()} & full
        return {u.path for cell, u in spans if cell in changed}

    # ------------------------------------------------------------ one version's files

    def _add(self, rows: DataFrame, version: int, count: int) -> list[Unit]:
        """Write rows that have a ``cell`` as units, in ranges of cell and leading key, with their filters."""
        data, bloom = f"{self.root}/data/version={version}", f"{self.root}/bloom/version={version}"
        parts = max(1, -(-count // self.rows_per_file))
        ranged = rows.repartitionByRange(parts, "cell", self.lead).withColumn("sub", F.spark_partition_id())
        ranged.write.mode("overwrite").partitionBy("cell", "sub").parquet(data)
        if not count:
            return []
        kind = self.schema()
        added = self.spark.read.schema(StructType([*kind.fields]).add("cell", "integer").add("sub", "integer")).parquet(data)
        bounds = added.groupBy("cell", "sub").agg(F.min(self.lead).alias("low"), F.max(self.lead).alias("high"), F.count(F.lit(1)).alias("rows"))
        unit = F.format_string(f"version={version}/cell=%d/sub=%d", "cell", "sub")
        found = bounds.withColumn("path", unit).collect()
        sizes = self.spark.createDataFrame([(r.cell, r.sub, words_of(r.rows)) for r in found] or [], "cell int, sub int, words bigint")
        word, mask = filter_place(self.indexed)
        words = added.join(sizes, ["cell", "sub"]).groupBy("cell", "sub", word.alias("word")).agg(F.bit_or(mask).alias("bits"))
        filters = words.withColumn("unit", unit).repartition("cell", "sub")
        filters.write.mode("overwrite").partitionBy("cell", "sub").parquet(bloom)
        return [Unit(r.path, r.low, r.high, r.rows) for r in found]

    def _commit(self, version: int, kept: Sequence[Unit], touched: Sequence[Unit], added: Sequence[Unit], read: int) -> Merged:
        units = [*kept, *added]
        rows = [(u.path, u.low, u.high, u.rows) for u in units]
        manifest = self.spark.createDataFrame(rows, self._manifest_schema()).coalesce(1)
        counted(manifest, lambda m: m.write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}"))
        return Merged(version, len(kept), len(touched), len(added), read, sum(u.rows for u in units))


def words_of(rows: int) -> int:
    """64-bit words in the filter of a unit with so many rows."""
    return max(1, rows // KEYS_PER_WORD)


def filter_place(columns: Sequence[str]) -> tuple[Column, Column]:
    """The word of a key in a filter of ``words`` words, and the bits it sets there."""
    spread = F.xxhash64(F.lit("bits"), *columns)
    mask = F.lit(0).cast("bigint")
    for i in range(BITS):
        # Hashes of 6 bits each, taken from different places of one number.
        place = F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return F.pmod(F.xxhash64(*columns), F.col("words")), mask
