"""Profiles of a table from sketches that are kept per batch and merged: no batch is read twice.

A batch leaves one row per column: counts, least and largest value, a sketch of its distinct values, for numbers a sketch of quantiles,
and counters of heavy values. Sketches of any batches merge into that of their union, whose error is bounded by the sketch, not by the
number of batches: about 2 % (one standard error) for distinct values with 4,096 registers, under 1.5 % of ranks for quantiles, and for
heavy values at most a ``counters``-th of all rows, on one side: a value's true count lies between its count and that plus ``slack``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from orelayer.sources.sinks import write_batch

REGISTERS = 12
COUNTERS = 200
PARTS = 64
QUANTILES = (0.25, 0.5, 0.75)
HEAVY = "array<struct<value:string,n:bigint>>"


def heaviest(values: Column, counters: int) -> Column:
    """Counters of the heaviest values: with more than ``counters``, the count of the next one is taken off all (Misra and Gries)."""
    ordered = F.array_sort(values, lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["value"] < b["value"], -1).otherwise(1))
    off = F.coalesce(F.get(ordered, F.lit(counters))["n"], F.lit(0).cast("bigint"))
    lessened = F.transform(F.slice(ordered, 1, counters), lambda x: F.struct(x["value"].alias("value"), (x["n"] - off).alias("n")))
    return F.struct(F.filter(lessened, lambda x: x["n"] > 0).cast(HEAVY).alias("values"), off.alias("off"))


def sketch(df: DataFrame, columns: Sequence[str] | None = None, counters: int = COUNTERS) -> DataFrame:
    """One row per column. Counts, bounds, distinct values and quantiles take one pass of partial aggregates.

    Heavy values are counted per value, combined in every task before the shuffle, then each of some parts of a column keeps its
    heaviest: a value's count is whole, so only what lies below the counters is lost.
    """
    return reduce(DataFrame.unionByName, [_sketch(df, c, counters) for c in columns or df.columns])


def _sketch(df: DataFrame, name: str, counters: int) -> DataFrame:
    value = F.col(name)
    number = isinstance(df.schema[name].dataType, NumericType)
    text = value.cast("string")
    quantiles = F.kll_sketch_agg_double(value.cast("double")) if number else F.lit(None).cast("binary")
    base = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(value).alias("known"),
        F.min(value).cast("string").alias("least"),
        F.max(value).cast("string").alias("largest"),
        (F.min(value) if number else F.lit(None)).cast("double").alias("low"),
        (F.max(value) if number else F.lit(None)).cast("double").alias("high"),
        F.hll_sketch_agg(text, REGISTERS).alias("distinct"),
        quantiles.alias("quantiles"),
    )
    counts = df.where(value.isNotNull()).groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # Whole counts: a part needs no more than its heaviest, so none holds a whole column.
    part = Window.partitionBy(F.pmod(F.xxhash64("value"), F.lit(PARTS))).orderBy(F.desc("n"), "value")
    top = counts.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= counters + 1)
    heavy = top.agg(heaviest(F.collect_list(F.struct("value", "n")), counters).alias("heavy"))
    return base.select(F.lit(name).alias("column_name"), "*", heavy.scalar().alias("heavy")).select(
        "column_name", "rows", "known", "least", "largest", "low", "high", "distinct", "quantiles",
        F.coalesce("heavy.values", F.array().cast(HEAVY)).alias("heavy"), F.coalesce("heavy.off", F.lit(0).cast("bigint")).alias("slack"),
    )


def keep(df: DataFrame, root: str, table: str, batch_id: str, columns: Sequence[str] | None = None, counters: int = COUNTERS) -> int:
    """Store the sketches of a batch; a batch that runs again replaces its own."""
    return write_batch(sketch(df, columns, counters).coalesce(1), root, "sketches", table, batch_id)


def merged(sketches: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The sketches of all batches as one row per column. Text bounds are compared as text, those of numbers as numbers."""
    number = F.col("low").isNotNull()
    smaller = F.coalesce(F.min_by("least", F.when(number, F.col("low"))), F.min("least"))
    larger = F.coalesce(F.max_by("largest", F.when(number, F.col("high"))), F.max("largest"))
    one = sketches.groupBy("column_name").agg(
        F.sum("rows").alias("rows"), F.sum("known").alias("known"), smaller.alias("least"), larger.alias("largest"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.sum("slack").alias("slack"),
    )
    values = sketches.select("column_name", F.explode("heavy").alias("v")).groupBy("column_name", "v.value").agg(F.sum("v.n").alias("n"))
    heavy = values.groupBy("column_name").agg(heaviest(F.collect_list(F.struct("value", "n")), counters).alias("heavy"))
    joined = one.join(heavy, "column_name", "left")
    more = F.coalesce("heavy.off", F.lit(0).cast("bigint"))
    return joined.select(
        *[c for c in one.columns if c != "slack"], (F.col("slack") + more).alias("slack"), F.coalesce("heavy.values", F.array().cast(HEAVY)).alias("heavy")
    )


def profile_of(sketches: DataFrame, table: str, counters: int = COUNTERS) -> DataFrame:
    """The profile that all batches together have, from their sketches alone."""
    one = merged(sketches, counters)
    ranks = F.array(*[F.lit(float(q)) for q in QUANTILES])
    quantiles = F.when(F.col("low").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", ranks))
    return one.select(
        F.lit(table).alias("table_name"),
        "column_name",
        F.col("rows").alias("row_count"),
        (F.col("rows") - F.col("known")).alias("null_count"),
        F.hll_sketch_estimate("distinct").alias("distinct_estimate"),
        F.col("least").alias("min_value"),
        F.col("largest").alias("max_value"),
        quantiles.alias("quantiles"),
        "heavy",
        "slack",
    )
