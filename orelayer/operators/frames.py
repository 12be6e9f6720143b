"""Filters, aggregates, stacking and merging for any table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from orelayer.functions.columns import TOTAL, clock
from orelayer.functions.skew import latest_per_key

# ---------------------------------------------------------------- filters


def active_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("inactivated_date").isNull())


def inactive_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("inactivated_date").isNotNull())


def soft_delete(df: DataFrame, keys: DataFrame, on: Sequence[str], now: datetime | str | None = None) -> DataFrame:
    """Mark the rows whose key is listed as inactive; rows already inactive keep their date."""
    marked = keys.select(*on).distinct().withColumn("_listed", F.lit(True))
    hit = F.col("_listed") & F.col("inactivated_date").isNull()
    return (
        df.join(marked, list(on), "left")
        .withColumns(
            {
                "systime": F.when(hit, clock(now)).otherwise(F.col("systime")),
                "inactivated_date": F.when(hit, clock(now)).otherwise(F.col("inactivated_date")),
            }
        )
        .select(*df.columns)
    )


def changed(columns: Sequence[str], old: str, new: str) -> Column:
    """True where any of the columns differs between two aliased frames; two nulls are equal."""
    differs = [~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}")) for c in columns]
    result = F.lit(False)
    for one in differs:
        result = result | one
    return result


# ---------------------------------------------------------------- aggregates


def sum_by(df: DataFrame, key: str, amount: str | Column, into: str, type_: str = TOTAL) -> DataFrame:
    """One total per key, so that a join with the result adds no rows."""
    return df.groupBy(key).agg(F.sum(amount).cast(type_).alias(into))


def mean_by(df: DataFrame, key: str, value: str, into: str, decimals: int = 6) -> DataFrame:
    """The mean per key. Decimals are summed exactly, so the mean does not depend on row order."""
    exact = F.sum(F.col(value).cast(f"decimal(18,{decimals})")).cast("double")
    return df.groupBy(key).agg((exact / F.count(value)).alias(into))


def sums_by(df: DataFrame, key: str) -> DataFrame:
    """The sum of every numeric column per key, under the columns' own names.

    Whole numbers are summed as decimals, which have room for the sum of any number of rows.
    """
    numeric = [f for f in df.schema if isinstance(f.dataType, NumericType) and f.name != key]
    wide = [F.col(f.name).cast("decimal(20,0)") if isinstance(f.dataType, IntegralType) else F.col(f.name) for f in numeric]
    return df.groupBy(key).agg(*[F.sum(c).alias(f.name) for c, f in zip(wide, numeric)])


def top_by(df: DataFrame, measure: str, tie_break: str, k: int) -> DataFrame:
    """The k rows with the largest measure; each task keeps k rows and the driver merges those."""
    return df.orderBy(F.desc(measure), F.asc(tie_break)).limit(k)


def rollup_by(df: DataFrame, levels: Sequence[str], **measures: Column) -> DataFrame:
    """Subtotals along the levels; ``level`` is the grouping id, which tells a subtotal from a null key."""
    aggregates = [column.alias(name) for name, column in measures.items()]
    return df.rollup(*levels).agg(F.grouping_id(*levels).cast("int").alias("level"), *aggregates)


# ---------------------------------------------------------------- stacking and merging


def map_columns(df: DataFrame, mapping: Mapping[str, Column | str]) -> DataFrame:
    """Target columns from source expressions: ``{"name": F.upper("full_name"), ...}``."""
    return df.select([(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in mapping.items()])


def stack_sources(sources: Mapping[str, DataFrame], tag: str = "source_system") -> DataFrame:
    """Mapped sources under one schema, each row tagged with its source; absent columns are null."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    stacked = tagged[0]
    for df in tagged[1:]:
        stacked = stacked.unionByName(df, allowMissingColumns=True)
    return stacked


def best_source_per_key(
    stacked: DataFrame,
    keys: Sequence[str],
    priority: Sequence[str],
    newest_first: Sequence[str],
    tag: str = "source_system",
) -> DataFrame:
    """One row per key: by order of sources, then newest. Sources not listed come last."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(tag))
    order = [F.when(rank == 0, F.lit(len(priority) + 1)).otherwise(rank), *[F.desc(c) for c in newest_first]]
    return latest_per_key(stacked, keys, *order)


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], newest_first: Sequence[str]) -> DataFrame:
    """The current table with changed and new rows put in, the newest change of a key winning.

    Columns the current table lacks are dropped from the changes. Write the result to a new version:
    plain files have no MERGE, and a job must not overwrite what it reads.
    """
    newest = latest_per_key(changes, keys, *[F.desc(c) for c in newest_first]).select(*current.columns)
    untouched = current.join(newest.select(*keys), list(keys), "left_anti").select(*current.columns)
    return untouched.unionByName(newest)
