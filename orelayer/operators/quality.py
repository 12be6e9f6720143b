"""Data-quality checks. A check counts failing rows; results are rows of one report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orelayer.functions.columns import (
    BRONZE_FILE_COLUMNS,
    EXTRACTION_METHODS,
    HISTORY_COLUMNS,
    Field,
    business_columns,
    lost_in_cast,
    tracked_columns,
)

REPORT_SCHEMA = "table_name string, check_name string, column_name string, failing_rows bigint, status string"


class RowCheck(NamedTuple):
    """A check that one row passes or fails on its own."""

    name: str
    column: str
    fails: Column


def not_null(*columns: str) -> list[RowCheck]:
    return [RowCheck("not_null", c, F.col(c).isNull()) for c in columns]


def accepted_values(column: str, values: Sequence) -> RowCheck:
    """Nulls pass: their absence is the business of ``not_null``."""
    return RowCheck("accepted_values", column, F.coalesce(~F.col(column).isin(*values), F.lit(False)))


def bronze_checks(columns: Sequence[str]) -> list[RowCheck]:
    """Landed rows carry every ``bronze_*`` column, filled, with a known extraction method."""
    missing = [RowCheck("column_present", c, F.lit(True)) for c in BRONZE_FILE_COLUMNS if c not in columns]
    present = [c for c in BRONZE_FILE_COLUMNS if c in columns]
    checks = missing + not_null(*present)
    if "bronze_extraction_method" in present:
        checks.append(accepted_values("bronze_extraction_method", EXTRACTION_METHODS))
    return checks


def cast_checks(fields: Sequence[Field]) -> list[RowCheck]:
    """Values that do not cast, and texts that are cut."""
    checked = [f for f in fields if f.type != "string" or f.length is not None]
    return [RowCheck("cut" if f.type == "string" else "cast", f.target, lost_in_cast(f)) for f in checked]


def status(failing: Column) -> Column:
    return F.when(failing == 0, "PASS").otherwise("FAIL")


def _report(df: DataFrame) -> DataFrame:
    return df.select(
        "table_name",
        "check_name",
        "column_name",
        F.col("failing_rows").cast("bigint").alias("failing_rows"),
        "status",
    )


# ---------------------------------------------------------------- report rows


def check_rows(df: DataFrame, table: str, checks: Sequence[RowCheck]) -> DataFrame:
    """All row checks of a table in one pass: one conditional count each, no shuffle of rows."""
    counts = df.agg(*[F.count_if(c.fails).alias(f"_{i}") for i, c in enumerate(checks)])
    lines = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("check_name"), F.lit(c.column).alias("column_name"), F.col(f"_{i}").alias("failing_rows")
            )
            for i, c in enumerate(checks)
        ]
    )
    return _report(
        counts.select(F.explode(lines).alias("line"))
        .select(F.lit(table).alias("table_name"), "line.*")
        .withColumn("status", status(F.col("failing_rows")))
    )


def check_unique(df: DataFrame, table: str, *keys: str) -> DataFrame:
    """How many keys occur more than once; rows with a null in the key are ignored."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    repeated = df.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _single(repeated.agg(F.count(F.lit(1)).alias("failing_rows")), table, "unique", ",".join(keys))


def check_relationship(child: DataFrame, table: str, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Child rows whose key is set but not found in the parent.

    Rows are counted per key before the join, so a busy key crosses the network as one row per task.
    """
    failing = _orphans_by_key(child.where(F.col(column).isNotNull()), column, parent, field)
    return _single(failing.agg(_total()), table, "relationships", column)


def check_orphans(child: DataFrame, table: str, column: str, parent: DataFrame, field: str) -> DataFrame:
    """As :func:`check_relationship`, but a null key counts as an orphan too."""
    return _single(_orphans_by_key(child, column, parent, field).agg(_total()), table, "orphans", column)


def _orphans_by_key(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    counts = child.groupBy(F.col(column).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.join(parent.select(F.col(field).alias("_parent")), F.col("_key") == F.col("_parent"), "left_anti")


def _total() -> Column:
    return F.coalesce(F.sum("_n"), F.lit(0)).alias("failing_rows")


def _single(failing: DataFrame, table: str, check: str, column: str) -> DataFrame:
    return _report(
        failing.withColumns(
            {
                "table_name": F.lit(table),
                "check_name": F.lit(check),
                "column_name": F.lit(column),
                "status": status(F.col("failing_rows")),
            }
        )
    )


def check_match(left: DataFrame, right: DataFrame, table: str) -> DataFrame:
    """Rows landed against rows extracted; the difference is what fails."""
    counts = [df.agg(F.count(F.lit(1)).alias("_n")).withColumn("_side", F.lit(i)) for i, df in enumerate((left, right))]
    both = counts[0].unionByName(counts[1]).agg(F.abs(F.max("_n") - F.min("_n")).alias("failing_rows"))
    return _single(both, table, "row_count_match", "*")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, row_count`` for many tables; parquet counts come from file footers."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def check_counts(counts: DataFrame, expected: Mapping[str, int | None]) -> DataFrame:
    """Row counts against expectations: as expected PASS, other but not empty WARN, empty FAIL.

    An expectation of None asks only that the table is not empty. A table without a count is missing: FAIL.
    """
    spark = counts.sparkSession
    wanted = spark.createDataFrame(list(expected.items()), "table_name string, expected bigint")
    rows = F.coalesce(F.col("row_count"), F.lit(0))
    verdict = (
        F.when(rows == 0, "FAIL")
        .when(F.col("expected").isNull() | (rows == F.col("expected")), "PASS")
        .otherwise("WARN")
    )
    return (
        wanted.join(counts, "table_name", "left")
        .select("table_name", rows.alias("row_count"), "expected", verdict.alias("status"))
    )


def check_contract(df: DataFrame, table: str, fields: Sequence[Field], allow_extra: bool = False) -> DataFrame:
    """A landed table against its declared columns: missing, extra, and present values that do not cast."""
    landed = business_columns(df)
    declared = [f.source for f in fields]
    schema_checks = [RowCheck("missing_column", c, F.lit(True)) for c in declared if c not in landed]
    if not allow_extra:
        schema_checks += [RowCheck("extra_column", c, F.lit(True)) for c in landed if c not in declared]
    structure = _static(df.sparkSession, [(table, c.name, c.column, 1, "FAIL") for c in schema_checks])
    present = [f for f in fields if f.source in landed and (f.type != "string" or f.length is not None)]
    return structure.unionByName(check_rows(df, table, cast_checks(present))) if present else structure


def check_types(df: DataFrame, table: str, declared: StructType) -> DataFrame:
    """Declared and actual schema side by side: missing, extra and mistyped columns."""
    actual = {f.name: f.dataType for f in df.schema}
    rows = []
    for field in declared:
        if field.name not in actual:
            rows.append((table, "missing_column", field.name, 1, "FAIL"))
        elif actual[field.name] != field.dataType:
            rows.append((table, "mistyped_column", field.name, 1, "FAIL"))
    rows += [(table, "extra_column", c, 1, "FAIL") for c in actual if c not in declared.names]
    return _static(df.sparkSession, rows)


def check_history_pair(
    spark: SparkSession, table: str, primary: StructType, history: StructType, exclude: Sequence[str] = ()
) -> DataFrame:
    """A history table has every tracked and history column and no excluded one.

    The clocks ``effective_time`` and ``systime`` are history columns, not excluded ones. The last two rows
    give how many columns of the primary table are tracked and excluded.
    """
    tracked = tracked_columns(primary.names, exclude)
    excluded = [c for c in primary.names if c not in tracked]
    rows = [(table, "tracked_column_missing", c, 1, "FAIL") for c in tracked if c not in history.names]
    rows += [(table, "history_column_missing", c, 1, "FAIL") for c in HISTORY_COLUMNS if c not in history.names]
    rows += [
        (table, "excluded_column_present", c, 1, "FAIL")
        for c in excluded
        if c in history.names and c not in HISTORY_COLUMNS
    ]
    rows.append((table, "tracked_columns", "*", len(tracked), "PASS"))
    rows.append((table, "excluded_columns", "*", len(excluded), "PASS"))
    return _static(spark, rows)


def _static(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(checked: DataFrame, layer: str) -> None:
    """Stop a build on failed checks. Warnings pass. Only failed report lines reach the driver."""
    failed = checked.where(F.col("status") == "FAIL").collect()
    if failed:
        lines = "; ".join(f"{r.table_name}.{r.column_name} {r.check_name}: {r.failing_rows}" for r in failed)
        raise ValueError(f"{layer} checks failed: {lines}")


# ---------------------------------------------------------------- failing rows and scores


def failing(df: DataFrame, checks: Sequence[RowCheck]) -> DataFrame:
    """Rows that fail any of the checks, with the names of those they fail in ``failed_checks``."""
    names = F.array_compact(F.array(*[F.when(c.fails, F.lit(f"{c.name}:{c.column}")) for c in checks]))
    return df.withColumn("failed_checks", names).where(F.size("failed_checks") > 0)


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Child rows that have no parent row, null keys included.

    Rows without a key need no join: kept out of it, they do not all meet in one task.
    """
    keys = parent.select(F.col(field).alias("_parent"))
    known = child.where(F.col(column).isNotNull())
    unmatched = known.join(keys, F.col(column) == F.col("_parent"), "left_anti")
    return unmatched.unionByName(child.where(F.col(column).isNull()))


def quality_score(checks: Sequence[RowCheck]) -> Column:
    """The share of row checks a row passes, as ``sl_data_quality_score``."""
    passed = sum((F.when(c.fails, 0).otherwise(1) for c in checks), F.lit(0))
    return passed / F.lit(float(len(checks)))


# ---------------------------------------------------------------- profile


def profile(df: DataFrame, table: str, columns: Sequence[str] | None = None, *, exact: bool = False) -> DataFrame:
    """Rows, nulls, distinct values, smallest and largest value (as text) of each column.

    The estimate of distinct values takes one pass with fixed-size sketches. ``exact`` counts each column
    by its values, reading that column alone, with counts combined before the shuffle.
    """
    names = list(columns or df.columns)
    if exact:
        return reduce(DataFrame.unionByName, [_column_profile(df, table, c) for c in names])
    rows = F.count(F.lit(1)).alias("rows")
    aggregates = []
    for i, c in enumerate(names):
        aggregates += [
            F.count(c).alias(f"_count{i}"),
            F.approx_count_distinct(c).alias(f"_distinct{i}"),
            F.min(c).cast("string").alias(f"_min{i}"),
            F.max(c).cast("string").alias(f"_max{i}"),
        ]
    lines = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("rows").alias("row_count"),
                (F.col("rows") - F.col(f"_count{i}")).alias("null_count"),
                F.col(f"_distinct{i}").alias("distinct_count"),
                F.col(f"_min{i}").alias("min_value"),
                F.col(f"_max{i}").alias("max_value"),
            )
            for i, c in enumerate(names)
        ]
    )
    one = df.agg(rows, *aggregates).select(F.explode(lines).alias("line"))
    return one.select(F.lit(table).alias("table_name"), "line.*")


def _column_profile(df: DataFrame, table: str, name: str) -> DataFrame:
    values = df.groupBy(F.col(name).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    nulls = F.coalesce(F.sum(F.when(F.col("_value").isNull(), F.col("_n"))), F.lit(0))
    return values.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        nulls.alias("null_count"),
        F.count("_value").alias("distinct_count"),
        F.min("_value").cast("string").alias("min_value"),
        F.max("_value").cast("string").alias("max_value"),
    ).select(F.lit(table).alias("table_name"), F.lit(name).alias("column_name"), "*")
