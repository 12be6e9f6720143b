"""Scans: files, JDBC tables, filtered, limited and incremental reads, newest snapshots."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orelayer.functions.columns import clock, stamp_source
from orelayer.session import file_names

SNAPSHOT_NAME = r"(\d{8}_\d{6})\.(parquet|json)"  # fixed value: yyyymmdd_hhmmss folder names


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- files


def read_json(spark: SparkSession, path: str, schema: StructType | str, *, array_file: bool = False) -> DataFrame:
    """JSON lines, or with ``array_file`` files that hold one JSON array each.

    An array file cannot be split between tasks; land large tables as lines.
    """
    return spark.read.schema(schema).option("multiLine", array_file).json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header line. The schema is declared, so there is no inference pass over the file."""
    return spark.read.schema(schema).option("header", True).csv(path)


# ---------------------------------------------------------------- databases


def jdbc_options(
    url: str,
    table: str,
    *,
    schema: str | None = None,
    partition_column: str | None = None,
    lower: int | str | None = None,
    upper: int | str | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
    **credentials: str,
) -> dict[str, str]:
    """Options of a database scan.

    With ``partition_column`` and its bounds the scan runs as ``partitions`` range queries side by side;
    rows outside the bounds still arrive, in the first and last range. Without it Spark reads in one task.
    """
    options = {
        "url": url,
        "dbtable": f"{schema}.{table}" if schema else table,
        "fetchsize": str(fetch_size),
        "pushDownLimit": "true",
        **credentials,
    }
    if partition_column is not None:
        if lower is None or upper is None or partitions is None:
            raise ValueError("a partition column needs lower, upper and partitions")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(
    spark: SparkSession, url: str, table: str, *, predicates: Sequence[str] | None = None, **options
) -> DataFrame:
    """A database table. ``predicates`` gives one scan range each, for keys too unevenly spread for equal
    ranges: a range that holds a third of the rows can be cut by a second column."""
    settings = jdbc_options(url, table, **options)
    if predicates:
        properties = {k: v for k, v in settings.items() if k not in ("url", "dbtable")}
        return spark.read.jdbc(url, settings["dbtable"], predicates=list(predicates), properties=properties)
    return spark.read.format("jdbc").options(**settings).load()


# ---------------------------------------------------------------- scan shapes


def extract(df: DataFrame, where: Column | str | None = None, limit: int | None = None) -> DataFrame:
    """Filter, then limit. Both reach the file or database scan."""
    rows = df if where is None else df.where(where)
    return rows if limit is None else rows.limit(limit)


def extract_incremental(
    df: DataFrame,
    changed_at: str,
    mark: datetime | str,
    *,
    source_system: str,
    source_table: str,
    source_host: str,
    load_time: datetime | str | None = None,
) -> DataFrame:
    """Rows changed after the mark, the mark itself excluded; a null change time never matches."""
    rows = df.where(F.col(changed_at) > clock(mark))
    return stamp_source(rows, source_system, source_table, source_host, "incremental", load_time)


def next_mark(df: DataFrame, changed_at: str, source_table: str) -> DataFrame:
    """One row for the mark table: where the next incremental scan starts."""
    return df.agg(F.max(changed_at).alias("mark")).select(F.lit(source_table).alias("source_table"), "mark")


def read_mark(marks: DataFrame, source_table: str) -> datetime | None:
    """The newest mark kept for a table; one value comes to the driver."""
    return marks.where(F.col("source_table") == source_table).agg(F.max("mark")).first()[0]


def scan_summary(df: DataFrame, source_table: str, sample_rows: int = 1000) -> DataFrame:
    """How many rows a table has, and how many came when its first ``sample_rows`` rows were read."""
    count = F.count(F.lit(1))
    sampled = extract(df, limit=sample_rows).agg(count).scalar()
    return df.agg(count.alias("row_count")).select(
        F.lit(source_table).alias("source_table"), "row_count", sampled.alias("sample_rows_read")
    )


# ---------------------------------------------------------------- snapshots


def read_snapshots(spark: SparkSession, root: str, source_system: str, table_name: str) -> DataFrame:
    """Every parquet snapshot of a table, with its name in ``bronze_snapshot``."""
    rows = spark.read.parquet(f"{root}/{source_system}/{table_name}/*.parquet")
    return rows.withColumn("bronze_snapshot", F.regexp_extract(F.col("_metadata.file_path"), f"/{SNAPSHOT_NAME}/", 1))


def read_latest_snapshot(
    spark: SparkSession, root: str, source_system: str, table_name: str, schema: StructType | str | None = None
) -> DataFrame:
    """The newest snapshot only, found by listing folder names; no job runs and no file is opened for that.

    Of one time the parquet form is read. ``schema`` is needed where the newest snapshot is JSON.
    """
    folder = f"{root}/{source_system}/{table_name}"
    names = [m for m in map(re.compile(SNAPSHOT_NAME).fullmatch, file_names(spark, f"{folder}/*")) if m]
    if not names:
        raise FileNotFoundError(f"no snapshot in {folder}")
    newest = max(names, key=lambda m: (m[1], m[2] == "parquet"))
    path = f"{folder}/{newest[0]}"
    return spark.read.parquet(path) if newest[2] == "parquet" else read_json(spark, path, schema)


def source_tables(
    spark: SparkSession, spec: Mapping, folder: str | None = None, jdbc: Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """The tables a warehouse spec lists, read from a folder of parquet files or a database."""
    names = [job["table"] for job in spec["warehouse"].get("bronze_jobs", [])]
    if folder is not None:
        return {name: table(spark, folder, name) for name in names}
    return {name: read_jdbc(spark, table=name, **jdbc) for name in names}
