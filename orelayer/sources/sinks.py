"""Writers. Each returns what it wrote; row counts are observed while writing, never by a second scan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orelayer.functions.columns import clock
from orelayer.session import written

# The columns of the ingestion log.
LOG_SCHEMA = (
    "source_table string, target_schema string, row_count bigint, ingestion_time timestamp_ntz, "
    "run_id string, status string"
)


def counted(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Run a write and return the number of rows that passed through it."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return int(seen.get["rows"])


def balanced(df: DataFrame, partition_cols: Sequence[str]) -> DataFrame:
    """Bring rows of an output partition together without making one task per partition value.

    The rebalance hint shuffles on the columns, after which adaptive execution splits large partitions and
    merges small ones: few files per partition, and no task that holds a whole busy one.
    """
    return df.hint("rebalance", *partition_cols) if partition_cols else df


# ---------------------------------------------------------------- file snapshots


def write_snapshot(
    df: DataFrame,
    root: str,
    source_system: str,
    table_name: str,
    taken_at: datetime,
    formats: Sequence[str] = ("parquet", "json"),
    partition_cols: Sequence[str] = (),
) -> dict[str, str]:
    """Write ``<root>/<system>/<table>/<yyyymmdd_hhmmss>.<format>`` per format; returns format -> path.

    Each path is a folder of part files, and JSON is written as lines, so that both are written and read in
    parallel. Two formats are two passes over ``df``; write it once and read it back if it is costly.
    """
    unknown = set(formats) - {"parquet", "json"}
    if unknown:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    paths = {}
    for format_ in formats:
        path = f"{root}/{source_system}/{table_name}/{taken_at:%Y%m%d_%H%M%S}.{format_}"
        writer = balanced(df, partition_cols).write.mode("overwrite").format(format_)
        if format_ == "json":
            writer = writer.option("ignoreNullFields", False)
        (writer.partitionBy(*partition_cols) if partition_cols else writer).save(path)
        paths[format_] = path
    return paths


def write_csv(df: DataFrame, path: str) -> int:
    return counted(df, lambda rows: rows.write.mode("overwrite").option("header", True).csv(path))


# ---------------------------------------------------------------- layered tables in a folder


def layer_path(root: str, schema: str, name: str) -> str:
    return f"{root.rstrip('/')}/{schema}/{name}"


def write_batch(
    df: DataFrame, root: str, schema: str, name: str, batch_id: str, partition_cols: Sequence[str] = ()
) -> int:
    """Write one batch of a layer table to its own folder; a batch that runs again replaces only itself.

    A job never overwrites a path it reads: readers of earlier batches are not disturbed.
    """
    path = f"{layer_path(root, schema, name)}/batch_id={batch_id}"

    def write(rows: DataFrame) -> None:
        writer = balanced(rows, partition_cols).write.mode("overwrite")
        (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(path)

    return counted(df, write)


def read_batch(spark: SparkSession, root: str, schema: str, name: str, batch_id: str) -> DataFrame:
    return spark.read.parquet(f"{layer_path(root, schema, name)}/batch_id={batch_id}")


def append_history(history: DataFrame, root: str, schema: str, name: str, batch_id: str) -> int:
    """Add a batch of history rows, laid out by the date they take effect.

    History keys are the same on every run of a batch, and a batch replaces only its own folder, so a
    retry after a failure leaves no duplicates.
    """
    dated = history.withColumn("effective_date", F.to_date("effective_time"))
    return write_batch(dated, root, schema, name, batch_id, ["effective_date"])


# ---------------------------------------------------------------- catalog tables


def replace_table(
    df: DataFrame,
    name: str,
    *,
    on_empty: str = "replace",
    bucket_by: Sequence[str] = (),
    buckets: int = 0,
    partition_cols: Sequence[str] = (),
) -> int:
    """Replace a catalog table and return its row count.

    ``on_empty="keep"`` leaves the old table when the new rows are none. Tables bucketed on their unique
    key join each other and their next snapshot without a shuffle.
    """
    if on_empty not in ("replace", "keep"):
        raise ValueError("on_empty is 'replace' or 'keep'")
    if on_empty == "keep":
        df = written(df, "staged")  # the plan runs once: whether there are rows is read from what it wrote
        if df.isEmpty():
            return 0

    def write(rows: DataFrame) -> None:
        if bucket_by:
            # One shuffle on the bucket columns, so that a task writes one file of one bucket.
            writer = rows.repartition(buckets, *bucket_by).write.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
        else:
            writer = balanced(rows, partition_cols).write
        if partition_cols:
            writer = writer.partitionBy(*partition_cols)
        writer.mode("overwrite").format("parquet").saveAsTable(name)

    return counted(df, write)


def materialise(df: DataFrame, schema: str, model: str, **options) -> int:
    """Write a model as the table of its name in its layer's schema."""
    df.sparkSession.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")
    return replace_table(df, f"`{schema}`.`{model}`", **options)


def load_tables(frames: Mapping[str, DataFrame], schema: str) -> dict[str, int]:
    """Load several tables; returns name -> rows."""
    return {name: materialise(df, schema, name) for name, df in frames.items()}


def empty_tables(spark: SparkSession, names: Sequence[str]) -> None:
    """Remove every row of the named tables and keep the tables."""
    for name in names:
        spark.sql(f"TRUNCATE TABLE {name}")


# ---------------------------------------------------------------- databases


def jdbc_write_options(
    url: str, table: str, *, schema: str = "staging", batch_size: int = 1000, replace: bool = True, **credentials: str
) -> dict[str, str]:
    """Options of a database write. The commit unit is a partition; ``batch_size`` is rows per round trip."""
    options = {"url": url, "dbtable": f"{schema}.{table}", "batchsize": str(batch_size), **credentials}
    return options | {"truncate": "true"} if replace else options


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    *,
    replace: bool = True,
    connections: int | None = None,
    on_empty: str = "replace",
    **options,
) -> int:
    """Write a database table over at most ``connections`` connections; returns the row count."""
    if on_empty == "keep":
        df = written(df, "staged")
        if df.isEmpty():
            return 0
    settings = jdbc_write_options(url, table, replace=replace, **options)
    rows = df if connections is None else df.repartition(connections)
    mode = "overwrite" if replace else "append"
    return counted(rows, lambda r: r.write.format("jdbc").options(**settings).mode(mode).save())


# ---------------------------------------------------------------- ingestion log


def log_entries(
    summary: DataFrame,
    target_schema: str,
    ingestion_time: datetime | str | None,
    run_id: str,
    status: str = "success",
) -> DataFrame:
    """Log rows for landed tables, from a frame of ``source_table`` and ``row_count``."""
    return summary.select(
        "source_table",
        F.lit(target_schema).alias("target_schema"),
        F.col("row_count").cast("bigint").alias("row_count"),
        clock(ingestion_time).alias("ingestion_time"),
        F.lit(run_id).alias("run_id"),
        F.lit(status).alias("status"),
    )


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)
