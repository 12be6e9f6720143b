"""Land new files as they arrive."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from orelayer.functions.columns import business_columns, nested_columns, plain_columns, record_hash, stamp_batch
from orelayer.session import path_exists, written
from orelayer.sources.sinks import balanced, layer_path, write_batch

# Digits of a record hash that tell the parts of the index of landed hashes: 256 parts.
PREFIX = 2


def read_arriving(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    *,
    only: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream over the parquet files of a folder, old and new; ``only`` is a file name pattern.

    ``files_per_batch`` bounds a micro-batch, and with it what one key can bring into it.
    """
    reader = spark.readStream.schema(schema)
    if only:
        reader = reader.option("pathGlobFilter", only)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a streaming query keeps in its checkpoint: the same on every restart, another for another checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def claim(spark: SparkSession, folder: str, checkpoint: str, stream: str | None) -> str:
    """The name under which a stream writes its batches into a table's folder.

    Without a name it is the id in the checkpoint, so two streams never meet. A name of the caller's is noted in the
    folder with the id of the checkpoint that uses it; another checkpoint under that name would start at batch 0 again and
    overwrite rows that are there, so it is an error.
    """
    own = query_id(spark, checkpoint)
    if stream is None:
        return f"stream-{own}"
    note = f"{folder}/_streams/{stream}"
    if path_exists(spark, note):
        other = spark.read.text(note).first()[0]
        if other != own:
            raise ValueError(f"batches named {stream} in {folder} belong to another checkpoint; choose another name")
    else:
        spark.createDataFrame([(own,)], "value string").coalesce(1).write.text(note)
    return stream


def land_arriving(
    stream: DataFrame,
    root: str,
    table: str,
    checkpoint: str,
    load_time: str,
    *,
    schema: str = "staging",
    name: str | None = None,
    text: bool = True,
    once: bool = False,
    late: tuple[str, str] | None = None,
) -> StreamingQuery:
    """Land everything not landed before, then stop; the checkpoint takes the place of a mark table.

    Each micro-batch is one bronze batch in its own folder, named after the stream (``name``, or the id in its
    checkpoint) and the micro-batch's number. A micro-batch that runs again after a failure replaces that folder, so rows
    land exactly once, and several streams can land into one table.

    With ``once`` a row whose record hash was landed before, by any stream, is left out. Copies within a micro-batch are
    combined in every task before the shuffle, however many there are of one row; the rest is compared with an index
    of landed hashes, laid out by the first digits of the hash, of which only the parts that arrive are read.

    ``late`` names a time column and a delay, such as ``("ts", "7 days")``: rows older than the newest row of earlier
    micro-batches less the delay land in ``late_<table>`` instead. No row is dropped for being late.
    """
    target = f"br_{table}"

    def land(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        batch_id = f"{claim(spark, layer_path(root, schema, target), checkpoint, name)}-{epoch}"
        stamped = stamp_batch(rows, table, batch_id, load_time, text=text)
        if once:
            stamped = _new_rows(spark, stamped, f"{root}/hashes/{schema}/{target}", batch_id)
        if late:
            marks = f"{root}/marks/{schema}/{target}"
            arrived = F.col(late[0]).cast("timestamp_ntz")
            mark = _mark(spark, marks, batch_id)
            behind = F.coalesce(arrived < F.lit(mark) - F.expr(f"INTERVAL {late[1]}"), F.lit(False)) if mark else F.lit(False)
            stamped = written(stamped.withColumn("_late", behind), "micro-batch")
            write_batch(stamped.where("_late").drop("_late"), root, schema, f"late_{table}", batch_id)
            stamped = stamped.where("NOT _late").drop("_late")
            stamped.agg(F.max(arrived).alias("mark")).coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")
        write_batch(stamped, root, schema, target, batch_id)

    return (
        stream.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _new_rows(spark: SparkSession, stamped: DataFrame, index: str, batch_id: str) -> DataFrame:
    """One row per record hash that no other batch has landed; the hashes of this batch are added to the index."""
    fresh = stamped.dropDuplicates(["br_record_hash"]).withColumn("prefix", F.substring("br_record_hash", 1, PREFIX))
    fresh = written(fresh, "micro-batch")
    if path_exists(spark, index):
        parts = [r.prefix for r in fresh.select("prefix").distinct().collect()]  # at most 16 ** PREFIX
        landed = spark.read.schema("br_record_hash string, batch_id string, prefix string").parquet(index)
        landed = landed.where(F.col("prefix").isin(parts) & (F.col("batch_id") != batch_id)).select("br_record_hash")
        fresh = fresh.join(landed, "br_record_hash", "left_anti")
    fresh = written(fresh.select(*stamped.columns, "prefix"), "new-rows")
    balanced(fresh.select("br_record_hash", "prefix"), ["prefix"]).write.mode("overwrite").partitionBy("prefix").parquet(f"{index}/batch_id={batch_id}")
    return fresh.drop("prefix")


def _mark(spark: SparkSession, marks: str, batch_id: str):
    """The newest time that other batches have landed; one small row per batch."""
    if not path_exists(spark, marks):
        return None
    kept = spark.read.schema("mark timestamp_ntz, batch_id string").parquet(marks)
    return kept.where(F.col("batch_id") != batch_id).agg(F.max("mark")).first()[0]


def without_repeats(
    stream: DataFrame, time: str, delay: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Drop rows whose record hash was seen before, for repeats that arrive within ``delay`` of each other.

    Copies of one row meet in one task; where a row may have very many copies, land with ``once`` instead.

    The state kept per row is its hash until the watermark passes it. Rows behind the watermark are not passed on;
    where they may exist, land with ``once`` (nothing is late) or with ``late`` (late rows go to a table of their own).
    A watermark needs a zoned timestamp, so a zone-less one is read in the session's zone.
    """
    hashed = stream.withColumns(
        {
            "br_record_hash": record_hash(
                list(columns or business_columns(stream)), plain_columns(stream), nested_columns(stream)
            ),
            "_time": F.col(time).cast("timestamp"),
        }
    )
    return hashed.withWatermark("_time", delay).dropDuplicatesWithinWatermark(["br_record_hash"]).drop("_time")


def append_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to parquet files with the file sink's exactly-once log, then stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
