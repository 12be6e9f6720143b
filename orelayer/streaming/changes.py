"""Change capture: history rows from a stream of row states."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from orelayer.functions.columns import clock, nested_columns, record_hash, stable_uuid
from orelayer.functions.skew import busy_keys, latest_per_key
from orelayer.operators.history import history_from_changes
from orelayer.session import written
from orelayer.sources.sinks import balanced, layer_path, write_batch
from orelayer.streaming.landing import claim

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
# A store for every partition reserves some megabytes of disk for its logs, whatever it holds; without this it takes what it writes.
RESERVES = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"


class ChangeFilter(StatefulProcessor):
    """Passes on the rows of a key whose state hash differs from that of the row before.

    Kept per key: the hash last seen, 32 characters. The first row of a key is an INSERT, later ones UPDATE.
    """

    def __init__(self, order: Sequence[str]):
        self.order = list(order)

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("hash", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        known = self.last.get() if self.last.exists() else None
        before = batch["state_hash"].shift()
        if known is not None:
            before.iloc[0] = known[0]
        batch["operation_type"] = before.isna().map({True: "INSERT", False: "UPDATE"})
        self.last.update((batch["state_hash"].iloc[-1],))
        yield batch[batch["state_hash"] != before]

    def close(self) -> None:
        pass


def history_stream(
    changes: DataFrame, keys: Sequence[str], tracked: Sequence[str], order: Sequence[str], systime: str
) -> DataFrame:
    """History rows of a stream, from the last state kept per key (RocksDB state store).

    Within a micro-batch the rows of a key are applied in ``order``; across micro-batches in order of
    arrival. The rows of one key in one micro-batch meet in one task, so bound the micro-batch at the
    source, or use :func:`capture_batches`, which cuts such a key. Hashes and history columns are computed by
    Spark; tracked values pass through with the types they have. (Names with a leading underscore do not
    survive the trip into a stateful processor.)
    """
    nested = [c for c in nested_columns(changes) if c in tracked]
    rows = changes.select(
        *keys,
        *order,
        *[F.col(c).alias(f"value_{c}") for c in tracked],
        record_hash(tracked, nested=nested).alias("state_hash"),
    )
    out = StructType(list(rows.schema.fields) + [StructField("operation_type", StringType())])
    kept = rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=ChangeFilter(order), outputStructType=out, outputMode="append", timeMode="none"
    )
    return kept.select(
        *keys,
        *[F.col(f"value_{c}").alias(c) for c in tracked],
        stable_uuid(*keys, order[-1], "operation_type").alias("history_id"),
        F.col(order[0]).alias("effective_time"),
        clock(systime).alias("systime"),
        "operation_type",
    )


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Stateful processors need the RocksDB store, here without space reserved ahead; put the session's own choice back afterwards."""
    settings = {STATE_STORE: ROCKSDB, RESERVES: "false"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def capture_batches(
    changes: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    order: Sequence[str],
    root: str,
    table: str,
    checkpoint: str,
    systime: str,
    *,
    stream: str | None = None,
    buckets: int = 64,
) -> StreamingQuery:
    """As :func:`history_stream`, with every micro-batch run as a batch job on the JVM.

    The last state of each key is a table beside the history, in ``buckets`` of a hash of the key. A micro-batch
    reads and rewrites the buckets its keys fall into, under its own number, and notes where the newest version of
    every bucket is. That state is put before the micro-batch's rows, so a key that fills the micro-batch is cut into
    pieces like in any batch. Rows without a time count as the earliest of their micro-batch. ``stream`` names the
    batches as in :func:`orelayer.streaming.landing.land_arriving`.
    """
    columns = list(dict.fromkeys([*keys, *tracked, *order]))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")

    def capture(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        name = claim(spark, layer_path(root, "history", table), checkpoint, stream)
        state = f"{root}/state/{table}/{name}"
        rows = written(batch.select(*columns), "micro-batch").withColumn("bucket", bucket)
        touched = {r.bucket for r in rows.select("bucket").distinct().collect()}
        newest_of = _heads(spark, state, epoch - 1)
        paths = [f"{state}/epoch-{newest_of[b]}/bucket={b}" for b in sorted(touched) if b in newest_of]
        seen = spark.read.schema(batch.select(*columns).schema).parquet(*paths) if paths else rows.select(*columns).limit(0)
        carried = seen.join(rows.select(*keys).distinct(), list(keys), "left_semi").withColumn("_seen", F.lit(True))
        arrived = rows.select(*columns).withColumn("_seen", F.lit(False)).unionByName(carried)
        # Nulls sort first: rows already applied have no time here and come before those that arrived without one.
        applied = arrived.withColumns({"_at": F.when(~F.col("_seen"), F.col(order[0])), "_new": (~F.col("_seen")).cast("int")})
        history = history_from_changes(
            applied, keys, tracked, ["_at", "_new", *order], systime,
            carried=F.col("_seen"), busy=busy_keys(rows, keys, order[0]),
        )
        write_batch(history, root, "history", table, f"{name}-{epoch}")
        newest = latest_per_key(rows.select(*columns), keys, *[F.desc(c) for c in order])
        newest = newest.unionByName(seen.join(newest.select(*keys), list(keys), "left_anti"))
        balanced(newest.withColumn("bucket", bucket), ["bucket"]).write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/epoch-{epoch}")
        heads = {**newest_of, **{b: epoch for b in touched}}
        spark.createDataFrame(list(heads.items()), "bucket int, epoch bigint").coalesce(1).write.mode("overwrite").parquet(f"{state}/heads-{epoch}")

    return (
        changes.writeStream.foreachBatch(capture)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _heads(spark: SparkSession, state: str, epoch: int) -> dict[int, int]:
    """The micro-batch that wrote the newest version of each bucket; one small row per bucket."""
    if epoch < 0:
        return {}
    return {r.bucket: r.epoch for r in spark.read.schema("bucket int, epoch bigint").parquet(f"{state}/heads-{epoch}").collect()}
