"""Landing without repeats, however late they come, with state of a fixed size.

:func:`orelayer.streaming.landing.without_repeats` keeps a hash per row and leaves out what is behind the watermark. Here every range of
record hashes keeps a few Bloom filters that rotate: when one is full a new one begins, and of too many the one of the oldest rows is
forgotten, with the newest event time it held noted. A row that no filter knows and that is newer than all that was forgotten is
surely new, as a repeat has its event time too. Only the other rows are looked up in the index of landed hashes, of which only
their ranges are read. So no row is lost or doubled, and what a false positive or a forgotten filter costs is a lookup.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from orelayer.functions.columns import business_columns, nested_columns, plain_columns, record_hash
from orelayer.session import path_exists, written
from orelayer.sources.sinks import balanced, layer_path, write_batch
from orelayer.streaming.corrections import JSON
from orelayer.streaming.landing import claim

# Bits of a filter for each row it takes, and bits a row sets: about three false positives in a thousand.
ROW_BITS, PROBES = 12, 8
# First digits of a record hash that make a range.
DIGITS = 2
INDEX = "br_record_hash string, batch_id string, range string"
# Distinct rows a task remembers while it leaves out copies before the shuffle.
REMEMBERED = 100_000
NO_TIME = -(1 << 63)


def filter_bytes(capacity: int, generations: int) -> int:
    """The most that filters of all ranges take together."""
    return 16**DIGITS * (generations + 1) * -(-capacity * ROW_BITS // 8)


def probes(hashes: list[str], bits: int) -> np.ndarray:
    """The bits of each record hash, by two halves of it."""
    first = np.array([int(h[DIGITS : DIGITS + 15], 16) for h in hashes], np.uint64)
    step = np.array([int(h[-15:], 16) | 1 for h in hashes], np.uint64)
    return ((first[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


class SeenRows(StatefulProcessor):
    """Marks the rows of a range of hashes that may have been seen: ``maybe``. Copies within a micro-batch are left out."""

    def __init__(self, capacity: int, generations: int):
        self.capacity, self.generations, self.bits = capacity, generations, capacity * ROW_BITS

    def init(self, handle) -> None:
        self.filters = handle.getListState("filters", "bits binary, rows bigint, newest bigint")
        self.forgotten = handle.getValueState("forgotten", "newest bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        filters = [[np.unpackbits(np.frombuffer(b, np.uint8), count=self.bits).astype(bool), n, t] for b, n, t in self.filters.get()]
        forgotten = self.forgotten.get()[0] if self.forgotten.exists() else None
        met: set[str] = set()
        for frame in rows:
            frame = frame.drop_duplicates("br_record_hash")
            frame = frame[~frame["br_record_hash"].isin(met)]
            met |= set(frame["br_record_hash"])
            maybe = np.zeros(len(frame), bool)
            for low in range(0, len(frame), self.capacity):
                part = frame.iloc[low : low + self.capacity]
                at, times = probes(part["br_record_hash"].tolist(), self.bits), part["at"].to_numpy(np.int64)
                known = np.zeros(len(part), bool)
                for held, _, _ in filters:
                    known |= held[at].all(axis=1)
                maybe[low : low + len(part)] = known if forgotten is None else known | (times <= forgotten)
                if not filters or filters[-1][1] + len(part) > self.capacity:
                    filters.append([np.zeros(self.bits, bool), 0, NO_TIME])
                filters[-1][0][at[~known].ravel()] = True
                filters[-1][1] += int((~known).sum())
                # What a filter knows by chance would be forgotten with that filter: the newest time is noted in both.
                for held in filters if known.any() else filters[-1:]:
                    held[2] = max(held[2], int(times.max(initial=NO_TIME)))
                while len(filters) > self.generations:
                    oldest = min(filters[:-1], key=lambda f: f[2])
                    filters = [f for f in filters if f is not oldest]
                    forgotten = oldest[2] if forgotten is None else max(forgotten, oldest[2])
            yield frame.assign(maybe=maybe)[["br_record_hash", "body", "maybe"]]
        self.filters.put([(np.packbits(b).tobytes(), n, t) for b, n, t in filters])
        if forgotten is not None:
            self.forgotten.update((forgotten,))

    def close(self) -> None:
        pass


def _without_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task whose hash it has not just met."""
    met: set[str] = set()
    for batch in batches:
        hashes = batch.column("br_record_hash").to_pylist()
        keep = [not (h in met or met.add(h)) for h in hashes]
        yield batch.filter(pa.array(keep, pa.bool_()))
        if len(met) > REMEMBERED:
            met.clear()


def land_unique(
    stream: DataFrame,
    root: str,
    table: str,
    checkpoint: str,
    time: str,
    *,
    schema: str = "staging",
    name: str | None = None,
    capacity: int = 1_000_000,
    generations: int = 8,
) -> StreamingQuery:
    """Land every row once, with its ``br_record_hash``; ``time`` is the event time that a row and its repeats share.

    Landed hashes and a report per micro-batch (rows surely new, looked up, and found to be repeats) lie under ``hashes`` and
    ``reports``. ``name`` is as in :func:`orelayer.streaming.landing.land_arriving`.
    """
    target, columns = f"br_{table}", business_columns(stream)
    rows = stream.select(
        record_hash(columns, plain_columns(stream), nested_columns(stream)).alias("br_record_hash"),
        F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(NO_TIME)).alias("at"),
        F.to_json(F.struct(*columns), JSON).alias("body"),
    )
    kinds = StructType([stream.schema[c] for c in columns])
    few = rows.mapInArrow(_without_copies, rows.schema).withColumn("range", F.substring("br_record_hash", 1, DIGITS))
    told = few.groupBy("range").transformWithStateInPandas(
        statefulProcessor=SeenRows(capacity, generations), outputStructType="br_record_hash string, body string, maybe boolean", outputMode="append", timeMode="none"
    )
    index = f"{root}/hashes/{schema}/{target}"

    def land(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch_id = f"{claim(spark, layer_path(root, schema, target), checkpoint, name)}-{epoch}"
        arrived = written(batch.withColumn("range", F.substring("br_record_hash", 1, DIGITS)), "micro-batch")
        asked, new = arrived.where("maybe"), arrived.where("NOT maybe")
        if path_exists(spark, index):
            parts = [r.range for r in asked.select("range").distinct().collect()]  # at most 16 ** DIGITS
            landed = spark.read.schema(INDEX).parquet(index).where(F.col("range").isin(parts) & (F.col("batch_id") != batch_id))
            asked = asked.join(landed.select("br_record_hash"), "br_record_hash", "left_anti").select(*arrived.columns)
        fresh = written(new.unionByName(asked), "new-rows")
        balanced(fresh.select("br_record_hash", "range"), ["range"]).write.mode("overwrite").partitionBy("range").parquet(f"{index}/batch_id={batch_id}")
        whole = fresh.select(F.from_json("body", kinds, JSON).alias("row"), "br_record_hash").select("row.*", "br_record_hash")
        landed_rows = write_batch(whole, root, schema, target, batch_id)
        counts = arrived.agg(F.count_if(~F.col("maybe")).alias("new"), F.count_if("maybe").alias("looked_up"))
        counts = counts.withColumn("repeats", F.col("new") + F.col("looked_up") - F.lit(landed_rows))
        counts.write.mode("overwrite").parquet(f"{root}/reports/{schema}/{target}/batch_id={batch_id}")

    return told.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
