"""Repeats beyond any watermark: what the filters call new was never seen, and state stays small."""

import hashlib
import random

import pandas as pd
from pyspark.sql import functions as F

from orelayer.streaming import changes, landing, repeats


class Kept:
    def __init__(self):
        self.held, self.value = [], None

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return self

    def get(self):
        return iter(self.held)

    def put(self, rows):
        self.held = list(rows)


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def test_new_rows_were_never_seen_and_filters_rotate():
    for seed in range(15):
        rng = random.Random(seed)
        processor, kept, value = repeats.SeenRows(capacity=16, generations=3), Kept(), Value()
        processor.filters, processor.capacity, processor.forgotten = kept, 16, value
        rows = [(hashlib.md5(str(i).encode()).hexdigest(), rng.randrange(1000), f"{i}") for i in range(300)]
        seen, sure = set(), 0
        for _ in range(40):
            batch = [rng.choice(rows) for _ in range(20)]
            frame = pd.DataFrame(batch, columns=["br_record_hash", "at", "body"])
            for out in processor.handleInputRows((0,), iter([frame.iloc[:12], frame.iloc[12:]]), None):
                for r in out.itertuples():
                    assert r.maybe or r.br_record_hash not in seen
                    sure += not r.maybe
                    seen.add(r.br_record_hash)
            assert {h for h, *_ in batch} <= seen  # no row is left out
            assert len(kept.held) <= 3 and sum(len(b) for b, *_ in kept.held) <= repeats.filter_bytes(16, 3) // 256
        assert value.held is not None and sure > 30


def test_rows_land_once_whatever_comes_when(spark, tmp_path):
    """Null times, copies within a micro-batch, and repeats in a later stream run; the report adds up."""
    rows = [(i % 150, None if i % 11 == 0 else f"2024-01-{1 + i % 28:02d} 00:00:00.123456", [str(i % 150), None]) for i in range(400)]
    rows = [r for i, r in enumerate(rows) if rows.index(r) == i]
    df = spark.createDataFrame(rows, "id int, ts string, tags array<string>").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.unionByName(df).repartition(2).write.parquet(f"{tmp_path}/in")
    for run in range(2):
        with changes.rocksdb_state(spark):
            arriving = landing.read_arriving(spark, f"{tmp_path}/in", df.schema, files_per_batch=1)
            repeats.land_unique(arriving, str(tmp_path), "t", f"{tmp_path}/checkpoint", "ts", capacity=4, generations=2).awaitTermination()
        if not run:
            df.repartition(1).write.mode("append").parquet(f"{tmp_path}/in")
    landed = spark.read.parquet(f"{tmp_path}/staging/br_t")
    assert sorted(map(str, landed.select("id", "ts", "tags").collect())) == sorted(map(str, df.collect()))
    told = spark.read.parquet(f"{tmp_path}/reports/staging/br_t").agg(F.sum("new"), F.sum("looked_up"), F.sum("repeats")).first()
    assert told[0] + told[1] - told[2] == len(rows) and told[2] >= len(rows)
