"""Corrected history: any order of arrival ends in the history of the ordered run."""

import random
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from orelayer.operators import history
from orelayer.streaming import changes, corrections, landing

NOW = "2025-01-01 00:00:00"
KINDS = "user_id bigint, ts timestamp_ntz, event_id bigint, state string, amount decimal(9,2)"


class Kept:
    """List state and timers as the processor sees them."""

    def __init__(self):
        self.held, self.timers = [], set()

    def getListState(self, name, schema):
        return self

    def get(self):
        return iter(self.held)

    def put(self, rows):
        self.held = list(rows)

    def registerTimer(self, at):
        self.timers.add(at)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def plain_history(rows):
    """(at, seq, operation, shown) of rows in order."""
    found, known = set(), None
    for at, seq, state, body, gone in sorted(rows):
        if gone:
            if known:
                found.add((at, seq, "DELETE", known[1]))
            known = None
        elif known is None or known[0] != state:
            found.add((at, seq, "INSERT" if known is None else "UPDATE", body))
            known = (state, body)
        else:
            known = (state, body)
    return found


def give(processor, rows):
    frame = pd.DataFrame(rows, columns=corrections.FIELDS)
    return [tuple(r)[1:] for f in processor.handleInputRows((1,), iter([frame]), None) for r in f.itertuples(index=False)]


def feed(rng, count, first=0):
    rows = [(rng.randrange(first, first + 30) * 1000, i + first * 1000, rng.choice("ab"), f"{i}", rng.random() < 0.2) for i in range(count)]
    rng.shuffle(rows)
    return rows


def test_rows_that_stand_are_the_ordered_history():
    for seed in range(30):
        rng = random.Random(seed)
        rows = feed(rng, 25)
        processor, stands = corrections.Corrections("bigint", False), Counter()
        processor.init(Kept())
        for low in range(0, 25, 4):
            for at, seq, operation, body, sign in give(processor, [*rows[low : low + 4], rows[0]]):  # the first row arrives again and again
                stands[at, seq, operation, body] += sign
            assert +stands == Counter(plain_history(rows[: low + 4]))
            assert min(stands.values(), default=0) >= 0


def test_folded_rows_still_tell_the_state_before():
    """Rows the watermark passed become one; later rows come out as if all were still there."""
    for seed in range(20):
        rng = random.Random(seed)
        early, late = feed(rng, 20), feed(rng, 20, first=40)
        kept, stands = Kept(), Counter()
        processor = corrections.Corrections("bigint", True)
        processor.init(kept)
        for part in (early[:9], early[9:], late[:7]):
            for *row, sign in give(processor, part):
                stands[tuple(row)] += sign
        assert kept.timers
        assert list(processor.handleExpiredTimer((1,), Watermark(35), None)) == []
        assert len([r for r in kept.held if r[0] < 35_000]) == 1 and kept.held[0][7]
        for *row, sign in give(processor, late[7:]):
            stands[tuple(row)] += sign
        assert +stands == Counter(plain_history([*early, *late]))


def test_a_shuffled_stream(spark, tmp_path):
    """Every micro-batch spans all times; with a horizon that covers them, timers change nothing."""
    rng = random.Random(3)
    rows = [(rng.randrange(6), f"2024-01-{rng.randint(1, 9):02d} {rng.randrange(24):02d}:00:00", i, rng.choice(["a", "b", None]), f"{rng.randrange(3)}.50") for i in range(160)]
    rows = spark.createDataFrame(rows, "user_id bigint, ts string, event_id bigint, state string, amount string")
    events = rows.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "amount": F.col("amount").cast("decimal(9,2)")})
    events.repartition(3, "event_id").write.parquet(f"{tmp_path}/in")
    gone, args = F.col("amount") == 2.5, (["user_id"], ["state", "amount"], ["ts", "event_id"], NOW)
    want = history.history_from_changes(spark.read.parquet(f"{tmp_path}/in"), *args, deleted=gone)
    with changes.rocksdb_state(spark):
        arriving = landing.read_arriving(spark, f"{tmp_path}/in", events.schema, files_per_batch=1)
        got = corrections.corrected_history(arriving, *args, deleted=gone, horizon="30 days")
        landing.append_files(got, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    every = spark.read.schema(got.schema).parquet(f"{tmp_path}/out")
    assert every.where("sign = -1").count() > 0
    standing = corrections.standing(every).select(want.columns)
    assert Counter(map(tuple, standing.collect())) == Counter(map(tuple, want.collect()))


class Entries:
    """Map state as the processor sees it, with the calls it takes."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getMapState(self, name, key, value):
        return self

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value


def test_buckets_of_keys_stand_as_their_ordered_histories(monkeypatch):
    """A key costs a read and a write a micro-batch, however many rows it has; cut input and repeats change nothing."""
    rng = random.Random(5)
    feeds = {name: feed(rng, 40) for name in ("x", "y", "z")}
    kept, stands = Entries(), Counter()
    processor = corrections.BucketCorrections()
    processor.init(kept)
    for held in (1000, 7):
        monkeypatch.setattr(corrections, "HELD", held)
        for low in range(0, 40, 10):
            arrived = [(name, *row) for name, rows in feeds.items() for row in rows[low : low + 10]]
            rng.shuffle(arrived)
            frames = [pd.DataFrame(arrived[n : n + 5], columns=["name", *corrections.FIELDS]) for n in range(0, len(arrived), 5)]
            before = kept.calls
            for f in processor.handleInputRows((1,), iter(frames), None):
                for name, *row, sign in f.itertuples(index=False):
                    stands[name, *row] += sign
            assert held < 1000 or kept.calls - before <= 6
            if held == 1000:
                assert +stands == Counter((name, *r) for name, rows in feeds.items() for r in plain_history(rows[: low + 10]))
    assert +stands == Counter((name, *r) for name, rows in feeds.items() for r in plain_history(rows))


def test_a_shuffled_stream_by_buckets(spark, tmp_path):
    """Keys of two columns, one of them null; numbers beside an empty one keep their digits."""
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, (1 << 53) + 1]), rng.choice("pq"), f"2024-01-{rng.randint(1, 9):02d} 00:00:00", (1 << 53) + i, rng.choice("ab")) for i in range(120)]
    rows = spark.createDataFrame(rows, "user_id bigint, part string, ts string, event_id bigint, state string")
    events = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.repartition(3, "event_id").write.parquet(f"{tmp_path}/in")
    args = (["user_id", "part"], ["state"], ["ts", "event_id"], NOW)
    want = history.history_from_changes(spark.read.parquet(f"{tmp_path}/in"), *args)
    with changes.rocksdb_state(spark):
        arriving = landing.read_arriving(spark, f"{tmp_path}/in", events.schema, files_per_batch=1)
        got = corrections.corrected_history(arriving, *args, buckets=2)
        landing.append_files(got, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    standing = corrections.standing(spark.read.schema(got.schema).parquet(f"{tmp_path}/out")).select(want.columns)
    assert Counter(map(tuple, standing.collect())) == Counter(map(tuple, want.collect()))
