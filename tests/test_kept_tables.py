"""Tables that are kept up to date: merges of key ranges, versions batch by batch, snapshots compared by digests."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orelayer.operators import history
from orelayer.operators.digests import DigestedSnapshots
from orelayer.operators.keyed import KeyedTable
from orelayer.operators.version_store import VersionStore

NOW = "2025-01-01 00:00:00"


def contents(df):
    return Counter(tuple(r) for r in df.collect())


def test_untouched_files_stay(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], rows_per_file=100)
    rows = spark.range(0, 2000, 2).selectExpr("id AS k", "'a' AS v")
    first = table.create(rows)
    names = {u.path for u in table.units()}
    assert first.rows == 1000 and len(names) == 10

    changed = table.merge(spark.createDataFrame([(100, "x"), (101, "new")], "k bigint, v string"))
    stayed = names & {u.path for u in table.units()}
    assert changed.kept == 9 and changed.rewritten == 1 and len(stayed) == 9 and changed.rows_read < 250

    # Odd keys are within the bounds of files whose filters do not know them: nothing is rewritten.
    inserted = table.merge(spark.createDataFrame([(5001, "far"), (777, "between")], "k bigint, v string"))
    assert inserted.rewritten == 0 and inserted.rows_read == 0 and inserted.added >= 1
    assert table.read().count() == 1003 and table.read(1).count() == 1000


def test_merges_equal_a_dictionary(spark, tmp_path):
    """Text keys, repeated and deleted keys, null keys, columns to be dropped; enough merges for files to be put together again."""
    rng = random.Random(2)
    table = KeyedTable(spark, str(tmp_path), ["a", "b"], rows_per_file=40, overlap=2)
    held = {(f"k{rng.randrange(90):02d}", i): "start" for i in range(120)}
    held[None, 1] = "null"
    table.create(spark.createDataFrame([(a, b, v) for (a, b), v in held.items()], "a string, b int, v string"))
    for step in range(4):
        some = rng.sample([k for k in held if k[0]], 6)
        rows = [(a, b, n, f"s{step}-{n}", n == 2 and i % 2 == 0) for i, (a, b) in enumerate(some) for n in (1, 2)]
        rows += [(f"k{rng.randrange(90):02d}", 1000 + 10 * step + i, 1, "new", False) for i in range(5)]
        for a, b, _, v, gone in sorted(rows, key=lambda r: r[2]):
            held.pop((a, b), None)
            if not gone:
                held[a, b] = v
        done = table.merge(spark.createDataFrame(rows, "a string, b int, n int, v string, gone boolean"), ["n"], F.col("gone"))
        assert done.rows == len(held)
    assert contents(table.read()) == Counter((a, b, v) for (a, b), v in held.items())


def test_a_merge_that_fails_leaves_the_table(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path), ["k"], rows_per_file=10)
    table.create(spark.range(30).selectExpr("id AS k", "0 AS v"))
    change = spark.createDataFrame([(3, 9), (40, 9)], "k bigint, v int")
    with monkeypatch.context() as broken:
        broken.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.merge(change)
    assert table.version() == 1 and contents(table.read()) == Counter((k, 0) for k in range(30))
    table.merge(change)
    assert contents(table.read()) == Counter([(k, 9 if k == 3 else 0) for k in range(30)] + [(40, 9)])


def test_lookup_and_empty_tables(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["k", "n"], indexed=["k"], rows_per_file=10)
    table.create(spark.range(0).selectExpr("id AS k", "id AS n", "'x' AS v"))
    asked = spark.createDataFrame([(3,), (3,), (99,)], "k int")
    assert table.read().count() == table.lookup(asked).count() == 0
    table.merge(spark.range(60).selectExpr("id % 20 AS k", "id AS n", "'x' AS v"))
    assert contents(table.lookup(asked)) == Counter((3, n, "x") for n in (3, 23, 43))
    with pytest.raises(ValueError, match="already"):
        table.create(table.read())


EVENTS = "user_id bigint, ts timestamp_ntz, event_id bigint, event_type string"


def test_versions_of_any_split(spark, tmp_path):
    """Shuffled events with ties in time, one batch given twice, against the versions of all events."""
    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    rows = [(rng.randrange(7), start + timedelta(hours=rng.randrange(25)), i, rng.choice("abc")) for i in range(140)]
    args = ["user_id"], ["event_type"], ["ts", "event_id"]
    want = history.versions(history.history_from_changes(spark.createDataFrame(rows, EVENTS), *args, NOW), ["user_id"])
    store = VersionStore(spark, str(tmp_path), *args, NOW, rows_per_file=25)
    rng.shuffle(rows)
    for batch in (rows[:60], rows[40:70], rows[70:]):
        store.apply(spark.createDataFrame(batch, EVENTS))
    assert contents(store.read().select(want.columns)) == contents(want)
    with pytest.raises(ValueError, match="without key or time"):
        store.apply(spark.createDataFrame([(1, None, 1, "a")], EVENTS))


def snapshots(spark, tmp_path, **layout):
    return DigestedSnapshots(spark, str(tmp_path), ["k"], **layout)


def test_digests_find_every_kind_of_change(spark, tmp_path):
    old = [(i, None if i % 7 == 0 else f"v{i}", i / 3, [str(i), None]) for i in range(400)]
    new = [(i, v, x, a) for i, v, x, a in old if i not in (5, 80)]
    new[10] = (*new[10][:1], "changed", *new[10][2:])
    new[200] = (*new[200][:3], [None, str(new[200][0])])
    new += [(1000, "new", 1.0, None)]
    kind = "k bigint, v string, x double, a array<string>"
    frames = [spark.createDataFrame(r, kind).repartition(3) for r in (old, new)]
    store = snapshots(spark, tmp_path, rows_per_range=10)
    assert [store.write(f, n) for f, n in zip(frames, ("old", "new"))] == [400, 399]
    got = store.diff("old", "new", NOW)
    assert contents(got.drop("a")) == contents(history.snapshot_diff(*frames, ["k"], "new", NOW).drop("a"))
    assert Counter(r.operation_type for r in got.collect()) == {"DELETE": 2, "UPDATE": 2, "INSERT": 1}
    nodes, level, told = store.compare("old", "new")
    assert level == 2 and len(nodes) <= 5 and told.rows_read < 60 and told.rows == 799 and told.looked_at[0] == 1
    assert contents(store.read("old").drop("a")) == contents(frames[0].drop("a"))


def test_trees_of_different_depth_and_empty_snapshots(spark, tmp_path):
    small, large = spark.range(30).selectExpr("id AS k", "1 AS v"), spark.range(3000).selectExpr("id AS k", "if(id = 4, 2, 1) AS v")
    store = snapshots(spark, tmp_path, rows_per_range=40)
    for name, df in (("none", small.limit(0)), ("small", small), ("large", large), ("again", large.orderBy(F.desc("k")))):
        store.write(df, name)
    for old, new, left, right in (("small", "large", small, large), ("none", "small", small.limit(0), small), ("large", "none", large, small.limit(0))):
        assert contents(store.diff(old, new, NOW)) == contents(history.snapshot_diff(left, right, ["k"], new, NOW))
    assert store.compare("large", "again")[0] == [] and store.diff("large", "again", NOW).count() == 0


def test_small_ranges_share_folders(spark, tmp_path, monkeypatch):
    """Folders follow the size of the table, not that of a range; ranges that differ are found in them, named or joined."""
    old = spark.range(3000).selectExpr("id AS k", "id % 5 AS v")
    store = snapshots(spark, tmp_path, rows_per_range=2)
    for folder_rows, named in ((1_000_000, 100), (400, 0)):
        monkeypatch.setattr("orelayer.operators.digests.ROWS_PER_FOLDER", folder_rows)
        monkeypatch.setattr("orelayer.operators.digests.NAMED_RANGES", named)
        store.write(old, "old")
        for name, changed in (("few", F.col("k") < 3), ("many", F.col("k") % 3 == 0)):
            new = old.withColumn("v", F.when(changed, F.col("v") + 1).otherwise(F.col("v")))
            store.write(new, name)
            assert len(list((tmp_path / name / "rows").glob("*=*"))) <= 16
            assert contents(store.diff("old", name, NOW)) == contents(history.snapshot_diff(old, new, ["k"], name, NOW))
