"""Streams over several files against their batch twins."""

import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orelayer.operators.history import history_from_changes
from orelayer.streaming import changes, landing

NOW = "2025-01-01 00:00:00"
SCHEMA = "user bigint, state string, score int, at timestamp_ntz, id bigint"
START = datetime(2024, 1, 1)


@pytest.fixture
def arriving(spark, tmp_path):
    """Three files of events in order of time; nulls, repeats and one busy user."""
    data = [
        (i % 5 if i % 3 else 0, ["a", "a", "b", None][(i // 2) % 4], None if i % 7 == 0 else i // 10, START + timedelta(minutes=i), i)
        for i in range(300)
    ]
    folder = tmp_path / "in"
    for n in range(3):
        part = spark.createDataFrame(data[n * 100 : (n + 1) * 100], SCHEMA).coalesce(1)
        part.write.parquet(str(tmp_path / f"part{n}"))
        folder.mkdir(exist_ok=True)
        source = next((tmp_path / f"part{n}").glob("*.parquet"))
        shutil.copy(source, folder / f"{n}.parquet")
    return spark.createDataFrame(data, SCHEMA), str(folder)


def stream(spark, folder, per_batch=1):
    schema = spark.createDataFrame([], SCHEMA).schema
    return landing.read_arriving(spark, folder, schema, only="*.parquet", files_per_batch=per_batch)


def same(a, b):
    columns = sorted(a.columns)
    return sorted(a.select(columns).collect(), key=str) == sorted(b.select(columns).collect(), key=str)


@pytest.mark.parametrize("per_batch", [1, 10])
def test_history_stream_equals_batch(spark, arriving, tmp_path, per_batch):
    rows, folder = arriving
    expected = history_from_changes(rows, ["user"], ["state", "score"], ["at", "id"], NOW)
    with changes.rocksdb_state(spark):
        out = changes.history_stream(stream(spark, folder, per_batch), ["user"], ["state", "score"], ["at", "id"], NOW)
        landing.append_files(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out"))
    assert got.schema.simpleString() == expected.schema.simpleString()
    assert same(got, expected)


@pytest.mark.parametrize("per_batch", [1, 10])
def test_capture_in_batches_equals_batch(spark, arriving, tmp_path, per_batch):
    rows, folder = arriving
    expected = history_from_changes(rows, ["user"], ["state", "score"], ["at", "id"], NOW)
    changes.capture_batches(
        stream(spark, folder, per_batch), ["user"], ["state", "score"], ["at", "id"], str(tmp_path), "users", str(tmp_path / "ck"), NOW
    ).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "history/users")).drop("batch_id")
    assert same(got, expected)


def test_landing_takes_only_new_files(spark, arriving, tmp_path):
    _, folder = arriving
    root, check = str(tmp_path / "root"), str(tmp_path / "ck")
    for _ in range(2):
        landing.land_arriving(stream(spark, folder), root, "events", check, NOW, name="stream", text=False).awaitTermination()
    landed = spark.read.parquet(f"{root}/staging/br_events")
    assert landed.count() == 300
    assert {r.br_batch_id for r in landed.select("br_batch_id").distinct().collect()} == {"stream-0", "stream-1", "stream-2"}
    spark.createDataFrame([(9, "z", 1, START, 999)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    landing.land_arriving(stream(spark, folder), root, "events", check, NOW, name="stream", text=False).awaitTermination()
    assert spark.read.parquet(f"{root}/staging/br_events").count() == 301


@pytest.mark.parametrize("per_batch", [1, 10])
def test_landing_once(spark, arriving, tmp_path, per_batch):
    rows, folder = arriving
    copies = rows.where("id < 3").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).select(rows.columns)
    copies.unionByName(rows.limit(50)).repartition(3).write.mode("append").parquet(folder)
    query = landing.land_arriving(
        stream(spark, folder, per_batch), str(tmp_path), "events", str(tmp_path / "ck"), NOW, text=False, once=True
    )
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/staging/br_events")
    assert got.count() == 300 and same(got.select(rows.columns), rows)


def test_repeats_land_once(spark, arriving, tmp_path):
    rows, folder = arriving
    rows.limit(50).coalesce(1).write.mode("append").parquet(folder)
    unique = landing.without_repeats(stream(spark, folder, 10), "at", "1 day")
    landing.append_files(unique, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.schema(unique.schema).parquet(str(tmp_path / "out"))
    assert got.count() == 300 and got.select(F.count_distinct("br_record_hash")).first()[0] == 300


def test_state_store_setting_is_put_back(spark):
    before = spark.conf.get(changes.STATE_STORE)
    with changes.rocksdb_state(spark):
        assert spark.conf.get(changes.STATE_STORE) == changes.ROCKSDB
    assert spark.conf.get(changes.STATE_STORE) == before


def test_two_checkpoints_land_into_one_table(spark, arriving, tmp_path):
    rows, folder = arriving
    root, other = str(tmp_path / "root"), str(tmp_path / "other")
    spark.createDataFrame([(9, "z", 1, START, 999)], SCHEMA).coalesce(1).write.parquet(other)
    landing.land_arriving(stream(spark, folder), root, "events", str(tmp_path / "ck"), NOW, text=False).awaitTermination()
    landing.land_arriving(stream(spark, other), root, "events", str(tmp_path / "ck2"), NOW, text=False).awaitTermination()
    assert spark.read.parquet(f"{root}/staging/br_events").count() == 301
    # The same name with another checkpoint would overwrite; it is refused.
    landing.land_arriving(stream(spark, folder), root, "named", str(tmp_path / "ck3"), NOW, name="s", text=False).awaitTermination()
    with pytest.raises(Exception, match="belong to another checkpoint"):
        landing.land_arriving(stream(spark, other), root, "named", str(tmp_path / "ck4"), NOW, name="s", text=False).awaitTermination()
    assert spark.read.parquet(f"{root}/staging/br_named").count() == 300


def test_copies_of_two_streams_land_once(spark, arriving, tmp_path):
    rows, folder = arriving
    root = str(tmp_path / "root")
    for check in ("ck", "ck2"):
        landing.land_arriving(
            stream(spark, folder), root, "events", str(tmp_path / check), NOW, text=False, once=True
        ).awaitTermination()
    assert spark.read.parquet(f"{root}/staging/br_events").count() == 300


def test_late_rows_land_beside(spark, arriving, tmp_path):
    rows, folder = arriving
    root, check = str(tmp_path / "root"), str(tmp_path / "ck")
    land = lambda: landing.land_arriving(
        stream(spark, folder), root, "events", check, NOW, text=False, late=("at", "1 hour")
    ).awaitTermination()
    land()
    late = [(1, "a", 1, START, 1001), (1, "b", 1, START + timedelta(minutes=250), 1002), (1, "c", 1, None, 1003)]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    land()
    assert spark.read.parquet(f"{root}/staging/br_events").count() == 302
    assert [r.id for r in spark.read.parquet(f"{root}/staging/late_events").collect()] == [1001]


def test_rows_without_a_time_are_kept_in_history(spark, tmp_path):
    """Two micro-batches with null times: they come first in their micro-batch and none is lost."""
    first = [(1, "a", 1, None, 1), (1, "b", 1, START, 2), (2, "a", 1, None, 3)]
    second = [(1, "c", 1, None, 4), (1, "b", 1, START + timedelta(days=1), 5), (2, "a", 1, None, 6), (3, "x", 1, None, 7)]
    folder = str(tmp_path / "in")
    root, check = str(tmp_path / "root"), str(tmp_path / "ck")
    for rows in (first, second):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        changes.capture_batches(
            stream(spark, folder), ["user"], ["state", "score"], ["at", "id"], root, "users", check, NOW
        ).awaitTermination()
    got = spark.read.parquet(f"{root}/history/users").drop("batch_id")
    found = sorted(((r.user, r.state, str(r.effective_time), r.operation_type) for r in got.collect()), key=str)
    at = lambda d: str(START + timedelta(days=d))
    assert found == sorted(
        [
            (1, "a", "None", "INSERT"), (1, "b", at(0), "UPDATE"), (2, "a", "None", "INSERT"),
            (1, "c", "None", "UPDATE"), (1, "b", at(1), "UPDATE"), (3, "x", "None", "INSERT"),
        ],
        key=str,
    )


def test_nested_values_keep_their_types(spark, tmp_path):
    schema = "user bigint, tags array<string>, at timestamp_ntz, id bigint"
    rows = [(1, ["a, b"], START, 1), (1, ["a", "b"], START + timedelta(1), 2), (1, ["a", "b"], START + timedelta(2), 3), (1, [None], START + timedelta(3), 4), (1, ["null"], START + timedelta(4), 5)]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    arriving = landing.read_arriving(spark, str(tmp_path / "in"), df.schema)
    with changes.rocksdb_state(spark):
        out = changes.history_stream(arriving, ["user"], ["tags"], ["at", "id"], NOW)
        landing.append_files(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).orderBy("effective_time").collect()
    assert [r.tags for r in got] == [["a, b"], ["a", "b"], [None], ["null"]]


def test_state_stores_reserve_no_disk(spark):
    """Stores for many partitions would reserve megabytes each; the session's own choice comes back afterwards."""
    reserves = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
    before = spark.conf.get(reserves, None)
    spark.conf.set(reserves, "true")
    try:
        with changes.rocksdb_state(spark):
            assert spark.conf.get(reserves) == "false"
        assert spark.conf.get(reserves) == "true"
    finally:
        spark.conf.unset(reserves) if before is None else spark.conf.set(reserves, before)
