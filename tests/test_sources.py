"""Readers and writers: round trips, options, counts."""

import json
import re
from datetime import datetime
from pathlib import Path

import pytest

from orelayer.functions import columns as C
from orelayer.session import shared_dir, written
from orelayer.sources import readers, sinks

NOW = "2025-01-01 00:00:00"
TAKEN = datetime(2025, 1, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Alice", "2024-01-01"), (2, "Bob", "2024-06-01"), (3, None, None)]
    df = spark.createDataFrame(rows, "id int, name string, last_update string")
    return df.withColumn("last_update", df.last_update.cast("timestamp_ntz"))


def test_snapshot_round_trip(spark, people, tmp_path):
    stamped = C.stamp_source(people, "shop", "people", "db", load_time=NOW)
    paths = sinks.write_snapshot(stamped, str(tmp_path), "shop", "people", TAKEN)
    assert set(paths) == {"parquet", "json"}
    assert re.search(r"/shop/people/\d{8}_\d{6}\.parquet$", paths["parquet"])
    back = [spark.read.parquet(paths["parquet"]), readers.read_json(spark, paths["json"], stamped.schema)]
    for df in back:
        assert sorted(df.collect(), key=str) == sorted(stamped.collect(), key=str)
    line = next(l for f in Path(paths["json"]).glob("*.json") for l in f.read_text().splitlines())
    assert "name" in json.loads(line)
    with pytest.raises(ValueError, match="unknown formats"):
        sinks.write_snapshot(people, str(tmp_path), "shop", "people", TAKEN, ["xml"])


def test_json_array_file(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text(json.dumps([{"id": 1, "name": "Alice"}, {"id": 2, "name": "Bob"}]))
    assert readers.read_json(spark, str(path), "id int, name string", array_file=True).count() == 2


def test_partitioned_snapshot(spark, people, tmp_path):
    paths = sinks.write_snapshot(people, str(tmp_path), "shop", "people", TAKEN, ["parquet"], ["name"])
    assert (Path(paths["parquet"]) / "name=Alice").is_dir()
    assert spark.read.parquet(paths["parquet"]).count() == 3


def test_csv_round_trip(spark, people, tmp_path):
    assert sinks.write_csv(people, str(tmp_path / "csv")) == 3
    back = readers.read_csv(spark, str(tmp_path / "csv"), people.schema)
    assert sorted(back.collect(), key=str) == sorted(people.collect(), key=str)


def test_newest_snapshot(spark, people, tmp_path):
    for day, rows in ((1, people), (3, people.limit(1)), (2, people.limit(2))):
        sinks.write_snapshot(rows, str(tmp_path), "shop", "people", datetime(2025, 1, day), ["parquet"])
    assert readers.read_snapshots(spark, str(tmp_path), "shop", "people").count() == 6
    assert readers.read_latest_snapshot(spark, str(tmp_path), "shop", "people").count() == 1


def test_extract(people):
    assert readers.extract(people, "id > 1").count() == 2
    assert readers.extract(people, people.id > 1, 1).count() == 1
    assert readers.extract(people).count() == 3


def test_incremental_is_strict_and_skips_nulls(spark, people):
    rows = readers.extract_incremental(
        people, "last_update", "2024-01-01 00:00:00", source_system="s", source_table="people", source_host="h", load_time=NOW
    ).collect()
    assert [r.id for r in rows] == [2] and rows[0].bronze_extraction_method == "incremental"
    marks = readers.next_mark(people, "last_update", "people")
    assert readers.read_mark(marks, "people") == datetime(2024, 6, 1)
    assert readers.read_mark(marks, "other") is None


def test_filters_and_columns_reach_the_scan(spark, folder):
    orders = readers.table(spark, folder, "orders")
    plan = readers.extract(orders, "o_orderstatus = 'F'").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan


def test_scan_summary(spark):
    row = readers.scan_summary(spark.range(2500), "t").first()
    assert (row.row_count, row.sample_rows_read) == (2500, 1000)
    assert readers.scan_summary(spark.range(3), "t").first().sample_rows_read == 3


def test_jdbc_options():
    options = readers.jdbc_options("jdbc:x", "film", schema="public", partition_column="film_id", lower=1, upper=1000, partitions=8, user="u")
    assert options["dbtable"] == "public.film" and options["numPartitions"] == "8" and options["user"] == "u"
    assert "partitionColumn" not in readers.jdbc_options("jdbc:x", "film")
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "film", partition_column="film_id")
    write = sinks.jdbc_write_options("jdbc:x", "br_film", batch_size=500)
    assert write["dbtable"] == "staging.br_film" and write["batchsize"] == "500" and write["truncate"] == "true"
    assert "truncate" not in sinks.jdbc_write_options("jdbc:x", "t", replace=False)


def test_batch_replaces_only_itself(spark, people, tmp_path):
    root = str(tmp_path)
    assert sinks.write_batch(people, root, "staging", "br_people", "b1") == 3
    assert sinks.write_batch(people.limit(1), root, "staging", "br_people", "b2") == 1
    assert sinks.write_batch(people.limit(2), root, "staging", "br_people", "b1") == 2
    counts = spark.read.parquet(f"{root}/staging/br_people").groupBy("batch_id").count().collect()
    assert {(r[0], r[1]) for r in counts} == {("b1", 2), ("b2", 1)}


def test_empty_frame_through_every_sink(spark, people, tmp_path):
    empty = people.limit(0)
    assert sinks.write_batch(empty, str(tmp_path), "s", "t", "b") == 0
    assert sinks.write_csv(empty, str(tmp_path / "csv")) == 0
    paths = sinks.write_snapshot(empty, str(tmp_path), "shop", "people", TAKEN)
    assert readers.read_json(spark, paths["json"], people.schema).count() == 0


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    location = tmp_path_factory.mktemp("staging")
    spark.sql(f"CREATE SCHEMA staging_test LOCATION '{location}'")
    yield "staging_test"
    spark.sql("DROP SCHEMA staging_test CASCADE")


def test_replace_table(spark, people, catalog):
    name = f"{catalog}.br_people"
    assert sinks.replace_table(people, name) == 3
    assert sinks.replace_table(people.limit(0), name, on_empty="keep") == 0
    assert spark.table(name).count() == 3
    assert sinks.replace_table(people.limit(0), name) == 0
    assert spark.table(name).count() == 0
    with pytest.raises(ValueError):
        sinks.replace_table(people, name, on_empty="ignore")


def test_load_and_empty_tables(spark, people, catalog):
    assert sinks.load_tables({"a": people, "b": people.limit(1)}, catalog) == {"a": 3, "b": 1}
    sinks.empty_tables(spark, [f"{catalog}.a"])
    assert spark.table(f"{catalog}.a").count() == 0 and spark.table(f"{catalog}.b").count() == 1


def test_bucketed_tables_join_without_a_shuffle(spark, people, catalog):
    for name in ("old", "new"):
        sinks.materialise(people, catalog, name, bucket_by=["id"], buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = spark.table(f"{catalog}.old").join(spark.table(f"{catalog}.new"), "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_log(spark, tmp_path):
    summary = readers.scan_summary(spark.range(5), "t")
    for _ in range(2):
        sinks.append_log(sinks.log_entries(summary, "bronze", NOW, "run-1"), str(tmp_path / "log"))
    rows = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(rows) == 2 and rows[0].row_count == 5 and rows[0].status == "success"


def test_source_tables_of_a_spec(spark, folder):
    spec = {"warehouse": {"name": "w", "bronze_jobs": [{"table": "nation"}, {"table": "region"}]}}
    assert set(readers.source_tables(spark, spec, folder)) == {"nation", "region"}


def test_shared_dir_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = shared_dir(spark, "x")
    assert path != shared_dir(spark, "x")
    assert not base or path.startswith(base)


def test_written_cuts_the_plan(spark, people):
    df = written(people.where("id > 1"), "people")
    assert df.count() == 2 and df.columns == people.columns
    assert "Filter" not in df._jdf.queryExecution().analyzed().toString()
