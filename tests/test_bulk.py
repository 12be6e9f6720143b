"""Loads that fail keep their chunks and go on."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orelayer.sources import bulk


def rows(spark):
    return spark.range(2000).select("id", F.concat(F.lit("row "), "id").alias("text"), F.expr("CAST(id / 3 AS DECIMAL(12,4))").alias("amount"))


def good():
    """Does not hold for a row that comes late in its partition."""
    return F.col("id") != 1950


def test_a_failed_load_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}/load"
    args = {"keys": ["id"], "partitions": 4, "commit_every": 50}
    with pytest.raises(Exception, match="refused"):
        bulk.bulk_load(rows(spark), path, **args, must_hold=good())
    chunks = {f: os.stat(f"{tmp_path}/load/chunks/{f}").st_mtime_ns for f in os.listdir(f"{tmp_path}/load/chunks")}
    assert 0 < len(chunks) and bulk.ledger(path) is None
    early = bulk.loaded(spark, path, rows(spark).schema)
    assert 0 < early.count() < 2000 and early.distinct().count() == early.count()

    told = bulk.bulk_load(rows(spark), path, **args)
    assert told["rows"] == 2000 and told["found"] == len(chunks) < len(told["chunks"])
    assert all(os.stat(f"{tmp_path}/load/chunks/{f}").st_mtime_ns == t for f, t in chunks.items())
    assert max(told["chunks"].values()) == 50
    whole = bulk.loaded(spark, path, rows(spark).schema)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, rows(spark).collect()))
    assert bulk.bulk_load(rows(spark), path, **args, must_hold=good()) == told  # finished: nothing runs


def test_a_changed_source_or_layout_is_an_error(spark, tmp_path):
    path = f"file://{tmp_path}/load"
    with pytest.raises(Exception, match="refused"):
        bulk.bulk_load(rows(spark), path, ["id"], partitions=2, commit_every=100, must_hold=good())
    with pytest.raises(ValueError, match="began with"):
        bulk.bulk_load(rows(spark), path, ["id"], partitions=3, commit_every=100)
    with pytest.raises(Exception, match="changed since"):
        bulk.bulk_load(rows(spark).where("id < 300"), path, ["id"], partitions=2, commit_every=100)


def test_an_empty_load(spark, tmp_path):
    path = f"file://{tmp_path}/load"
    assert bulk.bulk_load(rows(spark).limit(0), path, ["id"], partitions=2)["rows"] == 0


def test_all_whole_chunks_before_a_refused_row_stay(spark, tmp_path):
    path = f"file://{tmp_path}/load"
    for must_hold in (good(), F.when(good(), True)):  # a condition that is null does not hold either
        with pytest.raises(Exception, match="refused: .*1950"):
            bulk.bulk_load(rows(spark), path, ["id"], partitions=1, commit_every=50, must_hold=must_hold)
        assert len(os.listdir(f"{tmp_path}/load/chunks")) == 39
    assert bulk.loaded(spark, path, rows(spark).schema).agg(F.max("id")).first()[0] == 1949
