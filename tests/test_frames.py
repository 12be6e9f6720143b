"""Filters, aggregates, stacking, merging."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orelayer.functions.columns import stamp_reference
from orelayer.operators import frames

NOW = "2025-01-01 00:00:00"


@pytest.fixture(scope="module")
def categories(spark):
    rows = [(1, 10.0, "A"), (2, 20.0, "B"), (3, 30.0, "A"), (4, 40.0, "C"), (5, 50.0, "B")]
    return spark.createDataFrame(rows, "id int, value double, category string")


def test_mean_and_sums_by_category(categories):
    means = {r.category: r.m for r in frames.mean_by(categories, "category", "value", "m").collect()}
    assert means == {"A": 20.0, "B": 35.0, "C": 40.0}
    sums = {r.category: (int(r.id), r.value) for r in frames.sums_by(categories, "category").collect()}
    assert sums == {"A": (4, 40.0), "B": (7, 70.0), "C": (4, 40.0)}


def test_whole_number_sums_do_not_overflow(spark):
    big = spark.createDataFrame([("a", 2**62), ("a", 2**62), ("a", 2**62)], "k string, n bigint")
    assert frames.sums_by(big, "k").first().n == 3 * 2**62


def test_top_by_breaks_ties_by_key(categories):
    tied = categories.withColumn("value", F.lit(1.0))
    assert [r.id for r in frames.top_by(tied, "value", "id", 2).collect()] == [1, 2]


def test_rollup_tells_subtotals_from_null_keys(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, None, 4)], "p string, q string, n int")
    rows = frames.rollup_by(df, ["p", "q"], total=F.sum("n")).collect()
    assert sorted((r.p, r.q, r.level, r.total) for r in rows if r.p == "a" and r.q is None) == [
        ("a", None, 0, 1),
        ("a", None, 1, 3),
    ]
    assert [r.total for r in rows if r.level == 3] == [7]


def test_soft_delete_keeps_the_first_date(spark):
    df = stamp_reference(spark.createDataFrame([(1,), (2,), (3,)], "id int"), NOW)
    once = frames.soft_delete(df, spark.createDataFrame([(1,), (1,)], "id int"), ["id"], "2025-02-01 00:00:00")
    twice = frames.soft_delete(once, spark.createDataFrame([(1,), (2,)], "id int"), ["id"], "2025-03-01 00:00:00")
    rows = {r.id: (r.inactivated_date, r.systime) for r in twice.collect()}
    assert rows[1] == (datetime(2025, 2, 1), datetime(2025, 2, 1))
    assert rows[2] == (datetime(2025, 3, 1), datetime(2025, 3, 1))
    assert rows[3] == (None, datetime(2025, 1, 1))
    assert frames.active_rows(twice).count() == 1 and frames.inactive_rows(twice).count() == 2


def test_sum_by_is_one_row_per_key(spark):
    paid = spark.createDataFrame([(1, Decimal("1.10")), (1, Decimal("2.20")), (1, None), (2, Decimal("3.00"))], "k int, a decimal(5,2)")
    assert {r.k: r.t for r in frames.sum_by(paid, "k", "a", "t").collect()} == {1: Decimal("3.30"), 2: Decimal("3.00")}


def test_stack_and_best_source(spark):
    a = spark.createDataFrame([(1, "old", 1), (2, "only a", 1)], "k int, v string, at int")
    b = spark.createDataFrame([(1, 5), (1, 7), (3, 1)], "k int, at int")
    stacked = frames.stack_sources({"a": a, "b": b})
    assert stacked.columns == ["k", "v", "at", "source_system"] and stacked.count() == 5
    best = frames.best_source_per_key(stacked, ["k"], ["b", "a"], ["at"])
    assert {r.k: (r.source_system, r.at) for r in best.collect()} == {1: ("b", 7), 2: ("a", 1), 3: ("b", 1)}
    unlisted = frames.best_source_per_key(stacked, ["k"], ["a"], ["at"])
    assert {r.k: r.source_system for r in unlisted.collect()} == {1: "a", 2: "a", 3: "b"}


def test_map_columns_folds_case(spark):
    df = spark.createDataFrame([(7, "Ann Lee", "A@B.COM")], "customer_id int, full_name string, email string")
    row = frames.map_columns(df, {"id": "customer_id", "name": F.upper("full_name"), "email": F.lower("email")}).first()
    assert (row.id, row.name, row.email) == (7, "ANN LEE", "a@b.com")


def test_upsert_takes_the_newest_change(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, at int")
    assert {r.k: r.v for r in frames.upsert(current, changes, ["k"], ["at"]).collect()} == {1: "a", 2: "y", 3: "z"}
