"""Cutting busy keys changes nothing but where rows are sorted."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orelayer.functions import skew

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds most rows, some keys and times are null, times repeat and come in bursts."""
    rng = random.Random(5)
    data = []
    for i in range(3000):
        key = 1 if rng.random() < 0.6 else rng.choice([2, 3, 4, None, rng.randrange(5, 400)])
        at = START + timedelta(seconds=int(rng.random() ** 6 * 900_000))
        data.append((key, None if rng.random() < 0.02 else at, i, rng.choice(["a", "b", "c", None])))
    return spark.createDataFrame(data, "k int, at timestamp_ntz, id int, v string").cache()


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("own", [False, True])
@pytest.mark.parametrize("share", [1000, 20])
def test_nearest_state_equals_a_plain_window(rows, after, own, share):
    state = F.when(F.col("v") != "c", F.col("v"))
    order = [F.col(c).desc() if after else F.col(c).asc() for c in ("at", "id")]
    frame = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    expected = rows.withColumn("s", F.last(state, ignorenulls=True).over(frame))
    got = skew.nearest_state(rows, ["k"], ["at", "id"], state, "s", after=after, own=own, floor=5, share=share)
    assert got.columns == expected.columns
    assert sorted(got.collect(), key=str) == sorted(expected.collect(), key=str)


def test_nearest_state_of_two_columns_and_given_busy_keys(rows):
    busy = skew.known_busy_keys(rows, ["k"], "at", floor=50, share=100)
    assert busy.count() >= 1
    state = F.struct("v", "id")
    got = skew.nearest_state(rows, ["k"], ["at", "id"], state, "s", busy=busy)
    plain = skew.nearest_state(rows, ["k"], ["at", "id"], state, "s", busy=False)
    assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)


def test_busy_keys_are_few_and_cut_into_pieces(rows):
    busy = {r["_busy_k"]: r["_pieces"] for r in skew.busy_keys(rows, ["k"], "at", floor=10, share=20).collect()}
    assert set(busy) >= {1} and len(busy) <= 20
    assert busy[1] >= 10


def test_no_busy_key(rows):
    assert skew.known_busy_keys(rows, ["k"], "at") is False


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_lookup_equals_a_plain_join(spark, rows, how):
    dim = spark.createDataFrame([(k, f"name {k}") for k in range(0, 300)], "k int, name string")
    got = skew.salted_lookup(rows, dim, ["k"], ["id"], how, floor=5, share=100)
    expected = rows.join(dim, "k", how)
    assert sorted(got.select(expected.columns).collect(), key=str) == sorted(expected.collect(), key=str)


@pytest.mark.parametrize("count", [None, 300, 10**9])
def test_lookup_by_counted_size(spark, rows, count):
    dim = spark.createDataFrame([(k, f"name {k}") for k in range(0, 300)], "k int, name string")
    got = skew.lookup(rows, dim, ["k"], ["id"], count)
    assert got.count() == rows.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    if count == 300:
        assert "BroadcastHashJoin" in plan


def test_latest_per_key_limits_rows_before_the_shuffle(rows):
    latest = skew.latest_per_key(rows, ["k"], F.desc("at"), F.desc("id"))
    assert latest.count() == rows.select("k").distinct().count()
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
