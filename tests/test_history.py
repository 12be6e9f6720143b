"""History rules on hand-made snapshots and change feeds."""

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orelayer.functions.columns import HISTORY_COLUMNS
from orelayer.operators import history

SCHEMA = "id int, name string, balance int, note_cache string"
TS = "2025-01-01 00:00:00"
OLD = [(1, "same", 1, "x"), (2, "changed", 1, "x"), (3, "cache only", 1, "x"), (4, "to null", 1, "x"), (5, "from null", None, "x"), (6, "removed", 1, "x")]
NEW = [(1, "same", 1, "x"), (2, "changed", 2, "x"), (3, "cache only", 1, "y"), (4, "to null", None, "x"), (5, "from null", 1, "x"), (7, "added", 1, "x")]


def diff(spark, old, new, batch="b1"):
    return history.snapshot_diff(
        spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA), ["id"], batch, TS
    )


def test_snapshot_diff_rules(spark):
    rows = {r.id: r for r in diff(spark, OLD, NEW).collect()}
    assert {k: r.operation_type for k, r in rows.items()} == {2: "UPDATE", 4: "UPDATE", 5: "UPDATE", 6: "DELETE", 7: "INSERT"}
    assert rows[2].balance == 2 and rows[6].name == "removed"
    assert rows[2].effective_time == rows[2].systime == datetime(2025, 1, 1)
    assert "note_cache" not in rows[2].asDict()


def test_history_ids_repeat_for_a_batch_and_differ_between_batches(spark):
    ids = [{r.history_id for r in diff(spark, OLD, NEW, b).collect()} for b in ("b1", "b1", "b2")]
    assert ids[0] == ids[1] and not ids[0] & ids[2]


def test_effective_time_of_the_row_wins_and_is_not_tracked(spark):
    schema = "id int, v int, effective_time timestamp_ntz"
    at = datetime(2020, 1, 1)
    old = spark.createDataFrame([(1, 1, at), (2, 1, at)], schema)
    new = spark.createDataFrame([(1, 1, datetime(2021, 1, 1)), (2, 2, None), (3, 1, at)], schema)
    rows = {r.id: r for r in history.snapshot_diff(old, new, ["id"], "b", TS).collect()}
    assert set(rows) == {2, 3}
    assert rows[2].effective_time == datetime(2025, 1, 1) and rows[3].effective_time == at


states = st.dictionaries(
    st.integers(1, 6), st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, None])), max_size=6
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(states, states)
def test_old_plus_history_is_new(spark, old, new):
    frames = [spark.createDataFrame([(k, *v) for k, v in s.items()], "id int, name string, balance int") for s in (old, new)]
    batch = history.snapshot_diff(*frames, ["id"], "b", TS)
    moved = history.apply_history(frames[0], batch, ["id"]).collect()
    assert {r.id: (r.name, r.balance) for r in moved} == new


CHAIN = [
    # user, state, minute, id
    (1, "a", 0, 1), (1, "a", 1, 2), (1, "b", 2, 3), (1, "gone", 3, 4), (1, "gone", 4, 5), (1, "b", 5, 6),
    (2, "gone", 0, 7), (2, "a", 1, 8), (3, None, 0, 9), (3, None, 1, 10), (3, "a", 2, 11),
]


@pytest.fixture(scope="module")
def feed(spark):
    rows = [(u, s, datetime(2025, 1, 1, 0, m), i) for u, s, m, i in CHAIN]
    return spark.createDataFrame(rows, "user int, state string, at timestamp_ntz, id int")


@pytest.mark.parametrize("cut", [{}, {"floor": 1, "share": 1000}])
def test_change_feed_with_deletes(feed, cut):
    rows = history.history_from_changes(feed, ["user"], ["state"], ["at", "id"], TS, deleted=F.col("state") == "gone", **cut)
    got = sorted((r.user, r.effective_time.minute, r.operation_type, r.state) for r in rows.collect())
    assert got == [
        (1, 0, "INSERT", "a"), (1, 2, "UPDATE", "b"), (1, 3, "DELETE", "b"), (1, 5, "INSERT", "b"),
        (2, 1, "INSERT", "a"), (3, 0, "INSERT", None), (3, 2, "UPDATE", "a"),
    ]


@pytest.fixture(scope="module")
def chain(spark):
    """INSERT, UPDATE, two updates at one moment, DELETE, INSERT again; a second key that came late."""
    rows = [
        (1, "a", "h1", 1, "INSERT"), (1, "b", "h2", 3, "UPDATE"), (1, "c", "h3", 5, "UPDATE"), (1, "d", "h4", 5, "UPDATE"),
        (1, "d", "h5", 7, "DELETE"), (1, "e", "h6", 9, "INSERT"), (2, "z", "h7", 4, "INSERT"),
    ]
    data = [(k, v, h, datetime(2025, 1, d), datetime(2025, 2, 1), op) for k, v, h, d, op in rows]
    return spark.createDataFrame(
        data, "k int, v string, history_id string, effective_time timestamp_ntz, systime timestamp_ntz, operation_type string"
    )


@pytest.mark.parametrize("cut", [{}, {"floor": 1, "share": 1000}])
def test_versions_do_not_overlap(chain, cut):
    rows = history.versions(chain, ["k"], **cut).collect()
    got = sorted((r.k, r.v, r.valid_from.day, r.valid_to.day if r.valid_to else None, r.is_current) for r in rows)
    assert got == [
        (1, "a", 1, 3, False), (1, "b", 3, 5, False), (1, "d", 5, 7, False), (1, "e", 9, None, True), (2, "z", 4, None, True),
    ]


@pytest.mark.parametrize("day,expected", [(1, {1: "a"}), (3, {1: "b"}), (5, {1: "d", 2: "z"}), (7, {2: "z"}), (9, {1: "e", 2: "z"})])
def test_as_of_at_each_edge(chain, day, expected):
    rows = history.as_of(history.versions(chain, ["k"]), datetime(2025, 1, day)).collect()
    assert {r.k: r.v for r in rows} == expected


@pytest.mark.parametrize("cut", [{}, {"floor": 1, "share": 1000}])
def test_as_of_lookup_agrees_with_as_of(spark, chain, cut):
    probes = spark.createDataFrame(
        [(k, datetime(2025, 1, d), f"{k}-{d}") for k in (1, 2, 3) for d in range(1, 11)], "k int, asked timestamp_ntz, label string"
    )
    got = {r.label: r.as_of_v for r in history.as_of_lookup(probes, "asked", chain, ["k"], **cut).collect()}
    assert len(got) == 30
    versions = history.versions(chain, ["k"])
    for day in (1, 2, 4, 5, 6, 7, 8, 9, 10):
        held = {r.k: r.v for r in history.as_of(versions, datetime(2025, 1, day)).collect()}
        assert {k: got[f"{k}-{day}"] for k in (1, 2, 3)} == {k: held.get(k) for k in (1, 2, 3)}


def test_rebuild_and_reconcile(spark, chain):
    current = spark.createDataFrame([(1, "e"), (2, "z")], "k int, v string")
    assert {(r.k, r.v) for r in history.rebuild_current(chain, ["k"]).collect()} == {(1, "e"), (2, "z")}
    assert history.reconcile(chain, current, ["k"]).count() == 0
    wrong = spark.createDataFrame([(1, "x"), (3, "new")], "k int, v string")
    got = {(r.k, r.operation_type) for r in history.reconcile(chain, wrong, ["k"]).collect()}
    assert got == {(1, "UPDATE"), (2, "DELETE"), (3, "INSERT")}


def test_history_schema(spark):
    primary = spark.createDataFrame([], "id int, v string, row_hash string, effective_time timestamp_ntz, created_at timestamp_ntz").schema
    assert history.history_schema(primary).names == ["id", "v", *HISTORY_COLUMNS]
    assert history.history_schema(primary, ["v"]).names == ["id", *HISTORY_COLUMNS]
    only_clocks = spark.createDataFrame([], "effective_time timestamp_ntz, systime timestamp_ntz").schema
    assert history.history_schema(only_clocks).names == HISTORY_COLUMNS
