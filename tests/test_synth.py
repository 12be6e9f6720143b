"""Generated rows: the same on every run, within range, with the declared shares."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orelayer.operators import synth

NOW = "2025-01-01 00:00:00"
T = datetime(2025, 1, 1)
N = 4000


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(N)


def near(value, expected, slack=0.03):
    assert abs(value - expected) < slack


def test_rows_do_not_depend_on_partitions(ids):
    one = synth.trade_rows(ids.coalesce(1), "id", NOW, 1).orderBy("id").collect()
    many = synth.trade_rows(ids.repartition(7), "id", NOW, 1).orderBy("id").collect()
    assert one == many
    assert one != synth.trade_rows(ids, "id", NOW, 2).orderBy("id").collect()


def test_reference(ids):
    rows = synth.reference_rows(ids, "id", NOW)
    near(rows.where("inactivated_date IS NOT NULL").count() / N, 0.2)


def test_countries(ids):
    rows = synth.country_rows(ids, "id", NOW)
    assert rows.select("name").distinct().count() == 20
    assert rows.where("id = 0").first().code == "UN" and rows.where("id = 20").first().name == "United States"


def test_transactions(ids):
    rows = synth.transaction_rows(ids, "id", NOW)
    low, high = rows.agg(F.min("created_at"), F.max("created_at")).first()
    assert low >= T - timedelta(days=30) and high < T + timedelta(days=1)
    changed = rows.where("updated_at > created_at")
    near(changed.count() / N, 0.3)
    gap = changed.select(F.timestamp_diff("HOUR", F.col("created_at"), F.col("updated_at")).alias("h")).agg(F.min("h"), F.max("h")).first()
    assert gap[0] >= 24 and gap[1] < 6 * 24
    assert rows.where("systime <> updated_at").count() == 0


def test_trades(ids):
    rows = synth.trade_rows(ids, "id", NOW)
    low, high, cheap, dear = rows.agg(F.min("quantity"), F.max("quantity"), F.min("price"), F.max("price")).first()
    assert 1 <= low and high <= 1000 and cheap >= 50 and dear <= 500
    assert rows.select("symbol").distinct().count() == 8
    near(rows.where("side = 'BUY'").count() / N, 0.5)


def test_temporal_and_versions(ids):
    rows = synth.temporal_rows(ids, "id", NOW)
    low, high = rows.agg(F.min("effective_time"), F.max("effective_time")).first()
    assert low >= T - timedelta(days=60) and high < T + timedelta(days=1)
    versions = synth.version_rows(ids, "id", NOW, 4)
    assert versions.count() == 4 * N and versions.where("id = 3").count() == 4
    assert versions.where("hour(effective_time) NOT BETWEEN 9 AND 17").count() == 0
    days = {r.version: r.effective_time.date() for r in versions.where("id = 3").collect()}
    assert [(days[v + 1] - days[v]).days for v in (1, 2, 3)] == [5, 5, 5]


def test_kinds_schema_and_noise(ids):
    kinds = {"id": "int_sequence", "name": "random_name", "email": "random_email", "amount": "random_float", "created": "random_datetime"}
    rows = synth.generate(ids, "id", kinds, NOW)
    assert rows.columns == list(kinds) and rows.select("email").distinct().count() == N
    with pytest.raises(ValueError, match="unknown column kinds"):
        synth.generate(ids, "id", {"x": "random_colour"}, NOW)
    schema = ids.sparkSession.createDataFrame(
        [], "k bigint, s string, i int, d decimal(6,2), f double, b boolean, day date, t timestamp_ntz"
    ).schema
    made = synth.generate_for(ids, "id", schema, NOW)
    assert made.schema.simpleString() == schema.simpleString()
    noisy = synth.add_noise(made, "k", 25)
    near(noisy.where("s IS NULL").count() / N, 0.25)
    assert noisy.where("k IS NULL").count() == 0
    with pytest.raises(ValueError, match="no generator"):
        synth.generate_for(ids, "id", ids.sparkSession.createDataFrame([], "k bigint, m map<string,int>").schema, NOW)
