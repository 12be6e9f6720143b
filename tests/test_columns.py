"""Stamps, keys, hashes and casts on hand-made rows."""

import hashlib
from datetime import UTC, date, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orelayer.functions import columns as C

NOW = "2025-01-01 00:00:00"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Charlie")], "id int, name string")


def test_stamp_source_adds_columns_and_leaves_input_alone(people):
    stamped = C.stamp_source(people, "shop", "people", "db", load_time=NOW)
    assert people.columns == ["id", "name"]
    assert stamped.columns == ["id", "name", *C.BRONZE_FILE_COLUMNS]
    row = stamped.where("id = 1").first()
    assert row.bronze_load_timestamp == "2025-01-01T00:00:00.000000"
    assert row.bronze_extraction_method == "full_snapshot"


def test_stamp_source_without_a_clock_uses_the_current_time(people):
    text = C.stamp_source(people, "s", "t", "h").first().bronze_load_timestamp
    assert abs((datetime.fromisoformat(text) - datetime.now(UTC).replace(tzinfo=None)).total_seconds()) < 3600


def test_stamp_batch_text_typed_and_random_key(people):
    text = C.stamp_batch(people, "people", "b1", NOW, random_key=True)
    assert dict(text.dtypes)["id"] == "string"
    assert text.columns[-1] == "br_people_key"
    assert text.select("br_people_key").distinct().count() == 3
    typed = C.stamp_batch(people, "people", "b1", NOW, schema="public", text=False)
    assert dict(typed.dtypes)["id"] == "int"
    assert typed.first().br_source_table == "public.people"
    hashes = [{r.br_record_hash for r in df.collect()} for df in (text, typed)]
    assert hashes[0] == hashes[1]


def test_record_hash_is_md5_of_joined_text_on_clean_rows(people):
    row = people.select(C.record_hash(people.columns).alias("h")).orderBy("id").first()
    assert row.h == hashlib.md5(b"1|Alice").hexdigest()


def test_record_hash_tells_null_positions_and_bars_apart(spark):
    rows = [("a", None, "b"), ("a", "b", None), ("a|b", None, None), ("a", "b", "\\N"), ("a", "\\", "|b"), ("a", "\\|", "b")]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    assert df.select(C.record_hash(df.columns).alias("h")).distinct().count() == len(rows)


def test_plain_columns_hash_the_same(spark):
    df = spark.createDataFrame([(1, Decimal("1.50"), "a|b"), (None, None, None)], "i int, d decimal(5,2), s string")
    both = df.select(C.record_hash(df.columns).alias("a"), C.record_hash(df.columns, C.plain_columns(df)).alias("b"))
    assert both.where("a <> b").count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.text("ab|\\N", max_size=4) | st.none(), st.text("ab|\\N", max_size=4) | st.none()),
        min_size=2, max_size=12, unique=True,
    )
)
def test_distinct_rows_have_distinct_hashes(spark, rows):
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(C.record_hash(["x", "y"]).alias("h")).distinct().count() == len(rows)


def test_stable_uuid(spark):
    df = spark.range(1).select(F.lit(7).alias("k"))
    digest = hashlib.md5(b"7").hexdigest()
    expected = f"{digest[:8]}-{digest[8:12]}-{digest[12:16]}-{digest[16:20]}-{digest[20:]}"
    row = df.select(C.stable_uuid("k").alias("a"), F.expr(C.stable_uuid_sql("k")).alias("b")).first()
    assert row.a == row.b == expected


def test_casts_keep_rows_with_bad_values(spark):
    df = spark.createDataFrame([("",), ("x",), ("12.345",), ("99999",), (None,)], "v string")
    out = df.select(
        "v",
        C.typed("v", "int").alias("i"),
        C.typed("v", "decimal(4,2)").alias("d"),
        C.typed("v", "boolean").alias("b"),
        C.typed("v", "timestamp_ntz").alias("t"),
        C.lost_in_cast(C.Field("v", "decimal(4,2)")).alias("lost"),
    )
    rows = {r.v: r for r in out.collect()}
    assert rows["99999"].i == 99999 and rows["99999"].d is None and rows["99999"].lost
    assert rows["99999"].t is None
    assert rows["12.345"].d == Decimal("12.35") and not rows["12.345"].lost
    assert rows["x"].b is None and rows[""].t is None and rows[""].lost
    assert not rows[None].lost


def test_strict_cast_fails_the_job(spark):
    df = spark.createDataFrame([("x",)], "v string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(C.typed("v", "int", strict=True)).collect()


@pytest.mark.parametrize(
    "text,expected",
    [("t", True), ("1", True), ("True", True), ("on", True), ("no", False), ("OFF", False), ("false", False), ("2", None)],
)
def test_boolean_words(spark, text, expected):
    assert spark.createDataFrame([(text,)], "v string").select(C.typed("v", "boolean").alias("b")).first().b is expected


def test_texts_are_cut_and_padded(spark):
    df = spark.createDataFrame([("x" * 60, "abc")], "long string, short string")
    row = df.select(C.conform(C.Field("long", length=45)), C.conform(C.Field("short", length=20, pad=True))).first()
    assert row.long == "x" * 45
    assert row.short == "abc" + " " * 17


def test_full_name_is_null_if_a_part_is(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "f string, l string")
    assert [r[0] for r in df.selectExpr(C.full_name_sql("f", "l")).collect()] == ["a b", None]


def test_table_kinds(people):
    reference = C.stamp_reference(people, NOW).first()
    assert reference.inactivated_date is None and reference.systime == datetime(2025, 1, 1)
    made = C.stamp_transactional(people, NOW)
    touched = C.touch_transactional(made, "2025-03-01 00:00:00").first()
    assert touched.created_at == datetime(2025, 1, 1)
    assert touched.updated_at == touched.systime == datetime(2025, 3, 1)
    temporal = C.stamp_temporal(people, NOW, F.lit("2020-05-05").cast("timestamp_ntz")).first()
    assert temporal.effective_time == datetime(2020, 5, 5) and temporal.systime == datetime(2025, 1, 1)


def test_tracked_columns():
    columns = ["doc_id", "title", "author", "content_blob", "row_hash", "x_cache", "y_temp", "created_at", "systime", "effective_time"]
    assert C.tracked_columns(columns) == ["doc_id", "title", "author"]
    assert C.tracked_columns(columns, ["author"]) == ["doc_id", "title"]


def test_hours_and_weekends(spark):
    df = spark.createDataFrame(
        [(datetime(2025, 1, 5), datetime(2025, 1, 5, 1, 30)), (datetime(2025, 1, 6), None), (datetime(2025, 1, 4), datetime(2025, 1, 3))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    rows = df.selectExpr(f"{C.hours_sql('a', 'b')} AS h", f"{C.weekend_sql('a')} AS w").collect()
    assert [(r.h, r.w) for r in rows] == [(1.5, True), (None, False), (-24.0, True)]


def test_clock_takes_dates_and_times(spark):
    row = spark.range(1).select(C.clock(date(2025, 1, 2)).alias("d"), C.clock(datetime(2025, 1, 2, 3, 4, 5, 6)).alias("t")).first()
    assert row.d == datetime(2025, 1, 2) and row.t == datetime(2025, 1, 2, 3, 4, 5, 6)
