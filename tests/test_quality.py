"""Checks on hand-made rows with duplicates, nulls and missing parents."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orelayer.functions import columns as C
from orelayer.operators import quality


@pytest.fixture(scope="module")
def child(spark):
    return spark.createDataFrame(
        [(1, "a", 10), (1, "b", 10), (None, "c", 99), (3, None, 99), (4, "z", None), (None, "c", None)],
        "id int, kind string, parent int",
    )


@pytest.fixture(scope="module")
def parent(spark):
    return spark.createDataFrame([(10,), (11,)], "pid int")


def one(df):
    return df.first().failing_rows


def test_row_checks_in_one_pass(child):
    checks = [*quality.not_null("id", "kind"), quality.accepted_values("kind", ["a", "b"])]
    rows = {(r.check_name, r.column_name): (r.failing_rows, r.status) for r in quality.check_rows(child, "child", checks).collect()}
    assert rows == {
        ("not_null", "id"): (2, "FAIL"), ("not_null", "kind"): (1, "FAIL"), ("accepted_values", "kind"): (3, "FAIL"),
    }


def test_unique_ignores_nulls(child, parent):
    assert one(quality.check_unique(child, "child", "id")) == 1
    assert one(quality.check_unique(parent, "parent", "pid")) == 0


def test_relationship_and_orphans_differ_on_null_keys(child, parent):
    assert one(quality.check_relationship(child, "child", "parent", parent, "pid")) == 2
    assert one(quality.check_orphans(child, "child", "parent", parent, "pid")) == 4
    assert quality.orphan_rows(child, "parent", parent, "pid").count() == 4


def test_checks_pass_on_empty_tables(spark, parent):
    empty = spark.createDataFrame([], "id int, kind string, parent int")
    report = quality.report(
        quality.check_rows(empty, "e", quality.not_null("id")),
        quality.check_unique(empty, "e", "id"),
        quality.check_relationship(empty, "e", "parent", parent, "pid"),
        quality.check_match(empty, empty, "e"),
    )
    assert [r.status for r in report.collect()] == ["PASS"] * 4
    quality.require(report, "layer")


def test_require_stops_on_failures(child):
    with pytest.raises(ValueError, match="silver checks failed: child.id not_null: 2"):
        quality.require(quality.check_rows(child, "child", quality.not_null("id")), "silver")


def test_row_counts_against_expectations(spark):
    tables = {name: spark.range(n) for name, n in {"exact": 200, "off": 5, "none": 0, "some": 1}.items()}
    expected = {"exact": 200, "off": 1000, "none": 3, "some": None, "absent": None}
    rows = {r.table_name: r.status for r in quality.check_counts(quality.row_counts(tables), expected).collect()}
    assert rows == {"exact": "PASS", "off": "WARN", "none": "FAIL", "some": "PASS", "absent": "FAIL"}


def test_bronze_checks(spark):
    df = C.stamp_source(spark.range(2), "s", "t", "h", "guess", "2025-01-01 00:00:00").drop("bronze_source_host")
    rows = {(r.check_name, r.column_name): r.failing_rows for r in quality.check_rows(df, "t", quality.bronze_checks(df.columns)).collect()}
    assert rows[("column_present", "bronze_source_host")] == 2
    assert rows[("accepted_values", "bronze_extraction_method")] == 2
    assert rows[("not_null", "bronze_source_system")] == 0


def test_contract_lists_missing_extra_and_lost_values(spark):
    df = spark.createDataFrame([("1", "x", "9"), ("y", "z", "8")], "id string, name string, surplus string")
    fields = [C.Field("id", "int"), C.Field("name"), C.Field("price", "double")]
    rows = {(r.check_name, r.column_name): r.failing_rows for r in quality.check_contract(df, "t", fields).collect()}
    assert rows == {("missing_column", "price"): 1, ("extra_column", "surplus"): 1, ("cast", "id"): 1}
    relaxed = quality.check_contract(df, "t", fields, allow_extra=True)
    assert relaxed.where("check_name = 'extra_column'").count() == 0


def test_types_drift(spark):
    declared = StructType.fromDDL("id int, name string, price double, active boolean")
    df = spark.createDataFrame([], "name string, id bigint, active boolean, more int")
    rows = {(r.check_name, r.column_name) for r in quality.check_types(df, "product", declared).collect()}
    assert rows == {("mistyped_column", "id"), ("missing_column", "price"), ("extra_column", "more")}


def test_history_pair(spark):
    primary = StructType.fromDDL("doc_id int, title string, content_blob string, effective_time timestamp_ntz, systime timestamp_ntz")
    good = StructType.fromDDL("doc_id int, title string, history_id string, effective_time timestamp_ntz, systime timestamp_ntz, operation_type string")
    rows = quality.check_history_pair(spark, "docs", primary, good).collect()
    assert [(r.check_name, r.failing_rows, r.status) for r in rows] == [
        ("tracked_columns", 2, "PASS"),
        ("excluded_columns", 3, "PASS"),
    ]
    bad = StructType.fromDDL("doc_id int, content_blob string, history_id string, effective_time timestamp_ntz, systime timestamp_ntz")
    names = {(r.check_name, r.column_name) for r in quality.check_history_pair(spark, "docs", primary, bad).collect()}
    assert {("tracked_column_missing", "title"), ("history_column_missing", "operation_type"), ("excluded_column_present", "content_blob")} < names


def test_failing_rows_and_score(child):
    checks = [*quality.not_null("id", "kind"), quality.accepted_values("kind", ["a", "b", "c"])]
    failing = {r.kind: r.failed_checks for r in quality.failing(child, checks).collect()}
    assert failing == {"c": ["not_null:id"], None: ["not_null:kind"], "z": ["accepted_values:kind"]}
    scores = [r.s for r in child.select(quality.quality_score(checks).alias("s")).collect()]
    assert [round(s, 3) for s in scores] == [1.0, 1.0, 0.667, 0.667, 0.667, 0.667]


def test_profiles_agree(child):
    exact = {r.column_name: r for r in quality.profile(child, "child", exact=True).collect()}
    quick = {r.column_name: r for r in quality.profile(child, "child").collect()}
    assert exact["kind"].null_count == 1 and exact["kind"].distinct_count == 4 and exact["kind"].row_count == 6
    assert exact["parent"].min_value == "10" and exact["parent"].max_value == "99"
    assert exact == quick


def test_estimated_distinct_is_close(spark):
    df = spark.range(20000).select((F.col("id") % 5000).alias("v"))
    estimate = quality.profile(df, "t").first().distinct_count
    assert abs(estimate - 5000) < 500
