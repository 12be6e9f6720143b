"""Even scan ranges on uneven keys."""

import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orelayer.sources import ranges


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A key by Zipf's law, one value of which has a third of all rows, some nulls, and an even second column."""
    path = str(tmp_path_factory.mktemp("skewed") / "rows")
    share = F.pmod(F.xxhash64("id"), F.lit(100)) / 100
    zipf = F.floor(F.pow(F.lit(1e5), F.rand(1)))
    key = F.when(share < 0.33, F.lit(42)).when(share >= 0.34, zipf)
    spark.range(150_000, numPartitions=3).select(key.cast("bigint").alias("key"), F.col("id").alias("row")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("sample", [200_000, 40_000])
def test_the_largest_range_is_near_the_mean(skewed, sample):
    found = ranges.even_ranges(skewed, "key", 16, then="row", sample=sample)
    real = ranges.sizes(skewed, found)
    mean = 150_000 / len(found)
    assert None not in real and sum(real.values()) == 150_000 and len(found) == 16
    assert max(real.values()) <= 1.2 * mean if sample > 150_000 else max(real.values()) <= 1.3 * mean


def test_every_row_is_in_one_range(skewed):
    """Also with ranges from a handful of rows: each predicate on its own, no row twice."""
    found = ranges.even_ranges(skewed, "key", 10, then="row", sample=50)
    each = [skewed.where(r.predicate).count() for r in found]
    assert sum(each) == 150_000
    assert sum(ranges.sizes(skewed, found).values()) == 150_000


def test_a_busy_value_without_a_second_column_stays_whole(skewed):
    found = ranges.even_ranges(skewed, "key", 8)
    real = ranges.sizes(skewed, found)
    assert real.total() == 150_000 and len(found) < 8 and max(real.values()) > 0.33 * 150_000


@pytest.mark.parametrize(
    "values",
    [
        ["a'b", "c\\d", "", "zz", None],
        [datetime(2024, 1, 1, 2, 3, 4, 567), datetime(2024, 1, 2), None],
        [date(2024, 1, 1), date(2025, 1, 1)],
        [Decimal("1.50"), Decimal("-2.25"), None],
        [1.5, -0.1, 1e300, None],
        [None, None],
    ],
)
def test_keys_of_every_kind(spark, values):
    rng = random.Random(1)
    kind = {str: "string", datetime: "timestamp_ntz", date: "date", Decimal: "decimal(9,2)", float: "double"}.get(type(values[0]), "int")
    df = spark.createDataFrame([(rng.choice(values), i) for i in range(200)], f"key {kind}, row int")
    found = ranges.even_ranges(df, "key", 4, then="row")
    assert sum(df.where(r.predicate).count() for r in found) == 200


def test_an_empty_table_has_one_range(spark):
    assert ranges.even_ranges(spark.range(0), "id", 5) == [ranges.Range("TRUE", 0.0)]
