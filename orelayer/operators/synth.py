"""Generated rows for trying out tables, made side by side and the same on every run.

Each generator extends a frame of ids, such as ``spark.range(n)`` or the keys of a table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    DecimalType,
    FractionalType,
    IntegralType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from orelayer.functions.columns import clock
from orelayer.functions.draws import Draws

# The names and symbols generated rows are drawn from.
COUNTRIES = [
    "United States",
    "Canada",
    "United Kingdom",
    "Germany",
    "France",
    "Japan",
    "Australia",
    "Brazil",
    "India",
    "China",
    "Mexico",
    "Italy",
    "Spain",
    "Netherlands",
    "Sweden",
    "Norway",
    "Switzerland",
    "Austria",
    "Belgium",
    "Denmark",
]
SYMBOLS = ["AAPL", "GOOGL", "MSFT", "AMZN", "TSLA", "NVDA", "META", "NFLX"]
SIDES = ["BUY", "SELL"]
FIRST_NAMES = ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gita", "Hugo"]
LAST_NAMES = ["Adler", "Brook", "Costa", "Dietz", "Evans", "Fabre", "Gupta", "Holm"]


def _before(now: datetime | str, days: int) -> Column:
    return F.timestamp_add("DAY", F.lit(-days), clock(now))


def reference_rows(ids: DataFrame, key: str, now: datetime | str, seed: int = 0, inactive: float = 0.2) -> DataFrame:
    """Reference rows, each inactive with the given probability."""
    drawn = Draws([key], seed)
    return ids.withColumns(
        {
            "inactivated_date": F.when(drawn.chance("inactive", inactive), clock(now)),
            "systime": clock(now),
        }
    )


def country_rows(ids: DataFrame, key: str, now: datetime | str, seed: int = 0) -> DataFrame:
    """Country rows; ids beyond the last country start over at the first."""
    place = F.pmod(F.col(key), F.lit(len(COUNTRIES))).cast("int") + 1
    name = F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), place)
    named = ids.select(key, name.alias("name"), F.upper(F.left(name, F.lit(2))).alias("code"), F.lit(True).alias("active"))
    return reference_rows(named, key, now, seed)


def transaction_rows(ids: DataFrame, key: str, now: datetime | str, seed: int = 0) -> DataFrame:
    """Rows created over the 30 days before ``now``; three in ten were changed 1 to 5 days later."""
    drawn = Draws([key], seed)
    created = drawn.later(_before(now, 30), "created", (0, 30), (0, 23), (0, 59))
    rows = ids.withColumn("created_at", created)
    changed = drawn.later(F.col("created_at"), "updated", (1, 5), (0, 23))
    rows = rows.withColumn("updated_at", F.when(drawn.chance("changed", 0.3), changed).otherwise(F.col("created_at")))
    return rows.withColumn("systime", F.col("updated_at"))


def trade_rows(ids: DataFrame, key: str, now: datetime | str, seed: int = 0) -> DataFrame:
    drawn = Draws([key], seed)
    trades = ids.select(
        key,
        drawn.one_of("symbol", SYMBOLS).alias("symbol"),
        drawn.whole("quantity", 1, 1000).alias("quantity"),
        drawn.amount("price", 50, 500).alias("price"),
        drawn.one_of("side", SIDES).alias("side"),
    )
    return transaction_rows(trades, key, now, seed)


def temporal_rows(ids: DataFrame, key: str, now: datetime | str, seed: int = 0) -> DataFrame:
    """Rows that take effect over the 60 days before ``now``."""
    effective = Draws([key], seed).later(_before(now, 60), "effective", (0, 60), (0, 23), (0, 59))
    return ids.withColumns({"effective_time": effective, "systime": clock(now)})


def version_rows(ids: DataFrame, key: str, now: datetime | str, versions: int = 3, seed: int = 0) -> DataFrame:
    """Several versions per id, 5 days apart from 30 days before ``now``, at an hour from 9 to 17."""
    rows = ids.withColumn("version", F.explode(F.sequence(F.lit(1), F.lit(versions))))
    hour = Draws([key, "version"], seed).whole("hour", 9, 17)
    effective = F.timestamp_add("HOUR", (F.col("version") - 1) * 120 + hour, _before(now, 30))
    return rows.withColumns({"effective_time": effective, "systime": clock(now)})


# ---------------------------------------------------------------- by column kind or schema


def _kinds(key: str, now: datetime | str, seed: int) -> dict[str, Callable[[str], Column]]:
    drawn = Draws([key], seed)

    def name(label: str) -> Column:
        return F.concat(drawn.one_of(f"{label}_first", FIRST_NAMES), F.lit(" "), drawn.one_of(f"{label}_last", LAST_NAMES))

    def email(label: str) -> Column:
        return F.concat(F.lower(F.replace(name(label), F.lit(" "), F.lit("."))), F.col(key).cast("string"), F.lit("@example.com"))

    return {
        "int_sequence": lambda label: F.col(key).cast("bigint"),
        "random_name": name,
        "random_email": email,
        "random_float": lambda label: drawn.whole(label, 0, 100_000) / F.lit(100.0),
        "random_datetime": lambda label: drawn.later(_before(now, 30), label, (0, 29), (0, 23), (0, 59)),
    }


def generate(ids: DataFrame, key: str, columns: Mapping[str, str], now: datetime | str, seed: int = 0) -> DataFrame:
    """Columns by kind: ``{"id": "int_sequence", "name": "random_name", ...}``."""
    kinds = _kinds(key, now, seed)
    unknown = set(columns.values()) - set(kinds)
    if unknown:
        raise ValueError(f"unknown column kinds: {sorted(unknown)}")
    return ids.select([kinds[kind](name).alias(name) for name, kind in columns.items()])


def generate_for(ids: DataFrame, key: str, schema: StructType, now: datetime | str, seed: int = 0) -> DataFrame:
    """A value of the declared type in every column; the first column takes the id."""
    drawn = Draws([key], seed)
    kinds = _kinds(key, now, seed)
    columns = []
    for i, field in enumerate(schema):
        if i == 0:
            value = F.col(key).cast(field.dataType)
        elif isinstance(field.dataType, BooleanType):
            value = drawn.chance(field.name, 0.5)
        elif isinstance(field.dataType, IntegralType):
            value = drawn.whole(field.name, 0, 100).cast(field.dataType)
        elif isinstance(field.dataType, DecimalType):
            room = 10.0 ** (field.dataType.precision - field.dataType.scale)
            value = (drawn.share(field.name) * F.lit(room * 0.99)).cast(field.dataType)
        elif isinstance(field.dataType, FractionalType):
            value = kinds["random_float"](field.name).cast(field.dataType)
        elif isinstance(field.dataType, (DateType, TimestampNTZType, TimestampType)):
            value = kinds["random_datetime"](field.name).cast(field.dataType)
        elif isinstance(field.dataType, StringType):
            value = kinds["random_name"](field.name)
        else:
            raise ValueError(f"no generator for {field.name} of type {field.dataType.simpleString()}")
        columns.append(value.alias(field.name))
    return ids.select(columns)


def add_noise(df: DataFrame, key: str, percent: float, seed: int = 0) -> DataFrame:
    """Set each value outside the key to null with the given probability in percent."""
    drawn = Draws([key], seed)
    return df.select(
        [
            F.col(c) if c == key else F.when(~drawn.chance(f"noise_{c}", percent / 100.0), F.col(c)).alias(c)
            for c in df.columns
        ]
    )
