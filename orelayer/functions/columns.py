"""Stamps, keys, hashes and casts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    MapType,
    NumericType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

# Column sets and names that stored tables share.
BRONZE_FILE_COLUMNS = [
    "bronze_load_timestamp",
    "bronze_source_system",
    "bronze_source_table",
    "bronze_source_host",
    "bronze_extraction_method",
]
BRONZE_TABLE_COLUMNS = [
    "br_load_time",
    "br_source_table",
    "br_batch_id",
    "br_is_current",
    "br_record_hash",
]
EXTRACTION_METHODS = ["full_snapshot", "incremental", "cdc"]
HISTORY_COLUMNS = ["history_id", "effective_time", "systime", "operation_type"]
OPERATIONS = ["INSERT", "UPDATE", "DELETE"]
UNTRACKED_COLUMNS = ["effective_time", "systime", "created_at"]
UNTRACKED_SUFFIXES = ["_cache", "_hash", "_blob", "_temp"]


UUID_PARTS = "^(.{8})(.{4})(.{4})(.{4})(.{12})$"
UUID_LAYOUT = "$1-$2-$3-$4-$5"
# Totals over any number of rows: room for 26 digits before the point, so that the sum of a busy key of a
# very large table does not overflow.
TOTAL = "decimal(28,2)"


def clock_sql(value: datetime | date | str | None = None) -> str:
    """:func:`clock` as SQL text."""
    if value is None:
        return "localtimestamp()"
    text = value if isinstance(value, str) else value.isoformat()
    return f"CAST('{text}' AS timestamp_ntz)"


def clock(value: datetime | date | str | None = None) -> Column:
    """A zone-less timestamp: the given one, or the moment the query starts."""
    return F.expr(clock_sql(value))


# ---------------------------------------------------------------- bronze stamps


def stamp_source(
    df: DataFrame,
    source_system: str,
    source_table: str,
    source_host: str,
    extraction_method: str = "full_snapshot",
    load_time: datetime | str | None = None,
) -> DataFrame:
    """Add the five ``bronze_*`` columns of the file layout; the load time is an ISO text."""
    moment = F.date_format(clock(load_time), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.withColumns(
        {
            "bronze_load_timestamp": moment,
            "bronze_source_system": F.lit(source_system),
            "bronze_source_table": F.lit(source_table),
            "bronze_source_host": F.lit(source_host),
            "bronze_extraction_method": F.lit(extraction_method),
        }
    )


def stamp_batch(
    df: DataFrame,
    table: str,
    batch_id: str,
    load_time: datetime | str | None = None,
    *,
    schema: str | None = None,
    text: bool = True,
    random_key: bool = False,
) -> DataFrame:
    """Add the ``br_*`` columns of the staging layout, the record hash included.

    ``text`` rewrites every business column as text, which is how staging tables hold them; leave it off
    to keep source types. The hash is the same either way. A source that has one of the added columns
    already is an error: its values would be lost.
    """
    taken = {*BRONZE_FILE_COLUMNS, *BRONZE_TABLE_COLUMNS, f"br_{table}_key"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"the source has columns that landing adds: {sorted(taken)}")
    business = df.columns
    landed = df.withColumns(
        {
            "br_load_time": clock(load_time),
            "br_source_table": F.lit(f"{schema}.{table}" if schema else table),
            "br_batch_id": F.lit(batch_id),
            "br_is_current": F.lit(True),
            "br_record_hash": record_hash(business, plain_columns(df), nested_columns(df)),
        }
    )
    if random_key:
        landed = landed.withColumn(f"br_{table}_key", random_uuid())
    return as_text(landed, business) if text else landed


def business_columns(df: DataFrame) -> list[str]:
    """All columns but the audit columns, by their exact names."""
    added = {*BRONZE_FILE_COLUMNS, *BRONZE_TABLE_COLUMNS}
    return [c for c in df.columns if c not in added]


def plain_columns(df: DataFrame) -> list[str]:
    """Columns whose text cannot hold a bar or a backslash."""
    plain = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)
    return [f.name for f in df.schema if isinstance(f.dataType, plain)]


def nested_columns(df: DataFrame) -> list[str]:
    """Columns that hold arrays, maps or structs, whose plain text is ambiguous."""
    return [f.name for f in df.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))]


def as_text(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    chosen = set(business_columns(df) if columns is None else columns)
    return df.select([F.col(c).cast("string").alias(c) if c in chosen else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- hashes and keys


def record_hash(
    columns: Sequence[Column | str], plain: Iterable[str] = (), nested: Iterable[str] = ()
) -> Column:
    r"""md5 over the columns, in the order given, joined by ``|``.

    A null is written ``\N`` and a backslash or bar inside a value is escaped, so rows that differ only in
    where a null or a bar stands never share a hash. Rows without any of these hash as the plain joined text.
    ``plain`` names columns whose text holds neither, such as numbers and times: they skip the escaping.
    ``nested`` names arrays, maps and structs: they are written as JSON, nulls included, which tells
    ``["a, b"]`` from ``["a", "b"]`` and a null from the word.
    """
    unescaped, structured = set(plain), set(nested)
    parts = []
    for column in columns:
        text = _col(column).cast("string")
        if isinstance(column, str) and column in structured:
            text = F.to_json(_col(column), {"ignoreNullFields": "false"})
        if isinstance(column, str) and column in unescaped:
            parts.append(F.coalesce(text, F.lit("\\N")))
            continue
        escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        parts.append(F.coalesce(escaped, F.lit("\\N")))
    return F.md5(F.concat_ws("|", *parts))


def random_uuid() -> Column:
    """A random key. It is drawn anew whenever the plan runs: write it before using it twice."""
    return F.uuid()


def stable_uuid(*columns: Column | str) -> Column:
    """The md5 of the natural key laid out as a uuid: the same key on every run and every executor."""
    digest = F.md5(_col(columns[0]).cast("string")) if len(columns) == 1 else record_hash(columns)
    return F.regexp_replace(digest, UUID_PARTS, UUID_LAYOUT)


def stable_uuid_sql(column: str) -> str:
    """:func:`stable_uuid` of one column as SQL text."""
    return f"regexp_replace(md5(CAST({column} AS STRING)), '{UUID_PARTS}', '{UUID_LAYOUT}')"


# ---------------------------------------------------------------- casts


class Field(NamedTuple):
    """One target column: source column, type, and for texts the length to cut or pad to."""

    source: str
    type: str = "string"
    length: int | None = None
    name: str | None = None
    pad: bool = False

    @property
    def target(self) -> str:
        return self.name or self.source


def quoted(name: str) -> str:
    """A column name as SQL text, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def typed_sql(column: str, type_: str, *, strict: bool = False) -> str:
    """Cast a landed column; a value that does not fit becomes null, or fails the job if ``strict``."""
    column = value = quoted(column)
    if type_ == "boolean":
        # The words "on" and "off" are booleans in the source databases but not in Spark.
        text = f"CAST({column} AS string)"
        value = f"CASE lower(trim({text})) WHEN 'on' THEN 'true' WHEN 'off' THEN 'false' ELSE {text} END"
    if strict:
        return f"CAST({value} AS {type_})"
    cast = f"TRY_CAST({value} AS {type_})"
    if type_ in ("date", "timestamp", "timestamp_ntz"):
        # Spark reads a bare number in a text as a year; one of five or more digits is no time.
        number = f"typeof({column}) = 'string' AND CAST({column} AS string) RLIKE '^ *[+-]?[0-9]{{5,}}'"
        return f"CASE WHEN NOT coalesce({number}, false) THEN {cast} END"
    return cast


def typed(column: str, type_: str, *, strict: bool = False) -> Column:
    return F.expr(typed_sql(column, type_, strict=strict))


def conform_sql(field: Field, *, strict: bool = False) -> str:
    """The value a field describes. Spark's varchar and char casts neither cut nor pad, so do it here."""
    if field.type != "string":
        return typed_sql(field.source, field.type, strict=strict)
    text = f"CAST({quoted(field.source)} AS string)"
    if field.length is not None:
        text = f"left({text}, {field.length})"
        if field.pad:
            text = f"rpad({text}, {field.length}, ' ')"
    return text


def conform(field: Field, *, strict: bool = False) -> Column:
    return F.expr(conform_sql(field, strict=strict)).alias(field.target)


def conform_all(df: DataFrame, fields: Sequence[Field], *, strict: bool = False) -> DataFrame:
    return df.select(*[conform(f, strict=strict) for f in fields])


def lost_in_cast(field: Field) -> Column:
    """True where a value is present but its cast is not, or where a text is cut."""
    if field.type == "string":
        return F.lit(False) if field.length is None else F.length(F.expr(f"CAST({quoted(field.source)} AS string)")) > field.length
    return F.col(quoted(field.source)).isNotNull() & typed(field.source, field.type).isNull()


def full_name_sql(first: str, last: str) -> str:
    """Null if either part is: ``concat`` passes nulls on, ``concat_ws`` would skip them."""
    return f"concat({first}, ' ', {last})"


# ---------------------------------------------------------------- table kinds


def stamp_reference(df: DataFrame, now: datetime | str | None = None) -> DataFrame:
    """Reference rows start active, which is a null ``inactivated_date``."""
    return df.withColumns({"inactivated_date": F.lit(None).cast("timestamp_ntz"), "systime": clock(now)})


def stamp_transactional(df: DataFrame, now: datetime | str | None = None) -> DataFrame:
    return df.withColumns({"systime": clock(now), "created_at": clock(now), "updated_at": clock(now)})


def touch_transactional(df: DataFrame, now: datetime | str | None = None) -> DataFrame:
    """Mark rows as changed: ``created_at`` stays, the other two move."""
    return df.withColumns({"systime": clock(now), "updated_at": clock(now)})


def stamp_temporal(
    df: DataFrame, now: datetime | str | None = None, effective_time: Column | None = None
) -> DataFrame:
    moment = clock(now) if effective_time is None else F.coalesce(effective_time, clock(now))
    return df.withColumns({"effective_time": moment, "systime": clock(now)})


def tracked_columns(columns: Iterable[str], exclude: Iterable[str] = ()) -> list[str]:
    """Columns whose changes are kept: all but clocks, derived columns and the caller's exclusions."""
    dropped = {*UNTRACKED_COLUMNS, *exclude}
    return [c for c in columns if c not in dropped and not c.endswith(tuple(UNTRACKED_SUFFIXES))]


# ---------------------------------------------------------------- times


def hours_sql(start: str, end: str) -> str:
    return f"timestampdiff(MICROSECOND, {start}, {end}) / 3.6e9D"


def weekend_sql(moment: str) -> str:
    """Sunday is 1 and Saturday 7 in Spark; the source databases count Sunday as 0."""
    return f"dayofweek({moment}) IN (1, 7)"


def money(column: Column | str, type_: str = "decimal(18,2)") -> Column:
    """Amounts are decimals before they are summed, hashed or shown: sums of doubles depend on row order."""
    return _col(column).cast(type_)


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
