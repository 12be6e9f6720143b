"""Ranges of a key that hold about equally many rows, for scans whose key is far from even.

Bounds of equal width give one task a busy stretch of the key. Here a bounded sample of the key, spread by a hash over the whole table, gives
the bounds of an equi-depth histogram, where need be between rows of one value by a second column. The ranges are predicates that
divide all rows, nulls included, whatever the sample looked like: a poor sample makes them uneven, never wrong.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 200_000


@dataclass(frozen=True)
class Range:
    """A predicate as SQL text, which a database understands too, and the rows it is expected to hold."""

    predicate: str
    rows: float


def literal(value: object) -> str:
    """A value as SQL text."""
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value}'"
    if isinstance(value, date):
        return f"DATE '{value}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "''") + "'"


def _from(columns: Sequence[str], bound: tuple) -> str:
    """Rows at or after a bound, in order of one column or of two."""
    first = literal(bound[0])
    if len(bound) == 1:
        return f"{columns[0]} >= {first}"
    return f"({columns[0]} > {first} OR ({columns[0]} = {first} AND {columns[1]} >= {literal(bound[1])}))"


def _before(columns: Sequence[str], bound: tuple) -> str:
    """All other rows: nulls come before every value."""
    first = literal(bound[0])
    if len(bound) == 1:
        return f"({columns[0]} < {first} OR {columns[0]} IS NULL)"
    inner = f"({columns[1]} < {literal(bound[1])} OR {columns[1]} IS NULL)"
    return f"({columns[0]} < {first} OR {columns[0]} IS NULL OR ({columns[0]} = {first} AND {inner}))"


def even_ranges(df: DataFrame, key: str, count: int, *, then: str | None = None, rows: int | None = None, sample: int = SAMPLE) -> list[Range]:
    """About ``count`` ranges of ``key`` with about equally many rows, from about ``sample`` rows of one pass.

    With the column ``then`` a bound may fall between rows of one value, so that a busy value is divided. ``rows`` spares counting
    the table. The driver gets the sample's keys. Give the predicates to :func:`orelayer.sources.readers.read_jdbc`.
    """
    total = df.count() if rows is None else rows
    columns = [key] if then is None else [key, then]
    drawn = df.select(*columns)
    if total > sample:
        drawn = drawn.sample(sample / total, seed=7)
    values = [tuple(r) for r in drawn.collect()] if total else []
    if not values:
        return [Range("TRUE", float(total))]
    values.sort(key=lambda r: [(v is not None, v) if v is not None else (False,) for v in r])
    bounds = []
    for i in range(1, count):
        bound = values[i * len(values) // count]
        if bound[0] is None:
            continue
        bound = bound[: 2 if len(bound) > 1 and bound[1] is not None else 1]
        if bound not in bounds:
            bounds.append(bound)
    ends = [None, *bounds, None]
    share = total / (len(bounds) + 1)
    found = []
    for low, high in zip(ends[:-1], ends[1:]):
        texts = ([_from(columns, low)] if low else []) + ([_before(columns, high)] if high else [])
        found.append(Range(" AND ".join(texts) or "TRUE", share))
    return found


def range_of(ranges: Sequence[Range]) -> Column:
    """The number of the range that a row lies in."""
    found = F.lit(None).cast("int")
    for n, r in reversed(list(enumerate(ranges))):
        found = F.when(F.expr(r.predicate), n).otherwise(found)
    return found


def sizes(df: DataFrame, ranges: Sequence[Range]) -> Counter:
    """The rows that each range really has."""
    return Counter({r.range: r.n for r in df.groupBy(range_of(ranges).alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()})
