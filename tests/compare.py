"""Run registered queries in Spark and DuckDB and compare names, types, row counts and values."""

from __future__ import annotations

import sys
import time

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(table: pa.Table) -> pa.Table:
    """Columns by name, with one spelling of each type."""

    def type_of(t: pa.DataType) -> pa.DataType:
        if pa.types.is_large_string(t) or pa.types.is_string_view(t):
            return pa.string()
        return t

    table = table.select(sorted(table.column_names))
    return table.cast(pa.schema([pa.field(f.name, type_of(f.type)) for f in table.schema]))


def rows(table: pa.Table) -> list[tuple]:
    return sorted(zip(*[c.to_pylist() for c in table.columns]), key=lambda r: [(v is not None, str(v)) for v in r])


def differences(spark_table: pa.Table, sql_table: pa.Table) -> list[str]:
    left, right = plain(spark_table), plain(sql_table)
    if left.column_names != right.column_names:
        return [f"columns {left.column_names} != {right.column_names}"]
    found = [
        f"type of {a.name}: {a.type} != {b.type}" for a, b in zip(left.schema, right.schema) if a.type != b.type
    ]
    if left.num_rows != right.num_rows:
        return [*found, f"rows {left.num_rows} != {right.num_rows}"]
    for a, b in zip(rows(left), rows(right)):
        if a != b:
            wrong = {n: (x, y) for n, x, y in zip(left.column_names, a, b) if x != y}
            return [*found, f"first difference {wrong}"]
    return found


def main(folder: str, names: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries
    from orelayer.session import local_session

    spark = local_session(8)
    con = database(folder)
    bad = 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = run(spark, folder).toArrow()
            spent = time.time() - start
            sql = oracle_sql().get(name)
            problems = differences(got, con.sql(sql).to_arrow_table()) if sql else ["no SQL"]
            print(f"{'ok ' if not problems else 'BAD'} {name} rows={got.num_rows} {spent:.2f}s {'; '.join(problems)}", flush=True)
            bad += bool(problems)
        except Exception as error:
            bad += 1
            print(f"BAD {name} {type(error).__name__} {str(error)[:600]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
