"""Bronze to gold in order, stopping at failed checks, for one warehouse or several."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import partial

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from orelayer.functions.columns import stamp_batch
from orelayer.operators import gold, quality, silver
from orelayer.sources.sinks import LOG_SCHEMA, append_log, log_entries, read_batch, write_batch

BUILD_SCHEMA = "tenant string, layer string, table_name string, row_count bigint"
# So many tables are written side by side: one table's last tasks, and tables of a task or two, leave no cores idle.
SIDE_BY_SIDE = 4


def together(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """Run jobs that do not need each other side by side, started in the order given; their results in that order.

    Jobs that have not begun when one fails are not begun; the error of the first failed one in order is raised once the others have ended.
    """
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        try:
            return [job.result() for job in running]
        except BaseException:
            pool.shutdown(wait=True, cancel_futures=True)
            raise


def land(
    tables: Mapping[str, DataFrame],
    root: str,
    batch_id: str,
    load_time: datetime | str,
    schema: str = "staging",
    text: bool = True,
) -> dict[str, int]:
    """Land source tables as ``br_<table>``, side by side; one pass per table stamps, hashes, writes and counts it."""

    def one(name: str) -> int:
        return write_batch(stamp_batch(tables[name], name, batch_id, load_time, text=text), root, schema, f"br_{name}", batch_id)

    if not tables:
        return {}
    spark = next(iter(tables.values())).sparkSession
    return dict(zip(tables, together(spark, *[partial(one, name) for name in tables])))


def land_logged(
    spark: SparkSession,
    tables: Mapping[str, DataFrame | Callable[[], DataFrame]],
    root: str,
    batch_id: str,
    load_time: datetime | str,
    run_id: str,
    schema: str = "staging",
    text: bool = True,
) -> DataFrame:
    """Land tables one by one and append a log line for each, whatever becomes of it; returns the log of the run.

    Row counts are those observed while writing. A table that cannot be read or written is logged as ``failed`` without a
    count, and the run goes on with the next one.
    """
    lines = []
    for name, source in tables.items():
        try:
            df = source() if callable(source) else source
            rows = land({name: df}, root, batch_id, load_time, schema, text)[name]
            lines.append((name, rows, "success"))
        except (PySparkException, ValueError):
            lines.append((name, None, "failed"))
    summary = spark.createDataFrame(lines, "source_table string, row_count bigint, status string")
    entries = log_entries(summary, schema, load_time, run_id).drop("status").join(summary.select("source_table", "status"), "source_table")
    append_log(entries, f"{root}/log")
    return spark.read.parquet(f"{root}/log").where(F.col("run_id") == run_id)


class Warehouse:
    """The layers of one warehouse under a folder, one batch at a time."""

    def __init__(self, spark: SparkSession, root: str, batch_id: str, now: datetime | str):
        self.spark, self.root, self.batch_id, self.now = spark, root, batch_id, now
        self.written: list[tuple[str, str, int]] = []

    def bronze(self, name: str) -> DataFrame:
        return read_batch(self.spark, self.root, "staging", f"br_{name}", self.batch_id)

    def read(self, schema: str, name: str) -> DataFrame:
        return read_batch(self.spark, self.root, schema, name, self.batch_id)

    def rows(self, schema: str, name: str) -> int:
        """How many rows were written, as counted while writing."""
        return next(n for s, t, n in reversed(self.written) if (s, t) == (schema, name))

    def put(self, schema: str, name: str, df: DataFrame) -> DataFrame:
        """Write a table of a layer and go on from what was written."""
        return self.put_all(schema, {name: lambda: df})[0]

    def put_all(self, schema: str, tables: Mapping[str, Callable[[], DataFrame]]) -> list[DataFrame]:
        """As :meth:`put`, for tables of a layer that are not made from each other: they are written side by side."""

        def write(name: str) -> int:
            return write_batch(tables[name](), self.root, schema, name, self.batch_id)

        counts = together(self.spark, *[partial(write, name) for name in tables])
        self.written += [(schema, name, rows) for name, rows in zip(tables, counts)]
        return [self.read(schema, name) for name in tables]

    def land(self, tables: Mapping[str, DataFrame], text: bool = True) -> None:
        for name, rows in land(tables, self.root, self.batch_id, self.now, text=text).items():
            self.written.append(("staging", f"br_{name}", rows))

    def log(self, run_id: str) -> DataFrame:
        """Log rows of everything written so far."""
        rows = [(name, schema, n, run_id) for schema, name, n in self.written]
        frame = self.spark.createDataFrame(rows, "source_table string, target_schema string, row_count bigint, run_id string")
        moment = F.lit(str(self.now)).cast("timestamp_ntz")
        names = [part.split()[0] for part in LOG_SCHEMA.split(", ")]
        return frame.withColumns({"ingestion_time": moment, "status": F.lit("success")}).select(*names)


def build(warehouse: Warehouse, sources: Mapping[str, DataFrame], as_of: str) -> Warehouse:
    """All layers from complete rental sources."""
    w, now = warehouse, warehouse.now
    w.land(sources)

    copies = w.rows("staging", "br_inventory")
    bronze = [w.bronze(name) for name in ("rental", "inventory", "payment")]
    inventory, rentals = w.put_all("silver", {
        "sl_inventory": lambda: silver.sl_inventory(w.bronze("inventory"), now),
        "sl_rental_enriched": lambda: silver.sl_rental_enriched(*bronze, now, inventory_rows=copies),
    })
    film, language, customer, staff = w.put_all("silver", {
        "sl_film": lambda: silver.sl_film(w.bronze("film"), now, silver.film_metrics(rentals)),
        "sl_language": lambda: silver.sl_language(w.bronze("language"), now),
        "sl_customer": lambda: silver.sl_customer(w.bronze("customer"), now),
        "sl_staff": lambda: silver.sl_staff(w.bronze("staff"), now),
    })
    put = partial(w.put, "silver")
    store = put("sl_store", silver.sl_store(w.bronze("store"), now, silver.store_metrics(rentals, film, w.rows("silver", "sl_film"))))
    address = put("sl_address", silver.sl_address(w.bronze("address"), now, silver.address_counters(customer, store)))
    checks = silver_checks(
        language=language, address=address, store=store, film=film, customer=customer, staff=staff,
        inventory=inventory, rentals=rentals,
    )
    quality.require(checks, "silver")

    # Staff come after, with all payments: the small tables that the others broadcast would wait for cores behind those.
    d_film, d_store = w.put_all("gold", {
        "dim_film": lambda: gold.dim_film(film, language),
        "dim_store": lambda: gold.dim_store(store, address),
    })
    d_staff, d_date = w.put_all("gold", {
        "dim_staff": lambda: gold.dim_staff(staff, store, address, now, silver.staff_metrics(rentals, w.bronze("payment"))),
        "dim_date": lambda: gold.calendar(gold.date_bounds(rentals, "rental_date", "return_date"), as_of),
    })
    quality.require(dimension_checks(d_film, d_store, d_staff, d_date), "gold dimensions")

    put = partial(w.put, "gold")
    sizes = {name: w.rows("gold", f"dim_{name}") for name in ("film", "store", "staff")}
    facts = put("fact_rental", gold.fact_rental(rentals, d_film, d_store, d_staff, d_date, now, sizes))
    quality.require(fact_checks(facts, d_film), "gold facts")
    return w


def _keyed(df: DataFrame, table: str, *keys: str, filled: Sequence[str] = ()) -> list[DataFrame]:
    """Row checks in one pass over the table, then a count per key."""
    row_checks = quality.not_null(*keys, *filled)
    return [quality.check_rows(df, table, row_checks), *[quality.check_unique(df, table, k) for k in keys]]


def silver_checks(
    language: DataFrame,
    address: DataFrame,
    store: DataFrame,
    film: DataFrame,
    customer: DataFrame,
    staff: DataFrame,
    inventory: DataFrame,
    rentals: DataFrame,
) -> DataFrame:
    """The checks silver models are declared with."""
    checks = [
        *_keyed(language, "sl_language", "language_id"),
        *_keyed(address, "sl_address", "address_id"),
        *_keyed(store, "sl_store", "store_id"),
        *_keyed(film, "sl_film", "film_id"),
        *_keyed(customer, "sl_customer", "customer_id", filled=["email"]),
        *_keyed(staff, "sl_staff", "staff_id"),
        *_keyed(inventory, "sl_inventory", "inventory_id"),
        *_keyed(rentals, "sl_rental_enriched", "rental_id"),
        quality.check_relationship(rentals, "sl_rental_enriched", "film_id", film, "film_id"),
        quality.check_relationship(rentals, "sl_rental_enriched", "store_id", store, "store_id"),
        quality.check_relationship(rentals, "sl_rental_enriched", "staff_id", staff, "staff_id"),
    ]
    return quality.report(*checks)


def dimension_checks(d_film: DataFrame, d_store: DataFrame, d_staff: DataFrame, d_date: DataFrame) -> DataFrame:
    return quality.report(
        *_keyed(d_film, "dim_film", "film_id"),
        *_keyed(d_store, "dim_store", "store_id"),
        *_keyed(d_staff, "dim_staff", "staff_id"),
        *_keyed(d_date, "dim_date", "date_key"),
    )


def fact_checks(facts: DataFrame, d_film: DataFrame) -> DataFrame:
    return quality.report(
        *_keyed(facts, "fact_rental", "gl_fact_rental_key"),
        quality.check_relationship(facts, "fact_rental", "film_key", d_film, "gl_dim_film_key"),
    )


def land_tenants(
    spark: SparkSession,
    specs: Sequence[Mapping],
    sources: Mapping[str, Mapping[str, DataFrame]],
    root: str,
    batch_id: str,
    now: datetime | str,
) -> DataFrame:
    """Land the tables each spec lists, from the tenant's own source, into its own warehouse; returns rows written."""
    lines = []
    for spec in specs:
        name = spec["warehouse"]["name"]
        wanted = {job["table"]: sources[name][job["table"]] for job in spec["warehouse"].get("bronze_jobs", [])}
        warehouse = Warehouse(spark, f"{root}/{name}", batch_id, now)
        warehouse.land(wanted)
        lines += [(name, *line) for line in warehouse.written]
    return spark.createDataFrame(lines, BUILD_SCHEMA)


def build_tenants(
    spark: SparkSession,
    specs: Sequence[Mapping],
    sources: Mapping[str, Mapping[str, DataFrame]],
    root: str,
    batch_id: str,
    now: datetime | str,
    as_of: str,
) -> DataFrame:
    """All layers per tenant, from the tenant's own source, which must have every table the models need."""
    lines = []
    for spec in specs:
        name = spec["warehouse"]["name"]
        warehouse = build(Warehouse(spark, f"{root}/{name}", batch_id, now), sources[name], as_of)
        lines += [(name, *line) for line in warehouse.written]
    return spark.createDataFrame(lines, BUILD_SCHEMA)
