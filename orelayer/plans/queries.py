"""The registered queries: operators bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelayer.functions import columns as C
from orelayer.functions import skew
from orelayer.operators import digests, frames, gold, history, keyed, maintained, quality, silver, sketches, synth, version_store
from orelayer.plans import build
from orelayer.plans.bindings import Source, accounts_after, accounts_before
from orelayer.session import shared_dir, written
from orelayer.sources import bulk, ranges, readers, sinks
from orelayer.streaming import changes, corrections, landing, repeats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = "2025-01-01 00:00:00"
TODAY = "2000-01-01"
MARK = "2000-06-30 00:00:00"
BATCH = "batch-1"
STARS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
LINE_AMOUNTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EVENT_KEYS, EVENT_STATE, EVENT_ORDER = ["user_id"], ["event_type"], ["ts", "event_id"]
# Two tenants that share the catalogue and have the rentals of odd and of even numbers; each lands all that models need.
RENTAL_TABLES = ["language", "address", "store", "film", "customer", "staff", "inventory", "rental", "payment"]
TENANTS = [{"warehouse": {"name": n, "bronze_jobs": [{"table": t} for t in RENTAL_TABLES]}} for n in ("even_rentals", "odd_rentals")]


def query(fn: Callable[[Source], DataFrame]) -> Query:
    """Register a function of the given tables under its own name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(Source(spark, folder))

    QUERIES[fn.__name__] = run
    return run


def money_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: C.money(c) for c in columns})


# ---------------------------------------------------------------- silver


def landed(source: Source, name: str) -> DataFrame:
    """A source table as staging holds it: stamped, hashed, every business column text."""
    return C.stamp_batch(getattr(source, name)(), name, BATCH, NOW)


def stored_if(large: bool, df: DataFrame, purpose: str) -> DataFrame:
    """Salted lookups read the keys of the facts once more, so facts that need them are stored first."""
    return written(df, purpose) if large else df


@query
def sl_language(source):
    return silver.sl_language(landed(source, "language"), NOW)


@query
def sl_address(source):
    counters = silver.address_counters(source.customer(), source.store())
    return silver.sl_address(landed(source, "address"), NOW, counters)


@query
def sl_store(source):
    metrics = metrics_of_stores(source)
    return silver.sl_store(landed(source, "store"), NOW, metrics)


@query
def sl_film(source):
    return silver.sl_film(landed(source, "film"), NOW, silver.film_metrics(enriched(source)))


@query
def sl_customer(source):
    return silver.sl_customer(landed(source, "customer"), NOW)


@query
def sl_staff(source):
    return silver.sl_staff(landed(source, "staff"), NOW)


@query
def sl_inventory(source):
    return silver.sl_inventory(landed(source, "inventory"), NOW)


def enriched(source: Source) -> DataFrame:
    """Rentals with film, store and payments. There are at most as many copies as parts, counted from footers; beyond the
    bound of a broadcast the rentals are stored before they are looked up."""
    copies = source.rows("part")
    rental = stored_if(copies > skew.SMALL, source.rental(), "rental")
    return silver.sl_rental_enriched(rental, source.inventory(), source.paid(), NOW, inventory_rows=copies)


@query
def sl_rental_enriched(source):
    return enriched(source)


def metrics_of_stores(source: Source) -> DataFrame:
    films = source.rows("part")
    rentals = stored_if(films > skew.SMALL, enriched(source), "rentals")
    return silver.store_metrics(rentals, source.film(), films)


@query
def film_metrics(source):
    return silver.film_metrics(enriched(source))


@query
def store_metrics(source):
    return metrics_of_stores(source)


@query
def address_counters(source):
    return silver.address_counters(source.customer(), source.store())


@query
def staff_metrics(source):
    return silver.staff_metrics(source.rental(), source.payment())


# ---------------------------------------------------------------- gold


@query
def dim_film(source):
    film = silver.sl_film(source.film(), NOW, silver.film_metrics(enriched(source)))
    return gold.dim_film(film, silver.sl_language(source.language(), NOW))


@query
def dim_store(source):
    store = silver.sl_store(source.store(), NOW, metrics_of_stores(source))
    return gold.dim_store(store, silver.sl_address(source.address(), NOW))


@query
def dim_staff(source):
    return gold.dim_staff(
        silver.sl_staff(source.staff(), NOW),
        silver.sl_store(source.store(), NOW),
        silver.sl_address(source.address(), NOW),
        NOW,
        silver.staff_metrics(source.rental(), source.payment()),
    )


def order_days(source: Source) -> DataFrame:
    """Days from the first order to the last shipment."""
    orders = source.given("orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    lines = source.given("lineitem").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    return gold.date_bounds(orders.unionByName(lines), "a", "b")


@query
def dim_date(source):
    return gold.calendar(order_days(source), TODAY)


def facts(source: Source, rentals: DataFrame | None = None) -> DataFrame:
    """The fact, from rentals that are stored already or are stored here."""
    film = silver.sl_film(source.film(), NOW)
    store = silver.sl_store(source.store(), NOW)
    address = silver.sl_address(source.address(), NOW)
    sizes = {"film": source.rows("part"), "store": source.rows("nation"), "staff": source.rows("supplier")}
    # Stored: the calendar takes its first and last day from the rentals before the rentals look up their days.
    rentals = written(enriched(source), "rentals") if rentals is None else rentals
    return gold.fact_rental(
        rentals,
        gold.dim_film(film, silver.sl_language(source.language(), NOW)),
        gold.dim_store(store, address),
        gold.dim_staff(silver.sl_staff(source.staff(), NOW), store, address, NOW),
        gold.calendar(gold.date_bounds(rentals, "rental_date", "return_date"), TODAY),
        NOW,
        sizes,
    )


@query
def fact_rental(source):
    return facts(source)


@query
def fact_rollup(source):
    return gold.rental_rollup(facts(source))


@query
def rentals_by_hour(source):
    return gold.rentals_by_hour(facts(source))


@query
def overdue_returns(source):
    customers = source.rows("customer")
    rental = stored_if(customers > skew.SMALL, source.rental(), "rental")
    return gold.overdue_returns(source.customer(), rental, TODAY, customers)


@query
def top_films_by_revenue(source):
    revenue = gold.revenue_by_film(source.film(), source.inventory(), source.rental(), source.paid())
    return frames.top_by(revenue, "total_revenue", "film_id", 10)


@query
def customer_value(source):
    value = gold.customer_value(source.customer(), source.rental(), source.paid())
    return value.orderBy(F.desc_nulls_last("lifetime_value"), "customer_id")


@query
def film_language_check(source):
    """Join a dimension back to its silver table and show the first few."""
    film = silver.sl_film(source.film(), NOW)
    dim = gold.dim_film(film, silver.sl_language(source.language(), NOW))
    joined = film.select("film_id", "title").join(dim.select("film_id", "language_name"), "film_id")
    return joined.orderBy("film_id").limit(5)


@query
def facts_without_film(source):
    """Fact rows whose film key is not in the dimension, null keys included."""
    films = gold.dim_film(silver.sl_film(source.film(), NOW), silver.sl_language(source.language(), NOW))
    return quality.check_orphans(facts(source), "fact_rental", "film_key", films, "gl_dim_film_key")


@query
def mean_by_category(source):
    return frames.mean_by(source.given("events"), "event_type", "value", "mean_value")


@query
def sums_by_category(source):
    lines = money_columns(source.given("lineitem"), *LINE_AMOUNTS)
    sums = frames.sums_by(lines, "l_returnflag")
    return sums.select("l_returnflag", *[F.col(c).cast(C.TOTAL).alias(c) for c in sums.columns[1:]])


@query
def customers_of_orders(source):
    """Orders with their customer, safe where one customer has much of the orders."""
    orders = source.given("orders").select(
        "o_orderkey", F.col("o_custkey").alias("custkey"), C.money("o_totalprice").alias("total")
    )
    customers = source.given("customer").select(F.col("c_custkey").alias("custkey"), "c_name", "c_mktsegment")
    return skew.salted_lookup(orders, customers, ["custkey"], ["o_orderkey"], floor=10, share=1000)


# ---------------------------------------------------------------- bronze


@query
def bronze_stamp(source):
    orders = money_columns(source.given("orders"), "o_totalprice")
    return C.stamp_source(orders, "shop", "orders", "db.example.com", load_time=NOW)


@query
def bronze_batch(source):
    return C.stamp_batch(money_columns(source.given("orders"), "o_totalprice"), "orders", BATCH, NOW)


@query
def record_hash(source):
    customers = money_columns(source.given("customer"), "c_acctbal").withColumn(
        "c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))
    )
    return customers.select("c_custkey", C.record_hash(customers.columns, C.plain_columns(customers)).alias("br_record_hash"))


@query
def document_hash(source):
    documents = source.given("documents")
    return documents.select("doc_id", C.record_hash(documents.columns, C.plain_columns(documents)).alias("br_record_hash"))


@query
def surrogate_keys(source):
    return source.given("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").withColumns(
        {"order_key": C.stable_uuid("l_orderkey"), "line_key": C.stable_uuid("l_orderkey", "l_linenumber", "l_partkey")}
    )


@query
def filtered_scan(source):
    lines = money_columns(source.given("lineitem"), *LINE_AMOUNTS)
    ordered = lines.orderBy("l_orderkey", "l_linenumber", *[c for c in lines.columns if c not in ("l_orderkey", "l_linenumber")])
    return readers.extract(ordered, "l_shipdate >= timestamp_ntz'2000-01-01' AND l_suppkey = 1", 100)


@query
def equality_filter(source):
    orders = money_columns(source.given("orders"), "o_totalprice")
    return readers.extract(orders, F.col("o_orderstatus") == "F")


@query
def top_rows(source):
    """The first 1000 orders by key."""
    orders = money_columns(source.given("orders"), "o_totalprice")
    return readers.extract(orders.orderBy("o_orderkey"), limit=1000)


@query
def incremental_scan(source):
    orders = money_columns(source.given("orders"), "o_totalprice")
    return readers.extract_incremental(
        orders, "o_orderdate", MARK, source_system="shop", source_table="orders", source_host="db.example.com", load_time=NOW
    )


@query
def next_marks(source):
    marks = [
        readers.next_mark(source.given("orders"), "o_orderdate", "orders"),
        readers.next_mark(source.given("lineitem"), "l_shipdate", "lineitem"),
        readers.next_mark(source.given("events"), "ts", "events"),
    ]
    return reduce(DataFrame.unionByName, marks)


@query
def scan_summaries(source):
    return reduce(DataFrame.unionByName, [readers.scan_summary(source.given(t), t) for t in STARS])


@query
def ingestion_log(source):
    """All tables are landed, one of which does not exist; the log of the run is read back."""
    root = shared_dir(source.spark, "landing")
    tables = {t: source.given(t) for t in STARS} | {"missing_table": lambda: source.given("missing_table")}
    return build.land_logged(source.spark, tables, root, BATCH, NOW, "run-1")


@query
def landed_match(source):
    """Every table is landed, and its landed rows are held against those of its source."""
    root = shared_dir(source.spark, "landing")
    tables = {t: source.given(t) for t in STARS}
    build.land(tables, root, BATCH, NOW)
    landed_rows = {t: sinks.read_batch(source.spark, root, "staging", f"br_{t}", BATCH) for t in STARS}
    return quality.report(*[quality.check_match(tables[t], landed_rows[t], t) for t in STARS])


@query
def mapped_load(source):
    """Customers are scanned, mapped to the party schema, written as a table of that layer and read back."""
    root = shared_dir(source.spark, "mapped")
    sinks.write_batch(parties(source)["sales"], root, "silver", "party", BATCH)
    return sinks.read_batch(source.spark, root, "silver", "party", BATCH)


@query
def latest_snapshot(source):
    """Two snapshots are written; the newest is read back."""
    root = shared_dir(source.spark, "snapshots")
    old, new = accounts_before(source), accounts_after(source)
    sinks.write_snapshot(old, root, "bank", "accounts", datetime(2025, 1, 1), ["parquet"])
    sinks.write_snapshot(new, root, "bank", "accounts", datetime(2025, 1, 2), ["parquet"])
    return readers.read_latest_snapshot(source.spark, root, "bank", "accounts")


@query
def json_round_trip(source):
    root = shared_dir(source.spark, "json")
    orders = C.stamp_source(money_columns(source.given("orders"), "o_totalprice"), "shop", "orders", "db", load_time=NOW)
    paths = sinks.write_snapshot(orders, root, "shop", "orders", datetime(2025, 1, 1), ["json"])
    return readers.read_json(source.spark, paths["json"], orders.schema)


@query
def csv_round_trip(source):
    path = f"{shared_dir(source.spark, 'csv')}/suppliers"
    suppliers = money_columns(source.given("supplier"), "s_acctbal")
    sinks.write_csv(suppliers, path)
    return readers.read_csv(source.spark, path, suppliers.schema)


@query
def partitioned_snapshot(source):
    root = shared_dir(source.spark, "partitions")
    orders = money_columns(source.given("orders"), "o_totalprice").withColumns(
        {"year": F.year("o_orderdate"), "month": F.month("o_orderdate")}
    )
    paths = sinks.write_snapshot(
        orders, root, "shop", "orders", datetime(2025, 1, 1), ["parquet"], ["year", "month"]
    )
    return source.spark.read.parquet(paths["parquet"]).select(*orders.columns)


def tenant_sources(source: Source) -> dict[str, dict[str, DataFrame]]:
    """The copies in stock, which all lines tell, are found once for both tenants."""
    tables = source.tables()
    tables["inventory"] = written(tables["inventory"], "inventory")
    own = lambda t, rest: tables[t].where(F.col("rental_id") % 2 == rest)
    return {
        spec["warehouse"]["name"]: {**tables, "rental": own("rental", rest), "payment": own("payment", rest)}
        for rest, spec in enumerate(TENANTS)
    }


@query
def tenant_run(source):
    root = shared_dir(source.spark, "tenants")
    return build.land_tenants(source.spark, TENANTS, tenant_sources(source), root, BATCH, NOW)


@query
def tenant_build(source):
    """All layers of both tenants, each from its own source; their facts are read back from gold."""
    root = shared_dir(source.spark, "tenants")
    build.build_tenants(source.spark, TENANTS, tenant_sources(source), root, BATCH, NOW, TODAY)
    names = [spec["warehouse"]["name"] for spec in TENANTS]
    built = [build.Warehouse(source.spark, f"{root}/{n}", BATCH, NOW).read("gold", "fact_rental") for n in names]
    return reduce(DataFrame.unionByName, [df.withColumn("tenant", F.lit(n)) for n, df in zip(names, built)])


@query
def warehouse_build(source):
    """All layers in order, gated by their checks; rows written per table."""
    root = shared_dir(source.spark, "warehouse")
    warehouse = build.Warehouse(source.spark, root, BATCH, NOW)
    built = build.build(warehouse, source.tables(), TODAY)
    return source.spark.createDataFrame(built.written, "layer string, table_name string, row_count bigint")


# ---------------------------------------------------------------- conform, stack, merge


PART_FIELDS = [
    C.Field("p_partkey", "bigint"),
    C.Field("p_name", length=8),
    C.Field("p_brand", length=12, pad=True),
    C.Field("p_type", "boolean"),
    C.Field("p_size", "smallint"),
    C.Field("p_retailprice", "decimal(4,2)"),
]


def parts_as_text(source: Source) -> DataFrame:
    return C.as_text(money_columns(source.given("part"), "p_retailprice"))


@query
def silver_cast(source):
    return C.conform_all(parts_as_text(source), PART_FIELDS)


@query
def cast_rejects(source):
    rejects = quality.failing(parts_as_text(source), quality.cast_checks(PART_FIELDS))
    return rejects.select("p_partkey", "p_type", "p_retailprice", F.concat_ws(",", "failed_checks").alias("failed_checks"))


def parties(source: Source) -> dict[str, DataFrame]:
    """Customers and suppliers mapped to one target schema, names in upper and addresses in lower case."""
    return {
        "sales": frames.map_columns(
            source.given("customer"),
            {
                "name": F.upper("c_name"),
                "email": F.lower(F.concat("c_name", F.lit("@SALES.example.com"))),
                "nation_id": "c_nationkey",
                "balance": C.money("c_acctbal"),
                "segment": "c_mktsegment",
            },
        ),
        "purchasing": frames.map_columns(
            source.given("supplier"),
            {
                "name": F.upper("s_name"),
                "email": F.lower(F.concat("s_name", F.lit("@BUYING.example.com"))),
                "nation_id": "s_nationkey",
                "balance": C.money("s_acctbal"),
            },
        ),
    }


@query
def party_stack(source):
    return frames.stack_sources(parties(source))


@query
def party_dedup(source):
    """One party per nation and sign of balance: purchasing before sales, then the largest balance."""
    stacked = frames.stack_sources(parties(source)).withColumn("in_credit", F.col("balance") >= 0)
    return frames.best_source_per_key(
        stacked, ["nation_id", "in_credit"], ["purchasing", "sales"], ["balance", "name"]
    )


@query
def upsert(source):
    """Customers with the total and day of their newest order put in, customers of no order unchanged."""
    current = source.given("customer").select(
        F.col("c_custkey").alias("custkey"),
        F.lit(None).cast("bigint").alias("last_order"),
        C.money("c_acctbal").alias("amount"),
    )
    orders = source.given("orders").select(
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderkey").alias("last_order"),
        C.money("o_totalprice").alias("amount"),
        "o_orderdate",
    )
    return frames.upsert(current, orders, ["custkey"], ["o_orderdate", "last_order"])


@query
def latest_order_per_customer(source):
    orders = money_columns(source.given("orders"), "o_totalprice")
    return skew.latest_per_key(orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


def suppliers(source: Source) -> DataFrame:
    """Suppliers as reference rows, those overdrawn soft-deleted."""
    rows = C.stamp_reference(source.given("supplier").select("s_suppkey", "s_name"), NOW)
    overdrawn = source.given("supplier").where("s_acctbal < 0").select("s_suppkey")
    return frames.soft_delete(rows, overdrawn, ["s_suppkey"], "2025-02-01 00:00:00")


@query
def soft_delete(source):
    return suppliers(source)


@query
def active_rows(source):
    return frames.active_rows(suppliers(source))


@query
def inactive_rows(source):
    return frames.inactive_rows(suppliers(source))


@query
def table_kinds(source):
    """Clocks of transactional rows after a change, and of temporal rows with their own effective time."""
    orders = money_columns(source.given("orders"), "o_totalprice")
    changed = C.touch_transactional(C.stamp_transactional(orders, NOW), "2025-02-01 00:00:00")
    return C.stamp_temporal(changed.drop("systime"), NOW, F.col("o_orderdate"))


# ---------------------------------------------------------------- quality


@query
def quality_report(source):
    t = source.given
    return quality.report(
        quality.check_rows(
            t("customer"),
            "customer",
            [*quality.not_null(*t("customer").columns), quality.accepted_values("c_mktsegment", ["AUTOMOBILE", "BUILDING", "HOUSEHOLD"])],
        ),
        quality.check_rows(
            t("orders"),
            "orders",
            [*quality.not_null(*t("orders").columns), quality.accepted_values("o_orderstatus", ["F", "O"])],
        ),
        quality.check_unique(t("customer"), "customer", "c_custkey"),
        quality.check_unique(t("orders"), "orders", "o_orderkey"),
        quality.check_unique(t("lineitem"), "lineitem", "l_orderkey", "l_linenumber"),
        quality.check_relationship(t("orders"), "orders", "o_custkey", t("customer"), "c_custkey"),
        quality.check_relationship(t("lineitem"), "lineitem", "l_orderkey", t("orders"), "o_orderkey"),
        quality.check_match(t("lineitem"), t("orders"), "lineitem"),
    )


@query
def model_checks(source):
    """The checks silver and gold models are declared with."""
    rentals, film = written(enriched(source), "rentals"), silver.sl_film(source.film(), NOW)
    fact = written(facts(source, rentals), "fact")
    store, address = silver.sl_store(source.store(), NOW), silver.sl_address(source.address(), NOW)
    staff, language = silver.sl_staff(source.staff(), NOW), silver.sl_language(source.language(), NOW)
    customer, inventory = silver.sl_customer(source.customer(), NOW), silver.sl_inventory(source.inventory(), NOW)
    d_film = gold.dim_film(film, language)
    return quality.report(
        build.silver_checks(language, address, store, film, customer, staff, inventory, rentals),
        build.dimension_checks(
            d_film,
            gold.dim_store(store, address),
            gold.dim_staff(staff, store, address, NOW),
            gold.calendar(order_days(source), TODAY),
        ),
        build.fact_checks(fact, d_film),
    )


@query
def row_count_check(source):
    counts = quality.row_counts({t: source.given(t) for t in STARS})
    expected = {"region": 5, "nation": 24, "orders": None, "lineitem": None, "missing_table": None}
    return quality.check_counts(counts, expected)


def shipped_lines(source: Source) -> DataFrame:
    """Lines whose order key is lost where the line was returned."""
    return source.given("lineitem").select(
        F.when(F.col("l_returnflag") != "R", F.col("l_orderkey")).alias("order_ref"), "l_linenumber", "l_partkey"
    )


@query
def orphan_lines(source):
    """Lines without a finished order, null references passed over (relationships) or counted (orphans)."""
    finished = source.given("orders").where("o_orderstatus = 'F'")
    lines = shipped_lines(source)
    return quality.report(
        quality.check_relationship(lines, "lines", "order_ref", finished, "o_orderkey"),
        quality.check_orphans(lines, "lines", "order_ref", finished, "o_orderkey"),
    )


@query
def orphan_rows(source):
    finished = source.given("orders").where("o_orderstatus = 'F'")
    return quality.orphan_rows(shipped_lines(source), "order_ref", finished, "o_orderkey")


@query
def bronze_check(source):
    """Landed rows with a method that is not known where the order is pending and no host where it is open."""
    stamped = C.stamp_source(source.given("orders"), "shop", "orders", "db", load_time=NOW)
    spoiled = stamped.withColumns(
        {
            "bronze_extraction_method": F.when(F.col("o_orderstatus") == "P", "guess").otherwise(
                F.col("bronze_extraction_method")
            ),
            "bronze_source_host": F.when(F.col("o_orderstatus") != "O", F.col("bronze_source_host")),
        }
    )
    return quality.check_rows(spoiled, "orders", quality.bronze_checks(spoiled.columns))


@query
def contract_check(source):
    declared = [*PART_FIELDS[:-1], C.Field("p_retailprice", "decimal(5,2)"), C.Field("p_container")]
    landed_parts = parts_as_text(source).withColumn("p_comment", F.lit("x"))
    return quality.check_contract(landed_parts, "part", declared)


@query
def quality_score(source):
    orders = source.given("orders")
    checks = [
        *quality.not_null("o_custkey"),
        quality.accepted_values("o_orderstatus", ["F", "O"]),
        quality.accepted_values("o_orderpriority", ["1-URGENT", "2-HIGH"]),
        quality.RowCheck("positive", "o_totalprice", F.col("o_totalprice") <= 100_000),
    ]
    return orders.select("o_orderkey", quality.quality_score(checks).alias("sl_data_quality_score"))


@query
def profile(source):
    return quality.profile(money_columns(source.given("orders"), "o_totalprice"), "orders", exact=True)


@query
def profile_one_pass(source):
    """The profile of one pass, without its estimate of distinct values."""
    return quality.profile(money_columns(source.given("orders"), "o_totalprice"), "orders").drop("distinct_count")


@query
def history_pair_check(source):
    """A history table that lacks one tracked column and holds one excluded column."""
    primary = accounts_before(source).schema
    kept = history.history_schema(primary)
    wrong = type(kept)([f for f in kept if f.name != "segment"]).add("holder_cache", "string")
    return quality.check_history_pair(source.spark, "accounts", primary, wrong)


# ---------------------------------------------------------------- history


def account_changes(source: Source) -> DataFrame:
    return history.snapshot_diff(accounts_before(source), accounts_after(source), ["account_id"], BATCH, NOW)


@query
def snapshot_diff(source):
    return account_changes(source)


@query
def apply_history(source):
    return history.apply_history(accounts_before(source), account_changes(source), ["account_id"])


@query
def history_append(source):
    """History rows written by effective date, twice for the same batch, and read back."""
    root = shared_dir(source.spark, "history")
    rows = event_history(source)
    for _ in range(2):
        sinks.append_history(rows, root, "history", "users", BATCH)
    return source.spark.read.parquet(sinks.layer_path(root, "history", "users")).drop("batch_id")


def busy_users(source: Source) -> DataFrame | bool:
    return skew.known_busy_keys(source.given("events"), EVENT_KEYS, EVENT_ORDER[0])


def event_history(source: Source, busy: DataFrame | bool | None = None) -> DataFrame:
    """User history from events. ``busy`` is counted first where the caller has not done it."""
    busy = busy_users(source) if busy is None else busy
    return history.history_from_changes(
        source.given("events"), EVENT_KEYS, EVENT_STATE, EVENT_ORDER, NOW, busy=busy
    )


@query
def history_from_events(source):
    return event_history(source)


@query
def history_with_deletes(source):
    """An error ends a user; the next event starts the user anew."""
    return history.history_from_changes(
        source.given("events"),
        EVENT_KEYS,
        EVENT_STATE,
        EVENT_ORDER,
        NOW,
        deleted=F.col("event_type") == "error",
        busy=busy_users(source),
    )


def stored_history(source: Source, **cut: int) -> tuple[DataFrame, DataFrame | bool]:
    """User history and its busy users. Work on busy users reads the history twice, so then it is stored."""
    busy = skew.known_busy_keys(source.given("events"), EVENT_KEYS, EVENT_ORDER[0], **cut)
    return stored_if(busy is not False, event_history(source, busy), "history"), busy


@query
def scd2_from_events(source):
    rows, busy = stored_history(source)
    return history.versions(rows, EVENT_KEYS, busy=busy)


@query
def scd2_busy_users(source):
    """As scd2_from_events, with limits so low that most users are cut into pieces."""
    rows, busy = stored_history(source, floor=5, share=1000)
    return history.versions(rows, EVENT_KEYS, busy=busy)


@query
def as_of_read(source):
    rows, busy = stored_history(source)
    return history.as_of(history.versions(rows, EVENT_KEYS, busy=busy), "2024-01-15 12:00:00")


@query
def as_of_lookup(source):
    """The state each user was in an hour before each event."""
    rows, busy = stored_history(source)
    probes = source.given("events").select(
        "event_id", "user_id", F.timestamp_add("HOUR", F.lit(-1), F.col("ts")).alias("asked_at")
    )
    return history.as_of_lookup(probes, "asked_at", rows, EVENT_KEYS, busy=busy)


@query
def as_of_lookup_busy_users(source):
    """As as_of_lookup, with most users cut into pieces."""
    rows, busy = stored_history(source, floor=5, share=1000)
    probes = source.given("events").select(
        "event_id", "user_id", F.timestamp_add("HOUR", F.lit(-1), F.col("ts")).alias("asked_at")
    )
    return history.as_of_lookup(probes, "asked_at", rows, EVENT_KEYS, busy=busy)


@query
def rebuild_current(source):
    return history.rebuild_current(event_history(source), EVENT_KEYS)


@query
def reconcile(source):
    """The table rebuilt from history against the newest event of each user: no rows."""
    newest = skew.latest_per_key(source.given("events"), EVENT_KEYS, F.desc("ts"), F.desc("event_id"))
    return history.reconcile(event_history(source), newest.select("user_id", "event_type"), EVENT_KEYS)


@query
def reconcile_spoiled(source):
    """As reconcile, with users missing, users changed and users made up in the newest state."""
    newest = skew.latest_per_key(source.given("events"), EVENT_KEYS, F.desc("ts"), F.desc("event_id"))
    state = F.when(F.col("user_id") % 5 == 1, F.lit("spoiled")).otherwise(F.col("event_type")).alias("event_type")
    kept = newest.where(F.col("user_id") % 5 != 0).select("user_id", state)
    made_up = newest.where(F.col("user_id") % 5 == 2).select((-F.col("user_id") - 1).alias("user_id"), "event_type")
    return history.reconcile(event_history(source), kept.unionByName(made_up), EVENT_KEYS)


# ---------------------------------------------------------------- streams


@query
def record_hash_arrays(source):
    """Hashes of lists that print alike: words split at blanks, joined with commas into one, and with nulls."""
    words = F.split("p_type", " ")
    one = F.array(F.array_join(words, ", "))
    rows = source.given("part").select("p_partkey", words.alias("w"), one.alias("o"))
    lists = rows.select("p_partkey", F.posexplode(F.array("w", "o", F.array(F.lit(None).cast("string")), F.array(F.lit("null")))).alias("form", "words"))
    hashed = lists.select("p_partkey", "form", C.record_hash(["p_partkey", "words"], ["p_partkey"], ["words"]).alias("h"))
    return hashed.groupBy("p_partkey").agg(F.count("form").alias("forms"), F.count_distinct("h").alias("hashes"))


@query
def record_hash_prefixed(source):
    """Source columns whose names start like audit columns are hashed like all others."""
    parts = source.given("part").select("p_partkey", F.col("p_brand").alias("br_code"), F.col("p_type").alias("bronze_kind"))
    return C.stamp_batch(parts, "parts", BATCH, NOW)


@query
def stream_late_rows(source):
    """Recent events arrive first; of the older ones those more than a week behind land beside the table."""
    root = shared_dir(source.spark, "late")
    events = money_columns(source.given("events"), "value")
    for recent in (True, False):
        part = events.where((F.col("ts") >= C.clock("2024-01-20 00:00:00")) == recent)
        part.write.mode("append").parquet(f"{root}/in")
        arriving = landing.read_arriving(source.spark, f"{root}/in", events.schema)
        landing.land_arriving(
            arriving, root, "events", f"{root}/checkpoint", NOW, name="stream", text=False, late=("ts", "7 days")
        ).awaitTermination()
    read = source.spark.read.parquet
    kept = read(f"{root}/staging/br_events").withColumn("late", F.lit(False))
    return kept.unionByName(read(f"{root}/staging/late_events").withColumn("late", F.lit(True))).select("event_id", "ts", "br_batch_id", "late")


@query
def stream_landing_two_sources(source):
    """Two streams with a checkpoint each land into one table; neither overwrites the other."""
    root = shared_dir(source.spark, "landing")
    for name in ("first", "second"):
        stream = money_columns(arriving_events(source), "value")
        landing.land_arriving(stream, root, "events", f"{root}/checkpoint-{name}", NOW, name=name, text=False).awaitTermination()
    return source.spark.read.parquet(f"{root}/staging/br_events").select("event_id", "br_batch_id")


@query
def stream_history_null_times(source):
    """Every third event has no time: such rows come first and stay in the history."""
    root = shared_dir(source.spark, "changes")
    untimed = arriving_events(source).withColumn("ts", F.when(F.col("event_id") % 3 != 0, F.col("ts")))
    changes.capture_batches(
        untimed, EVENT_KEYS, EVENT_STATE, EVENT_ORDER, root, "users", f"{root}/checkpoint", NOW, stream="stream"
    ).awaitTermination()
    return source.spark.read.parquet(f"{root}/history/users").drop("batch_id")


def arriving_events(source: Source) -> DataFrame:
    schema = source.given("events").schema
    return landing.read_arriving(source.spark, source.folder, schema, only="events.parquet", files_per_batch=100)


@query
def stream_landing(source):
    root = shared_dir(source.spark, "landing")
    stream = money_columns(arriving_events(source), "value")
    landing.land_arriving(stream, root, "events", f"{root}/checkpoint", NOW, name="stream").awaitTermination()
    return source.spark.read.parquet(f"{root}/staging/br_events").drop("batch_id")


@query
def stream_landing_once(source):
    """Every event arrives twice; copies are dropped while landing."""
    root = shared_dir(source.spark, "landing")
    doubled = money_columns(arriving_events(source), "value").unionByName(
        money_columns(arriving_events(source), "value")
    )
    landing.land_arriving(doubled, root, "events", f"{root}/checkpoint", NOW, name="stream", once=True).awaitTermination()
    return source.spark.read.parquet(f"{root}/staging/br_events").drop("batch_id")


@query
def stream_without_repeats(source):
    """Every event arrives twice and lands once."""
    root = shared_dir(source.spark, "repeats")
    stream = money_columns(arriving_events(source), "value")
    doubled = stream.unionByName(money_columns(arriving_events(source), "value"))
    unique = landing.without_repeats(doubled, "ts", "31 days")
    landing.append_files(unique, f"{root}/events", f"{root}/checkpoint").awaitTermination()
    return source.spark.read.schema(unique.schema).parquet(f"{root}/events")


@query
def stream_history(source):
    root = shared_dir(source.spark, "changes")
    with changes.rocksdb_state(source.spark):
        rows = changes.history_stream(arriving_events(source), EVENT_KEYS, EVENT_STATE, EVENT_ORDER, NOW)
        landing.append_files(rows, f"{root}/history", f"{root}/checkpoint").awaitTermination()
    return source.spark.read.schema(rows.schema).parquet(f"{root}/history")


@query
def stream_history_batches(source):
    root = shared_dir(source.spark, "changes")
    changes.capture_batches(
        arriving_events(source), EVENT_KEYS, EVENT_STATE, EVENT_ORDER, root, "users", f"{root}/checkpoint", NOW, stream="stream"
    ).awaitTermination()
    return source.spark.read.parquet(f"{root}/history/users").drop("batch_id")


# ---------------------------------------------------------------- generated rows


@query
def synth_reference(source):
    return synth.reference_rows(source.given("customer").select("c_custkey"), "c_custkey", NOW, seed=1)


@query
def synth_countries(source):
    return synth.country_rows(source.given("supplier").select("s_suppkey"), "s_suppkey", NOW, seed=2)


@query
def synth_transactions(source):
    return synth.transaction_rows(source.given("orders").select("o_orderkey"), "o_orderkey", NOW, seed=3)


@query
def synth_trades(source):
    return synth.trade_rows(source.given("orders").select("o_orderkey"), "o_orderkey", NOW, seed=4)


@query
def synth_temporal(source):
    return synth.temporal_rows(source.given("customer").select("c_custkey"), "c_custkey", NOW, seed=5)


@query
def synth_versions(source):
    return synth.version_rows(source.given("customer").select("c_custkey"), "c_custkey", NOW, 3, seed=6)


@query
def synth_columns(source):
    kinds = {
        "id": "int_sequence",
        "name": "random_name",
        "email": "random_email",
        "amount": "random_float",
        "created": "random_datetime",
    }
    return synth.generate(source.given("customer").select("c_custkey"), "c_custkey", kinds, NOW, seed=7)


@query
def synth_for_schema(source):
    """Parts made up to the schema of the part table, a tenth of the values missing."""
    part = source.given("part")
    rows = synth.generate_for(part.select("p_partkey"), "p_partkey", part.schema, NOW, seed=8)
    return synth.add_noise(rows, "p_partkey", 10.0, seed=9)


# ---------------------------------------------------------------- tables kept up to date


@query
def keyed_merge(source):
    """Customers' newest orders merged in three change sets into a table of key ranges, each rewriting the files it touches."""
    current = source.given("customer").select(
        F.col("c_custkey").alias("custkey"),
        F.lit(None).cast("bigint").alias("last_order"),
        C.money("c_acctbal").alias("amount"),
        F.lit(None).cast("timestamp_ntz").alias("ordered"),
    )
    orders = source.given("orders").select(
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderkey").alias("last_order"),
        C.money("o_totalprice").alias("amount"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ordered"),
    )
    table = keyed.KeyedTable(source.spark, shared_dir(source.spark, "keyed"), ["custkey"])
    table.create(current)
    for low, high in (("1900-01-01", "1998-01-01"), ("1998-01-01", "2001-01-01"), ("2001-01-01", "2100-01-01")):
        part = orders.where((F.col("ordered") >= low) & (F.col("ordered") < high))
        table.merge(part, ["ordered", "last_order"])
    return table.read().drop("ordered")


@query
def keyed_merge_files(source):
    """Orders in files of about a tenth each; lines of few orders change a total, orders end, orders begin: what every merge rewrote."""
    orders = source.given("orders").select("o_orderkey", C.money("o_totalprice").alias("total"), F.lit(False).alias("gone"))
    count = orders.count()
    table = keyed.KeyedTable(source.spark, shared_dir(source.spark, "keyed"), ["o_orderkey"], rows_per_file=max(1, count // 10))
    reports = [table.create(orders.drop("gone"))]
    first = orders.agg(F.min("o_orderkey")).first()[0]
    near = orders.where(F.col("o_orderkey") < first + 20)
    changes = [
        near.withColumn("total", (F.col("total") + 1).cast("decimal(18,2)")),
        near.withColumn("gone", F.lit(True)),
        near.withColumn("o_orderkey", -F.col("o_orderkey") - 1),
    ]
    reports += [table.merge(c, deleted=F.col("gone")) for c in changes]
    rows = [(r.version, r.rows, r.rewritten, r.kept >= 5) for r in reports]
    return source.spark.createDataFrame(rows, "version int, rows bigint, rewritten int, most_kept boolean")


@query
def scd2_incremental(source):
    """Events in three batches, a part of the early ones late by two: the same versions as from all of them at once."""
    events = source.given("events").select("event_id", "user_id", "ts", "event_type")
    store = version_store.VersionStore(source.spark, shared_dir(source.spark, "versions"), EVENT_KEYS, EVENT_STATE, EVENT_ORDER, NOW)
    late = F.col("event_type") == "error"
    recent = F.col("ts") >= C.clock("2024-01-16 00:00:00")
    for part in (~late & ~recent, recent, late & ~recent):
        store.apply(events.where(part))
    return store.read()


@query
def digest_diff(source):
    """The changes of accounts, from ranges whose digests differ."""
    return digested_accounts(source, 100).diff("before", BATCH, NOW)


@query
def digest_shares(source):
    """Two snapshots of orders of which a few differ, and two that are alike: rows in both, whether fewer are read, nodes that differ."""
    store = digests.DigestedSnapshots(source.spark, shared_dir(source.spark, "digests"), ["o_orderkey"], rows_per_range=50)
    orders = source.given("orders").select("o_orderkey", C.money("o_totalprice").alias("total"))
    changed = F.when(F.col("o_orderkey") <= 3, F.col("total") + 1).otherwise(F.col("total")).cast("decimal(18,2)")
    for name, df in (("first", orders), ("same", orders.orderBy(F.desc("total"))), ("changed", orders.withColumn("total", changed))):
        store.write(df, name)
    found = []
    for old, new in (("first", "same"), ("first", "changed")):
        nodes, _, told = store.compare(old, new)
        found.append((f"{old}-{new}", told.rows, bool(nodes), told.rows_read < told.rows))
    return source.spark.createDataFrame(found, "pair string, rows bigint, differ boolean, reads_less boolean")


def digested_accounts(source: Source, rows_per_range: int) -> digests.DigestedSnapshots:
    store = digests.DigestedSnapshots(source.spark, shared_dir(source.spark, "digests"), ["account_id"], rows_per_range=rows_per_range)
    store.write(accounts_before(source), "before")
    store.write(accounts_after(source), BATCH)
    return store


@query
def stream_history_corrected(source):
    """Events dealt over four files by id, so that each micro-batch brings late ones: the history of all events in order, with deletes."""
    root = shared_dir(source.spark, "corrections")
    events = source.given("events").select("event_id", "user_id", "ts", "event_type")
    events.repartition(4, "event_id").write.parquet(f"{root}/in")
    with changes.rocksdb_state(source.spark):
        arriving = landing.read_arriving(source.spark, f"{root}/in", events.schema, files_per_batch=1)
        rows = corrections.corrected_history(arriving, EVENT_KEYS, EVENT_STATE, EVENT_ORDER, NOW, deleted=F.col("event_type") == "error")
        landing.append_files(rows, f"{root}/history", f"{root}/checkpoint").awaitTermination()
    return corrections.standing(source.spark.read.schema(rows.schema).parquet(f"{root}/history"))


@query
def stream_landing_unique(source):
    """Events in six micro-batches, each event in two of them, with filters so small that most are forgotten: each event lands once."""
    root = shared_dir(source.spark, "unique")
    events = money_columns(source.given("events"), "value")
    events.repartition(3, "event_id").write.parquet(f"{root}/in")
    events.repartition(3, "user_id").write.mode("append").parquet(f"{root}/in")
    with changes.rocksdb_state(source.spark):
        arriving = landing.read_arriving(source.spark, f"{root}/in", events.schema, files_per_batch=1)
        repeats.land_unique(arriving, root, "events", f"{root}/checkpoint", "ts", capacity=8, generations=2).awaitTermination()
    return source.spark.read.parquet(f"{root}/staging/br_events").drop("batch_id")


@query
def rollup_maintained(source):
    """The fact's rollup from three batches: early rentals with wrong amounts, their corrections before the rest, and the rest."""
    rows = written(facts(source).select("rental_year", "rental_quarter", "rental_month", "revenue_amount", "is_weekend_rental"), "facts")
    early = rows.where(F.col("rental_year") <= 1997)
    wrong = early.withColumn("revenue_amount", (F.col("revenue_amount") - 100_000_000).cast(C.TOTAL))
    kept = maintained.MaintainedRollup(
        source.spark, shared_dir(source.spark, "rollup"), "rentals", rows.columns[:3], ["revenue_amount"], ["is_weekend_rental"], ["revenue_amount"]
    )
    kept.apply(wrong, "first")
    kept.apply(wrong.withColumn("sign", F.lit(-1)).unionByName(early.withColumn("sign", F.lit(1))), "second", F.col("sign"))
    kept.apply(rows.where(~F.coalesce(F.col("rental_year") <= 1997, F.lit(False))), "third")
    return kept.read().withColumnsRenamed({"revenue_amount": "revenue", "rows": "rentals", "is_weekend_rental": "weekend_rentals"})


@query
def sketch_profile(source):
    """Orders in three batches, profiled from their sketches alone: exact figures, and whether estimates keep their bounds."""
    orders = money_columns(source.given("orders"), "o_totalprice").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    root, year = shared_dir(source.spark, "sketches"), F.year("o_orderdate")
    for name, part in (("a", year < 1997), ("b", (year >= 1997) & (year < 2000)), ("c", year >= 2000)):
        sketches.keep(orders.where(part), root, "orders", name)
    found = written(sketches.profile_of(source.spark.read.parquet(f"{root}/sketches/orders"), "orders"), "sketch-profile")
    exact = quality.profile(orders, "orders", exact=True).select("column_name", "distinct_count")
    heavy = found.where("column_name = 'o_orderpriority'").select(F.explode("heavy").alias("h"), "slack").select("h.*", "slack")
    counts = orders.groupBy(F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("whole"))
    within = counts.join(heavy, "value", "left").agg(F.every((F.col("n") <= F.col("whole")) & (F.col("whole") <= F.col("n") + F.col("slack"))).alias("heavy_close"))
    middle = found.where("column_name = 'o_totalprice'").select(F.get("quantiles", F.lit(1))).scalar()
    share = orders.agg(F.avg((F.col("o_totalprice") <= middle).cast("int")).alias("share"))
    near = F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= F.greatest(F.lit(1.0), 0.07 * F.col("distinct_count"))
    told = found.join(exact, "column_name").select("column_name", "row_count", "null_count", "min_value", "max_value", near.alias("distinct_close"))
    return told.withColumns({"median_close": (F.abs(share.scalar() - 0.5) <= 0.015), "heavy_close": within.scalar()})


@query
def even_ranges(source):
    """Lines in ranges of their part, a few parts of which have most lines, cut by order: rows by whether each lies in one range and sizes are even."""
    lines = source.given("lineitem").select("l_orderkey", F.floor(F.pow(F.col("l_partkey") + 1, 0.5)).cast("bigint").alias("part"))
    found = ranges.even_ranges(lines, "part", 12, then="l_orderkey", rows=source.rows("lineitem"))
    tagged = lines.withColumn("range", ranges.range_of(found)).groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").alias("rows")
    even = F.max("n") <= 1.25 * F.sum("n") / len(found)
    return tagged.agg(whole, F.every(F.col("range").isNotNull()).alias("every_row_in_a_range"), even.alias("even"), (F.count(F.lit(1)) == len(found)).alias("none_empty"))


@query
def bulk_load_resumed(source):
    """Orders loaded in chunks; the first run fails at its last order and the second goes on after the chunks it kept."""
    orders = source.given("orders").select("o_orderkey", "o_custkey", C.money("o_totalprice").alias("total"))
    path = f"{shared_dir(source.spark, 'bulk')}/orders"
    last = orders.agg(F.max("o_orderkey")).first()[0]
    try:
        bulk.bulk_load(orders, path, ["o_orderkey"], partitions=4, commit_every=100, must_hold=F.col("o_orderkey") != last)
        raise AssertionError("the first run should end at its last order")
    except PySparkException as ended:
        if "refused" not in str(ended):
            raise
    bulk.bulk_load(orders, path, ["o_orderkey"], partitions=4, commit_every=100)
    return bulk.loaded(source.spark, path, orders.schema)
