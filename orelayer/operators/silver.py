"""Silver models of a film-rental source: typed columns, audit columns, and rentals with their payments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelayer.functions.columns import (
    TOTAL,
    Field,
    clock_sql,
    conform_all,
    conform_sql,
    full_name_sql,
    hours_sql,
    stable_uuid_sql,
    typed,
)
from orelayer.functions.skew import lookup
from orelayer.operators.frames import sum_by

Clock = datetime | str | None

# Declared source columns. Identifiers and counters are bigint and totals have 26 digits before the point,
# so that very large tables fit; every other type and length is that of the source models.
LANGUAGE = [Field("language_id", "bigint"), Field("name", length=20, pad=True)]
ADDRESS = [
    Field("address_id", "bigint"),
    Field("address", length=50),
    Field("address2", length=50),
    Field("district", length=20),
    Field("city_id", "bigint"),
    Field("postal_code", length=10),
    Field("phone", length=20),
]
STORE = [Field("store_id", "bigint"), Field("manager_staff_id", "bigint"), Field("address_id", "bigint")]
FILM = [
    Field("film_id", "bigint"),
    Field("title", length=255),
    Field("description"),
    Field("release_year", "int"),
    Field("language_id", "bigint"),
    Field("original_language_id", "bigint"),
    Field("rental_duration", "smallint"),
    Field("rental_rate", "decimal(4,2)"),
    Field("length", "smallint"),
    Field("replacement_cost", "decimal(5,2)"),
    Field("rating", length=10),
]
CUSTOMER = [
    Field("customer_id", "bigint"),
    Field("store_id", "bigint"),
    Field("first_name", length=45),
    Field("last_name", length=45),
    Field("email", length=50),
    Field("address_id", "bigint"),
    Field("active", "boolean", name="is_active"),
    Field("create_date", "timestamp_ntz"),
    Field("last_update", "timestamp_ntz"),
]
STAFF = [
    Field("staff_id", "bigint"),
    Field("first_name", length=45),
    Field("last_name", length=45),
    Field("address_id", "bigint"),
    Field("email", length=50),
    Field("store_id", "bigint"),
    Field("active", "boolean", name="is_active"),
    Field("username", length=16),
    Field("last_update", "timestamp_ntz"),
]
INVENTORY = [
    Field("inventory_id", "bigint"),
    Field("film_id", "bigint"),
    Field("store_id", "bigint"),
    Field("last_update", "timestamp_ntz"),
]
RENTAL = [
    Field("rental_id", "bigint"),
    Field("rental_date", "timestamp_ntz"),
    Field("return_date", "timestamp_ntz"),
    Field("inventory_id", "bigint"),
    Field("customer_id", "bigint"),
    Field("staff_id", "bigint"),
    Field("last_update", "timestamp_ntz"),
]
NOTHING = "CAST(0 AS bigint)"
PAYMENT = [Field("rental_id", "bigint"), Field("amount", "decimal(12,2)")]


def _audited(
    bronze: DataFrame,
    fields: Sequence[Field],
    entity: str,
    now: Clock,
    *,
    computed: Mapping[str, str] | None = None,
    touched: bool = False,
    linked: bool = False,
    metrics: Mapping[str, str] | None = None,
    random_keys: bool = False,
    score: Column | None = None,
) -> DataFrame:
    """Typed columns, then computed ones, then the audit columns, then metrics.

    ``touched`` models replace the source's change time by the load time, ``linked`` ones carry a link to
    the bronze row. The row key is drawn from the natural key unless ``random_keys``. ``score`` fills the
    data-quality score from the landed row.
    """
    moment = clock_sql(now)
    columns = {f"sl_{entity}_key": "uuid()" if random_keys else stable_uuid_sql(fields[0].source)}
    columns |= {f.target: conform_sql(f) for f in fields} | dict(computed or {})
    if touched:
        columns["last_update"] = moment
    columns |= {"sl_created_time": moment, "sl_updated_time": moment}
    if linked:
        columns["sl_source_bronze_key"] = "CAST(NULL AS string)"
    columns |= {"sl_is_active": "true", "sl_data_quality_score": "CAST(NULL AS double)"}
    if score is not None:
        bronze = bronze.withColumn("br_score", score)
        columns["sl_data_quality_score"] = "br_score"
    columns |= dict(metrics or {})
    return bronze.selectExpr(*[f"{value} AS {name}" for name, value in columns.items()])


def _measured(silver: DataFrame, metrics: DataFrame | None, key: str) -> DataFrame:
    """Replace the empty metric columns by those of ``metrics``, one row per key; absent keys keep theirs."""
    if metrics is None:
        return silver
    names = [c for c in metrics.columns if c != key]
    types = dict(silver.dtypes)
    joined = silver.join(metrics.selectExpr(key, *[f"{c} AS new_{c}" for c in names]), key, "left")
    return joined.selectExpr(
        *[f"coalesce(CAST(new_{c} AS {types[c]}), {c}) AS {c}" if c in names else c for c in silver.columns]
    )


def sl_language(bronze: DataFrame, now: Clock = None, **options) -> DataFrame:
    return _audited(bronze, LANGUAGE, "language", now, touched=True, linked=True, **options)


def sl_address(bronze: DataFrame, now: Clock = None, counters: DataFrame | None = None, **options) -> DataFrame:
    empty = {"sl_customer_count": NOTHING, "sl_store_count": NOTHING}
    silver = _audited(bronze, ADDRESS, "address", now, touched=True, linked=True, metrics=empty, **options)
    return _measured(silver, counters, "address_id")


def sl_store(bronze: DataFrame, now: Clock = None, metrics: DataFrame | None = None, **options) -> DataFrame:
    empty = {
        "sl_total_revenue": "CAST(0 AS double)",
        "sl_total_customers": NOTHING,
        "sl_total_rentals": NOTHING,
        "sl_avg_rental_rate": "CAST(NULL AS double)",
    }
    silver = _audited(bronze, STORE, "store", now, touched=True, linked=True, metrics=empty, **options)
    return _measured(silver, metrics, "store_id")


def sl_film(bronze: DataFrame, now: Clock = None, metrics: DataFrame | None = None, **options) -> DataFrame:
    empty = {
        "sl_rental_count": NOTHING,
        "sl_total_revenue": f"CAST(0 AS {TOTAL})",
        "sl_avg_rental_duration": "CAST(NULL AS double)",
    }
    silver = _audited(bronze, FILM, "film", now, touched=True, linked=True, metrics=empty, **options)
    return _measured(silver, metrics, "film_id")


def _person(fields: Sequence[Field]) -> dict[str, str]:
    first, last = (conform_sql(f) for f in fields if f.source in ("first_name", "last_name"))
    return {"full_name": full_name_sql(first, last)}


def sl_customer(bronze: DataFrame, now: Clock = None, **options) -> DataFrame:
    return _audited(bronze, CUSTOMER, "customer", now, computed=_person(CUSTOMER), **options)


def sl_staff(bronze: DataFrame, now: Clock = None, **options) -> DataFrame:
    return _audited(bronze, STAFF, "staff", now, computed=_person(STAFF), **options)


def sl_inventory(bronze: DataFrame, now: Clock = None, **options) -> DataFrame:
    return _audited(bronze, INVENTORY, "inventory", now, **options)


def payments_per_rental(payment: DataFrame) -> DataFrame:
    return sum_by(payment, "rental_id", typed("amount", "decimal(12,2)"), "revenue_amount")


def sl_rental_enriched(
    rental: DataFrame,
    inventory: DataFrame,
    payment: DataFrame,
    now: Clock = None,
    *,
    inventory_rows: int | None = None,
    random_keys: bool = False,
) -> DataFrame:
    """Rentals with the film and store of the copy rented, hours out, and the sum paid.

    Payments are summed before the join, so a rental with many payments stays one row and a busy rental is
    combined before any shuffle. Hours are null while the rental is open. ``inventory_rows`` is the counted
    size of the inventory, which decides how a copy is looked up.
    """
    typed_rental = conform_all(rental, RENTAL)
    copies = conform_all(inventory, INVENTORY[:3])
    paid = payments_per_rental(conform_all(payment, PAYMENT))
    joined = lookup(typed_rental.join(paid, "rental_id", "left"), copies, ["inventory_id"], ["rental_id"], inventory_rows)
    moment = clock_sql(now)
    return joined.selectExpr(
        f"{'uuid()' if random_keys else stable_uuid_sql('rental_id')} AS sl_rental_key",
        "rental_id",
        "rental_date",
        "return_date",
        "customer_id",
        "staff_id",
        "film_id",
        "store_id",
        f"{hours_sql('rental_date', 'return_date')} AS rental_duration_actual",
        "CAST(NULL AS double) AS rental_duration_planned",
        "CAST(NULL AS decimal(4,2)) AS rental_rate",
        "CAST(NULL AS decimal(5,2)) AS replacement_cost",
        "revenue_amount",
        "last_update",
        f"{moment} AS sl_created_time",
        f"{moment} AS sl_updated_time",
        "true AS sl_is_active",
        "CAST(NULL AS double) AS sl_data_quality_score",
    )


# ---------------------------------------------------------------- metrics


def film_metrics(rentals: DataFrame) -> DataFrame:
    """Per film: rentals, sum paid, mean hours out of the rentals that came back."""
    micros = F.timestamp_diff("MICROSECOND", F.col("rental_date"), F.col("return_date"))
    hours = F.sum(micros.cast("decimal(20,0)")).cast("double") / F.count(micros) / F.lit(3.6e9)
    return rentals.where(F.col("film_id").isNotNull()).groupBy("film_id").agg(
        F.count(F.lit(1)).alias("sl_rental_count"),
        F.coalesce(F.sum("revenue_amount"), F.lit(0)).cast(TOTAL).alias("sl_total_revenue"),
        hours.alias("sl_avg_rental_duration"),
    )


def store_metrics(rentals: DataFrame, films: DataFrame, film_rows: int | None = None) -> DataFrame:
    """Per store: sum paid, distinct customers, rentals, mean list rate of the films rented.

    One pass: rows are combined per store and customer before the shuffle that counts customers.
    ``film_rows`` is the counted size of the films, which decides how their rates are looked up.
    """
    rates = films.select("film_id", F.col("rental_rate").alias("_rate"))
    known = rentals.where(F.col("store_id").isNotNull()).select(
        "rental_id", "store_id", "film_id", "customer_id", "revenue_amount"
    )
    return (
        lookup(known, rates, ["film_id"], ["rental_id"], film_rows)
        .groupBy("store_id")
        .agg(
            F.coalesce(F.sum("revenue_amount"), F.lit(0)).cast("double").alias("sl_total_revenue"),
            F.count_distinct("customer_id").alias("sl_total_customers"),
            F.count(F.lit(1)).alias("sl_total_rentals"),
            (F.sum("_rate").cast("double") / F.count("_rate")).alias("sl_avg_rental_rate"),
        )
    )


def address_counters(customers: DataFrame, stores: DataFrame) -> DataFrame:
    """Per address: customers and stores that have it."""
    tagged = customers.select("address_id", F.lit(1).alias("_c"), F.lit(0).alias("_s")).unionByName(
        stores.select("address_id", F.lit(0).alias("_c"), F.lit(1).alias("_s"))
    )
    return (
        tagged.where(F.col("address_id").isNotNull())
        .groupBy("address_id")
        .agg(F.sum("_c").alias("sl_customer_count"), F.sum("_s").alias("sl_store_count"))
    )


def staff_metrics(rentals: DataFrame, payment: DataFrame) -> DataFrame:
    """Per member of staff: rentals, payments and their sum and mean, through the rental paid for."""
    paid = (
        conform_all(payment, PAYMENT)
        .groupBy("rental_id")
        .agg(F.count("amount").alias("_payments"), F.sum("amount").alias("_paid"))
    )
    joined = rentals.where(F.col("staff_id").isNotNull()).select("rental_id", "staff_id").join(paid, "rental_id", "left")
    payments = F.coalesce(F.sum("_payments"), F.lit(0))
    return joined.groupBy("staff_id").agg(
        F.count(F.lit(1)).alias("total_rentals_processed"),
        payments.alias("total_payments_processed"),
        F.coalesce(F.sum("_paid"), F.lit(0)).cast(TOTAL).alias("total_payment_amount"),
        F.when(payments > 0, F.sum("_paid").cast("double") / payments)
        .cast("decimal(18,6)").cast("decimal(12,2)").alias("avg_payment_amount"),
    )
