"""Gold models: keyed dimensions, a calendar, and the rental fact."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelayer.functions.columns import TOTAL, clock, stable_uuid_sql, weekend_sql
from orelayer.functions.skew import lookup
from orelayer.operators.silver import Clock

# The months of each season. Output column names of the models below are fixed too.
SEASONS = {"Winter": [12, 1, 2], "Spring": [3, 4, 5], "Summer": [6, 7, 8], "Autumn": [9, 10, 11]}


def _empty(type_: str, *names: str) -> list[str]:
    """Columns of the model that no source fills."""
    return [f"CAST(NULL AS {type_}) AS {name}" for name in names]


def _fixed(value: str, *names: str) -> list[str]:
    return [f"{value} AS {name}" for name in names]


def dim_film(film: DataFrame, language: DataFrame) -> DataFrame:
    """Films with their language, ``Unknown`` where there is none. Columns without a source stay empty."""
    spoken = language.selectExpr("language_id", "name AS _language")
    return film.join(spoken, "language_id", "left").selectExpr(
        f"{stable_uuid_sql('film_id')} AS gl_dim_film_key",
        "film_id",
        "title",
        "description",
        "release_year",
        "rating",
        "coalesce(_language, 'Unknown') AS language_name",
        *_empty("string", "original_language_name", "category_names", "primary_category", "actor_names", "lead_actor"),
        "length AS length_minutes",
        "rental_duration AS rental_duration_days",
        "rental_rate",
        "replacement_cost",
        *_fixed("false", "has_trailers", "has_commentaries", "has_deleted_scenes", "has_behind_scenes"),
        *_fixed("0", "special_features_count", "total_inventory_copies"),
        "coalesce(sl_rental_count, 0) AS total_rentals",
        f"coalesce(sl_total_revenue, CAST(0 AS {TOTAL})) AS total_revenue",
        "sl_avg_rental_duration AS avg_rental_duration",
        *_empty("double", "rental_frequency"),
        *_empty("string", "length_category", "price_tier"),
        *_empty("double", "popularity_score"),
        *_fixed("false", "is_classic"),
        *_fixed("true", "is_currently_available"),
        *_empty("timestamp_ntz", "last_rental_date"),
        *_empty("int", "days_since_last_rental"),
    )


def dim_store(store: DataFrame, address: DataFrame) -> DataFrame:
    """Stores with their address and metrics."""
    place = address.selectExpr(
        "address_id", "address AS address_line1", "address2 AS address_line2", "district", "postal_code", "phone"
    )
    return store.join(place, "address_id", "left").selectExpr(
        f"{stable_uuid_sql('store_id')} AS gl_dim_store_key",
        "store_id",
        "manager_staff_id",
        *_fixed("''", "manager_first_name", "manager_last_name", "manager_full_name"),
        *_empty("string", "manager_email"),
        "address_line1",
        "address_line2",
        "district",
        *_fixed("''", "city"),
        "postal_code",
        "phone",
        *_fixed("''", "country"),
        "last_update",
        "sl_total_customers AS total_customers",
        "sl_total_rentals AS total_rentals",
        "sl_total_revenue AS total_revenue",
        "sl_avg_rental_rate AS avg_rental_rate",
        *_fixed("0", "total_inventory_items", "active_customers"),
        *_empty("decimal(8,2)", "revenue_per_customer"),
        *_empty("double", "inventory_turnover_rate", "customer_retention_rate", "avg_rentals_per_day"),
        *_empty("string", "store_tier"),
        *_fixed("false", "is_flagship_store"),
        *_empty("string", "primary_customer_segment"),
    )


def dim_staff(
    staff: DataFrame, store: DataFrame, address: DataFrame, now: Clock = None, metrics: DataFrame | None = None
) -> DataFrame:
    """Staff with the address of their store; ``is_store_manager`` is null where the store is missing."""
    shops = store.selectExpr("store_id AS _store_id", "manager_staff_id", "address_id AS _at")
    places = address.selectExpr("address_id AS _address_id", "address AS store_address")
    joined = staff.join(shops, F.col("store_id") == F.col("_store_id"), "left").join(
        places, F.col("_at") == F.col("_address_id"), "left"
    )
    if metrics is not None:
        joined = joined.join(metrics, "staff_id", "left")

    def metric(name: str, type_: str, default: str) -> str:
        value = default if metrics is None else f"coalesce({name}, {default})"
        return f"CAST({value} AS {type_}) AS {name}"

    return joined.withColumn("_now", clock(now)).selectExpr(
        f"{stable_uuid_sql('staff_id')} AS gl_dim_staff_key",
        "staff_id",
        "first_name",
        "last_name",
        "full_name",
        "email",
        "username",
        "is_active",
        "store_id",
        "store_address",
        *_empty("string", "store_city"),
        "store_id = _store_id AND staff_id = manager_staff_id AS is_store_manager",
        *_empty("string", "address_line1", "address_line2", "district", "city", "postal_code", "phone", "country"),
        "coalesce(last_update, _now) AS last_update",
        metric("total_rentals_processed", "bigint", "0"),
        metric("total_payments_processed", "bigint", "0"),
        metric("total_payment_amount", TOTAL, "0"),
        metric("avg_payment_amount", "decimal(12,2)", "NULL"),
        *_empty("double", "avg_rentals_per_day", "avg_payments_per_day", "customer_satisfaction_score"),
        *_empty("string", "performance_tier"),
        *_fixed("false", "is_top_performer"),
        *_empty("string", "specialization"),
        *_empty("int", "managed_staff_count"),
        *_empty("decimal(12,2)", "store_revenue_under_management"),
        *_empty("double", "team_performance_score"),
    )


def calendar(bounds: DataFrame, as_of: date | str, holidays: DataFrame | None = None) -> DataFrame:
    """``dim_date``: one row per day from ``first_day`` to ``last_day`` of the one-row frame ``bounds``.

    The bounds come as a frame so that they can be taken from the data without a trip to the driver.
    Fiscal periods are calendar ones. ``holidays`` has ``full_date, holiday_name, holiday_type``. Days count
    Sunday as 0 and weeks are ISO weeks.
    """
    days = bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("full_date"))
    if holidays is None:
        days = days.selectExpr("full_date", *_empty("string", "holiday_name", "holiday_type"))
    else:
        days = days.join(holidays.select("full_date", "holiday_name", "holiday_type"), "full_date", "left")
    day = as_of if isinstance(as_of, str) else as_of.isoformat()
    marked = days.selectExpr(
        "full_date AS d",
        f"DATE'{day}' AS today",
        f"{weekend_sql('full_date')} AS weekend",
        "holiday_name IS NOT NULL AS holiday",
        "concat('Q', quarter(full_date)) AS q",
        "holiday_name",
        "holiday_type",
    )
    season = " ".join(f"WHEN month(d) IN ({', '.join(map(str, months))}) THEN '{name}'" for name, months in SEASONS.items())
    return marked.selectExpr(
        "CAST(date_format(d, 'yyyyMMdd') AS int) AS date_key",
        "d AS full_date",
        "day(d) AS day_of_month",
        "dayofyear(d) AS day_of_year",
        "dayofweek(d) - 1 AS day_of_week",
        "date_format(d, 'EEEE') AS day_name",
        "date_format(d, 'E') AS day_name_short",
        "weekofyear(d) AS week_of_year",
        "CAST(ceil(day(d) / 7) AS int) AS week_of_month",
        "if(weekend, 'Weekend', 'Weekday') AS weekday_indicator",
        "month(d) AS month_number",
        "date_format(d, 'MMMM') AS month_name",
        "date_format(d, 'MMM') AS month_name_short",
        "date_format(d, 'yyyy-MM') AS month_year",
        "quarter(d) AS quarter_number",
        "q AS quarter_name",
        "concat(year(d), '-', q) AS quarter_year",
        "year(d) AS year_number",
        "weekend AS is_weekend",
        "NOT weekend AS is_weekday",
        "holiday AS is_holiday",
        "NOT weekend AND NOT holiday AS is_business_day",
        "holiday_name",
        "holiday_type",
        *[f"{part}(d) AS fiscal_{part}" for part in ("year", "quarter", "month")],
        "d = today AS is_current_day",
        *[f"trunc(d, '{unit}') = trunc(today, '{unit}') AS is_current_{unit}" for unit in ("week", "month", "quarter", "year")],
        "datediff(d, today) AS days_from_today",
        *[f"trunc(d, '{unit}') <> trunc(date_add(d, 1), '{unit}') AS is_{unit}_end" for unit in ("month", "quarter", "year")],
        "dayofyear(make_date(year(d), 12, 31)) = 366 AS is_leap_year",
        f"CASE {season} END AS season",
    )


def date_bounds(df: DataFrame, *moments: str) -> DataFrame:
    """The first and last day of the given timestamps, as the one-row frame :func:`calendar` takes."""
    return df.agg(
        F.to_date(F.least(*[F.min(m) for m in moments]) if len(moments) > 1 else F.min(moments[0])).alias("first_day"),
        F.to_date(F.greatest(*[F.max(m) for m in moments]) if len(moments) > 1 else F.max(moments[0])).alias("last_day"),
    )


def fact_rental(
    rentals: DataFrame,
    d_film: DataFrame,
    d_store: DataFrame,
    d_staff: DataFrame,
    d_date: DataFrame,
    now: datetime | str | None = None,
    rows: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row per rental: dimension keys, both dates, planned and actual values, revenue.

    Every join is a left lookup of one row; a film's planned values come from its dimension, with its key. ``rows``
    gives the counted sizes of ``film``, ``store`` and ``staff``: small ones are broadcast, and for large ones rentals of a busy key are spread over tasks.
    Revenue is the sum paid, or the list rate where nothing was paid.
    """
    rows = rows or {}
    by = ["rental_id"]
    films = d_film.selectExpr(
        "film_id",
        "gl_dim_film_key AS film_key",
        "rental_duration_days AS rental_duration",
        "rental_rate",
        "replacement_cost",
    )
    store_keys = d_store.selectExpr("store_id", "gl_dim_store_key AS store_key")
    staff_keys = d_staff.selectExpr("staff_id", "gl_dim_staff_key AS staff_key")
    facts = rentals.select(
        "rental_id", "rental_date", "return_date", "rental_duration_actual", "revenue_amount",
        "film_id", "store_id", "staff_id",
    )
    joined = lookup(facts, films, ["film_id"], by, rows.get("film"))
    joined = lookup(joined, store_keys, ["store_id"], by, rows.get("store"))
    joined = lookup(joined, staff_keys, ["staff_id"], by, rows.get("staff"))
    joined = (
        joined.join(
            d_date.selectExpr("date_key AS rental_date_key", "full_date AS _rented", "is_holiday AS _holiday"),
            F.to_date("rental_date") == F.col("_rented"),
            "left",
        )
        .join(
            d_date.selectExpr("date_key AS return_date_key", "full_date AS _returned"),
            F.to_date("return_date") == F.col("_returned"),
            "left",
        )
    )
    return joined.withColumn("_now", clock(now)).selectExpr(
        f"{stable_uuid_sql('rental_id')} AS gl_fact_rental_key",
        "rental_id",
        "film_key",
        "store_key",
        "staff_key",
        "rental_date_key",
        "return_date_key",
        "to_date(rental_date) AS rental_date",
        "rental_date AS rental_datetime",
        "to_date(return_date) AS return_date",
        "return_date AS return_datetime",
        "rental_duration_actual",
        "rental_duration AS rental_duration_planned",
        "rental_rate",
        "replacement_cost",
        f"CAST(coalesce(revenue_amount, rental_rate) AS {TOTAL}) AS revenue_amount",
        f"{weekend_sql('rental_date')} AS is_weekend_rental",
        "coalesce(_holiday, false) AS is_holiday_rental",
        *[f"{part}(rental_date) AS rental_{part}" for part in ("hour", "quarter", "month", "year")],
        *_fixed("_now", "gl_created_time", "gl_updated_time"),
    )


# ---------------------------------------------------------------- reports on the models


def overdue_returns(
    customer: DataFrame, rental: DataFrame, today: date | str, customer_rows: int | None = None
) -> DataFrame:
    """Rentals returned before ``today``, with the customer's name.

    ``customer_rows`` is the counted size of the customers, which decides how they are looked up.
    """
    day = F.lit(today if isinstance(today, str) else today.isoformat()).cast("date")
    returned = rental.where(F.col("return_date").isNotNull() & (F.col("return_date") < day.cast("timestamp_ntz")))
    names = customer.select("customer_id", "first_name", "last_name")
    return lookup(returned, names, ["customer_id"], ["rental_id"], customer_rows, "inner").select(
        "rental_id", "first_name", "last_name", "return_date"
    )


def revenue_by_film(film: DataFrame, inventory: DataFrame, rental: DataFrame, payment: DataFrame) -> DataFrame:
    """Revenue per film over film, inventory, rental and payment.

    Payments are combined per rental and rentals per copy before each join, so every join has one row per
    key on one side and no busy film, copy or rental on the other.
    """
    paid = payment.groupBy("rental_id").agg(F.sum("amount").alias("_paid"))
    per_copy = rental.join(paid, "rental_id").groupBy("inventory_id").agg(F.sum("_paid").alias("_paid"))
    per_film = inventory.join(per_copy, "inventory_id").groupBy("film_id").agg(F.sum("_paid").alias("_paid"))
    return film.join(per_film, "film_id").select(
        "film_id", "title", F.col("_paid").cast(TOTAL).alias("total_revenue")
    )


def customer_value(customer: DataFrame, rental: DataFrame, payment: DataFrame) -> DataFrame:
    """Rentals and sum paid per customer; customers without rentals stay, with 0 and null."""
    paid = payment.groupBy("rental_id").agg(F.sum("amount").alias("_paid"))
    spent = (
        rental.join(paid, "rental_id", "left")
        .groupBy("customer_id")
        .agg(F.count_distinct("rental_id").alias("_rentals"), F.sum("_paid").alias("_paid"))
    )
    return customer.join(spent, "customer_id", "left").select(
        "customer_id",
        F.concat("first_name", F.lit(" "), "last_name").alias("customer_name"),
        F.coalesce("_rentals", F.lit(0)).alias("rental_count"),
        F.col("_paid").cast(TOTAL).alias("lifetime_value"),
    )


def rental_rollup(facts: DataFrame) -> DataFrame:
    """Revenue and rentals by year, quarter and month, with subtotals."""
    levels = ["rental_year", "rental_quarter", "rental_month"]
    return facts.rollup(*levels).agg(
        F.grouping_id(*levels).cast("int").alias("level"),
        F.sum("revenue_amount").cast(TOTAL).alias("revenue"),
        F.count(F.lit(1)).alias("rentals"),
        F.count_if("is_weekend_rental").alias("weekend_rentals"),
    )


def rentals_by_hour(facts: DataFrame) -> DataFrame:
    return facts.groupBy("is_weekend_rental", "rental_hour").agg(
        F.sum("revenue_amount").cast(TOTAL).alias("revenue"), F.count(F.lit(1)).alias("rentals")
    )
