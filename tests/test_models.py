"""Silver and gold models on hand-made rental rows."""

from datetime import date, datetime
from decimal import Decimal
from threading import Barrier

import pytest

from orelayer.functions.columns import stamp_batch
from orelayer.operators import gold, silver
from orelayer.plans import build

NOW = "2025-01-01 00:00:00"
T = datetime(2024, 5, 4, 10, 30)  # a Saturday


@pytest.fixture(scope="module")
def source(spark):
    """Text rows as staging holds them. Rental 2 is open and unpaid, rental 3 has no copy and three payments."""

    def rows(data, columns):
        return spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns.split()))

    return {
        "language": rows([("1", "English")], "language_id name"),
        "address": rows([("5", "1 Main St", None, "North", "9", "12345", "555")], "address_id address address2 district city_id postal_code phone"),
        "store": rows([("1", "7", "5")], "store_id manager_staff_id address_id"),
        "film": rows(
            [("10", "ALIEN", "x", "1979", "1", None, "3", "4.99", "117", "19.99", "R"),
             ("11", "SOLARIS", None, "1972", "2", "1", "5", "0.99", "167", "9.99", "PG")],
            "film_id title description release_year language_id original_language_id rental_duration rental_rate length replacement_cost rating",
        ),
        "customer": rows(
            [("100", "1", "ANN", "LEE", "a@b.c", "5", "1", "2020-01-01", "2024-01-01 00:00:00"),
             ("101", "1", None, "POE", "p@b.c", "5", "f", "2020-01-01", None)],
            "customer_id store_id first_name last_name email address_id active create_date last_update",
        ),
        "staff": rows(
            [("7", "MIKE", "HILL", "5", "m@b.c", "1", "True", "m" * 20, None), ("8", "JON", "DOE", "5", "j@b.c", "2", "0", "jon", "2024-01-01")],
            "staff_id first_name last_name address_id email store_id active username last_update",
        ),
        "inventory": rows([("1000", "10", "1", "2024-01-01")], "inventory_id film_id store_id last_update"),
        "rental": rows(
            [("1", str(T), "2024-05-05 22:30:00", "1000", "100", "7", str(T)),
             ("2", str(T), None, "1000", "100", "7", str(T)),
             ("3", "2024-05-06 08:00:00", "2024-05-06 07:00:00", "4444", "101", "8", str(T))],
            "rental_id rental_date return_date inventory_id customer_id staff_id last_update",
        ),
        "payment": rows([("1", "4.99"), ("3", "1.00"), ("3", "2.00"), ("3", "3.50"), (None, "9.00")], "rental_id amount"),
    }


@pytest.fixture(scope="module")
def rentals(source):
    return silver.sl_rental_enriched(source["rental"], source["inventory"], source["payment"], NOW).cache()


def test_people(source):
    rows = {r.customer_id: r for r in silver.sl_customer(source["customer"], NOW).collect()}
    assert rows[100].full_name == "ANN LEE" and rows[101].full_name is None
    assert rows[100].is_active is True and rows[101].is_active is False
    staff = {r.staff_id: r for r in silver.sl_staff(source["staff"], NOW).collect()}
    assert staff[7].username == "m" * 16 and staff[7].is_active is True and staff[8].is_active is False


def test_silver_audit_columns_and_types(source):
    film = silver.sl_film(source["film"], NOW)
    types = dict(film.dtypes)
    assert types["rental_rate"] == "decimal(4,2)" and types["length"] == "smallint" and types["sl_data_quality_score"] == "double"
    row = film.where("film_id = 10").first()
    assert row.last_update == row.sl_created_time == datetime(2025, 1, 1)
    assert row.sl_is_active and row.sl_source_bronze_key is None
    assert (row.sl_rental_count, row.sl_total_revenue, row.sl_avg_rental_duration) == (0, Decimal("0.00"), None)
    assert silver.sl_language(source["language"], NOW).first().name == "English" + " " * 13


def test_keys_repeat_unless_random(source):
    def keys(**options):
        return {r.sl_film_key for r in silver.sl_film(source["film"], NOW, **options).collect()}

    assert keys() == keys() and not keys(random_keys=True) & keys()


def test_silver_reads_stamped_bronze(source):
    landed = stamp_batch(source["film"], "film", "b", NOW)
    assert silver.sl_film(landed, NOW).columns == silver.sl_film(source["film"], NOW).columns


def test_rentals_do_not_fan_out(rentals):
    rows = {r.rental_id: r for r in rentals.collect()}
    assert len(rows) == 3
    assert rows[1].rental_duration_actual == 36.0 and rows[2].rental_duration_actual is None
    assert rows[3].rental_duration_actual == -1.0
    assert rows[1].revenue_amount == Decimal("4.99") and rows[2].revenue_amount is None
    assert rows[3].revenue_amount == Decimal("6.50") and rows[3].film_id is None


def test_metrics(source, rentals):
    film = silver.sl_film(source["film"], NOW, silver.film_metrics(rentals))
    rows = {r.film_id: r for r in film.collect()}
    assert (rows[10].sl_rental_count, rows[10].sl_total_revenue, rows[10].sl_avg_rental_duration) == (2, Decimal("4.99"), 36.0)
    assert rows[11].sl_rental_count == 0
    store = silver.sl_store(source["store"], NOW, silver.store_metrics(rentals, film)).first()
    assert (store.sl_total_revenue, store.sl_total_customers, store.sl_total_rentals, store.sl_avg_rental_rate) == (4.99, 1, 2, 4.99)
    counters = silver.address_counters(silver.sl_customer(source["customer"], NOW), store_frame(source)).first()
    assert (counters.sl_customer_count, counters.sl_store_count) == (2, 1)
    staff = {r.staff_id: r for r in silver.staff_metrics(rentals, source["payment"]).collect()}
    assert (staff[7].total_rentals_processed, staff[7].total_payments_processed, staff[7].total_payment_amount) == (2, 1, Decimal("4.99"))
    assert staff[8].avg_payment_amount == Decimal("2.17")


def store_frame(source):
    return silver.sl_store(source["store"], NOW)


def test_dimensions(source):
    film = silver.sl_film(source["film"], NOW)
    rows = {r.film_id: r for r in gold.dim_film(film, silver.sl_language(source["language"], NOW)).collect()}
    assert rows[10].language_name.strip() == "English" and rows[11].language_name == "Unknown"
    assert rows[11].total_rentals == 0 and rows[11].is_currently_available and rows[11].category_names is None
    address = silver.sl_address(source["address"], NOW)
    store = gold.dim_store(store_frame(source), address).first()
    assert (store.address_line1, store.city, store.total_rentals) == ("1 Main St", "", 0)
    staff = gold.dim_staff(silver.sl_staff(source["staff"], NOW), store_frame(source), address, NOW)
    rows = {r.staff_id: r for r in staff.collect()}
    assert rows[7].is_store_manager is True and rows[7].last_update == datetime(2025, 1, 1)
    assert rows[8].is_store_manager is None and rows[8].store_address is None


def days(spark, first, last, as_of="2025-01-01", holidays=None):
    bounds = spark.createDataFrame([(first, last)], "first_day date, last_day date")
    return {r.full_date: r for r in gold.calendar(bounds, as_of, holidays).collect()}


def test_calendar_first_of_2025(spark):
    row = days(spark, date(2025, 1, 1), date(2025, 1, 1))[date(2025, 1, 1)].asDict()
    # The calendar row the model is defined by.
    expected = dict(
        date_key=20250101, day_of_month=1, day_of_year=1, day_of_week=3, day_name="Wednesday", day_name_short="Wed",
        week_of_year=1, week_of_month=1, weekday_indicator="Weekday", month_number=1, month_name="January",
        month_name_short="Jan", month_year="2025-01", quarter_number=1, quarter_name="Q1", quarter_year="2025-Q1",
        year_number=2025, is_weekend=False, is_weekday=True, is_business_day=True, fiscal_year=2025, fiscal_quarter=1,
        fiscal_month=1, is_month_end=False, is_quarter_end=False, is_year_end=False, is_leap_year=False, season="Winter",
    )
    assert {k: row[k] for k in expected} == expected
    assert row["is_current_day"] and row["days_from_today"] == 0


def test_calendar_edges(spark):
    rows = days(spark, date(2024, 2, 28), date(2025, 1, 6))
    assert len(rows) == 314
    leap = rows[date(2024, 2, 29)]
    assert leap.is_leap_year and leap.is_month_end and not leap.is_quarter_end
    assert rows[date(2024, 12, 30)].week_of_year == 1
    assert rows[date(2025, 1, 5)].day_of_week == 0 and rows[date(2025, 1, 5)].is_weekend
    assert rows[date(2024, 3, 31)].is_quarter_end and not rows[date(2024, 3, 31)].is_year_end
    assert rows[date(2024, 12, 31)].is_year_end and rows[date(2024, 12, 31)].is_current_week
    assert not rows[date(2024, 12, 31)].is_current_year and rows[date(2024, 12, 31)].days_from_today == -1


def test_calendar_holidays(spark):
    holidays = spark.createDataFrame([(date(2025, 1, 1), "New Year", "public")], "full_date date, holiday_name string, holiday_type string")
    rows = days(spark, date(2025, 1, 1), date(2025, 1, 2), holidays=holidays)
    assert rows[date(2025, 1, 1)].is_holiday and not rows[date(2025, 1, 1)].is_business_day
    assert not rows[date(2025, 1, 2)].is_holiday and rows[date(2025, 1, 2)].is_business_day


@pytest.mark.parametrize("rows", [None, {"film": 2, "store": 1, "staff": 2}, {"film": 10**9, "store": 10**9, "staff": 10**9}])
def test_fact(spark, source, rentals, rows):
    film, store = silver.sl_film(source["film"], NOW), store_frame(source)
    address = silver.sl_address(source["address"], NOW)
    calendar = gold.calendar(gold.date_bounds(rentals, "rental_date", "return_date"), "2025-01-01")
    d_film = gold.dim_film(film, silver.sl_language(source["language"], NOW))
    fact = gold.fact_rental(
        rentals, d_film, gold.dim_store(store, address),
        gold.dim_staff(silver.sl_staff(source["staff"], NOW), store, address, NOW), calendar, NOW, rows,
    )
    got = {r.rental_id: r for r in fact.collect()}
    assert len(got) == 3
    assert got[1].revenue_amount == Decimal("4.99") and got[2].revenue_amount == Decimal("4.99")  # list rate
    assert got[3].revenue_amount == Decimal("6.50") and got[3].film_key is None and got[3].rental_rate is None
    assert got[1].is_weekend_rental and not got[3].is_weekend_rental
    assert (got[1].rental_hour, got[1].rental_quarter, got[1].rental_month, got[1].rental_year) == (10, 2, 5, 2024)
    assert got[1].rental_date_key == 20240504 and got[1].return_date_key == 20240505 and got[2].return_date_key is None
    assert got[1].film_key == d_film.where("film_id = 10").first().gl_dim_film_key
    assert got[1].rental_duration_planned == 3 and got[1].staff_key is not None


def test_reports(source, rentals):
    late = gold.overdue_returns(
        silver.sl_customer(source["customer"], NOW), rentals.select("rental_id", "customer_id", "return_date"), "2024-05-06"
    )
    assert [(r.rental_id, r.last_name) for r in late.collect()] == [(1, "LEE")]
    payment = silver.payments_per_rental(source["payment"]).withColumnRenamed("revenue_amount", "amount")
    value = {r.customer_id: r for r in gold.customer_value(silver.sl_customer(source["customer"], NOW), rentals, payment).collect()}
    assert (value[100].rental_count, value[100].lifetime_value) == (2, Decimal("4.99"))
    assert value[101].customer_name is None and value[101].rental_count == 1


def test_build_stops_at_bad_silver(spark, source, tmp_path):
    broken = {**source, "film": source["film"].unionByName(source["film"])}
    broken["inventory"] = source["inventory"]
    warehouse = build.Warehouse(spark, str(tmp_path), "b1", NOW)
    with pytest.raises(ValueError, match="silver checks failed: .*film_id unique"):
        build.build(warehouse, broken, "2025-01-01")
    assert not (tmp_path / "gold").exists()


def test_build_and_log(spark, source, tmp_path):
    # Staff and store of every rental must be known for the relationship checks to pass.
    kept = {**source, "rental": source["rental"].where("rental_id <> '3'")}
    warehouse = build.build(build.Warehouse(spark, str(tmp_path), "b1", NOW), kept, "2025-01-01")
    assert warehouse.rows("gold", "fact_rental") == 2
    log = warehouse.log("run-1")
    assert log.count() == len(warehouse.written) == 22
    assert {r.status for r in log.collect()} == {"success"}
    again = build.build(build.Warehouse(spark, str(tmp_path), "b1", NOW), kept, "2025-01-01")
    assert again.read("gold", "fact_rental").count() == 2


def test_build_tenants(spark, source, tmp_path):
    kept = {**source, "rental": source["rental"].where("rental_id <> '3'")}
    specs = [{"warehouse": {"name": n}} for n in ("north", "south")]
    sources = {"north": kept, "south": {**kept, "rental": kept["rental"].where("rental_id = '1'")}}
    rows = build.build_tenants(spark, specs, sources, str(tmp_path), "b1", NOW, "2025-01-01").collect()
    assert {(r.tenant, r.row_count) for r in rows if r.table_name == "fact_rental"} == {("north", 2), ("south", 1)}


def test_tables_are_written_side_by_side(spark, source, tmp_path):
    met = Barrier(2)  # each of two tables waits for the other to be begun

    def begun(name):
        met.wait(30)
        return silver.sl_language(source[name], NOW) if name == "language" else silver.sl_inventory(source[name], NOW)

    warehouse = build.Warehouse(spark, str(tmp_path), "b1", NOW)
    language, inventory = warehouse.put_all("silver", {f"sl_{n}": lambda n=n: begun(n) for n in ("language", "inventory")})
    assert [(t, n) for _, t, n in warehouse.written] == [("sl_language", language.count()), ("sl_inventory", inventory.count())]


def test_an_error_of_one_table_is_raised(spark, source, tmp_path):
    def broken():
        raise ValueError("no such table")

    warehouse = build.Warehouse(spark, str(tmp_path), "b1", NOW)
    with pytest.raises(ValueError, match="no such table"):
        warehouse.put_all("silver", {"sl_language": lambda: silver.sl_language(source["language"], NOW), "sl_film": broken})
    assert warehouse.written == []
