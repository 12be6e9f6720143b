"""The registered queries as DuckDB SQL over the same tables, written independently of the Spark plans."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

NOW = "TIMESTAMP '2025-01-01 00:00:00'"
EPOCH = "TIMESTAMP '1995-01-01 00:00:00'"


def uuid(text: str) -> str:
    return rf"regexp_replace(md5({text}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


def key(column: str) -> str:
    return uuid(f"CAST({column} AS VARCHAR)")


def joined(*columns: str) -> str:
    parts = [
        rf"coalesce(replace(replace(CAST({c} AS VARCHAR), '\', '\\'), '|', '\|'), '\N')" for c in columns
    ]
    return f"concat_ws('|', {', '.join(parts)})"


def dec(column: str, type_: str = "DECIMAL(18,2)") -> str:
    return f"CAST({column} AS {type_})"


def empty(names: str, type_: str = "VARCHAR") -> str:
    return ", ".join(f"CAST(NULL AS {type_}) AS {n}" for n in names.split())


# ---------------------------------------------------------------- the rental source

SOURCES = f"""
language AS (SELECT n_nationkey AS language_id, n_name AS name FROM nation),
address AS (
  SELECT n_nationkey AS address_id, n_name AS address, CAST(NULL AS VARCHAR) AS address2, r_name AS district,
         n_regionkey AS city_id, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS postal_code,
         CAST(NULL AS VARCHAR) AS phone
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey),
store AS (
  SELECT n_nationkey AS store_id, manager_staff_id, n_nationkey AS address_id
  FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS manager_staff_id FROM supplier GROUP BY 1) m
    ON s_nationkey = n_nationkey),
film AS (
  SELECT p_partkey AS film_id, p_name AS title, p_name || ' ' || p_type AS description,
         1990 + p_size AS release_year, p_size AS language_id, p_size AS rental_duration,
         CAST(p_size + 0.99 AS DECIMAL(4,2)) AS rental_rate, 60 + p_size AS length,
         CAST(p_retailprice AS DECIMAL(5,2)) AS replacement_cost, p_brand AS rating
  FROM part),
client AS (
  SELECT c_custkey AS customer_id, c_nationkey AS store_id, split_part(c_name, '#', 1) AS first_name,
         split_part(c_name, '#', 2) AS last_name, lower(c_name) || '@example.com' AS email,
         c_nationkey AS address_id, c_acctbal >= 0 AS active
  FROM customer),
staff AS (
  SELECT s_suppkey AS staff_id, split_part(s_name, '#', 1) AS first_name, split_part(s_name, '#', 2) AS last_name,
         s_nationkey AS address_id, lower(s_name) || '@example.com' AS email, s_nationkey AS store_id,
         s_acctbal >= 0 AS active, s_name AS username
  FROM supplier),
inventory AS (
  SELECT l_partkey AS inventory_id, l_partkey AS film_id, s_nationkey AS store_id
  FROM (SELECT l_partkey, min(l_suppkey) AS sup FROM lineitem GROUP BY 1) s LEFT JOIN supplier ON s_suppkey = sup),
rental AS (
  SELECT o_orderkey AS rental_id, o_orderdate AS rental_date, return_date, inventory_id,
         o_custkey AS customer_id, staff_id, coalesce(return_date, o_orderdate) AS last_update
  FROM orders LEFT JOIN (
    SELECT l_orderkey, max(l_shipdate) AS return_date, min(l_partkey) AS inventory_id, min(l_suppkey) AS staff_id
    FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey),
payment AS (
  SELECT l_orderkey AS rental_id,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(12,2)) AS amount
  FROM lineitem),
paid AS (SELECT rental_id, CAST(sum(amount) AS DECIMAL(28,2)) AS revenue_amount FROM payment GROUP BY 1),
enriched AS (
  SELECT r.rental_id, rental_date, return_date, customer_id, staff_id, film_id, store_id,
         CAST(date_diff('microsecond', rental_date, return_date) AS DOUBLE) / CAST(3600000000 AS DOUBLE)
           AS rental_duration_actual,
         revenue_amount, last_update
  FROM rental r LEFT JOIN inventory USING (inventory_id) LEFT JOIN paid USING (rental_id)),
film_m AS (
  SELECT film_id, count(*) AS sl_rental_count,
         CAST(coalesce(sum(revenue_amount), 0) AS DECIMAL(28,2)) AS sl_total_revenue,
         CAST(sum(date_diff('microsecond', rental_date, return_date)) AS DOUBLE) / count(return_date)
           / CAST(3600000000 AS DOUBLE) AS sl_avg_rental_duration
  FROM enriched WHERE film_id IS NOT NULL GROUP BY 1),
store_m AS (
  SELECT e.store_id, CAST(coalesce(sum(revenue_amount), 0) AS DOUBLE) AS sl_total_revenue,
         count(DISTINCT customer_id) AS sl_total_customers,
         count(*) AS sl_total_rentals,
         CAST(sum(rental_rate) AS DOUBLE) / count(rental_rate) AS sl_avg_rental_rate
  FROM enriched e LEFT JOIN film USING (film_id) WHERE e.store_id IS NOT NULL GROUP BY 1),
address_c AS (
  SELECT address_id, CAST(sum(c) AS BIGINT) AS sl_customer_count, CAST(sum(s) AS BIGINT) AS sl_store_count
  FROM (SELECT address_id, 1 AS c, 0 AS s FROM client UNION ALL SELECT address_id, 0, 1 FROM store) GROUP BY 1),
staff_m AS (
  SELECT staff_id, count(DISTINCT r.rental_id) AS total_rentals_processed,
         count(amount) AS total_payments_processed,
         CAST(coalesce(sum(amount), 0) AS DECIMAL(28,2)) AS total_payment_amount,
         CAST(CAST(CAST(sum(amount) AS DOUBLE) / count(amount) AS DECIMAL(18,6)) AS DECIMAL(12,2)) AS avg_payment_amount
  FROM rental r LEFT JOIN payment p ON p.rental_id = r.rental_id WHERE staff_id IS NOT NULL GROUP BY 1),
days AS (
  SELECT CAST(d AS DATE) AS full_date FROM (
    SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM (
      SELECT least((SELECT min(o_orderdate) FROM orders), (SELECT min(l_shipdate) FROM lineitem)) AS lo,
             greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS hi))),
fact AS (
  SELECT e.*, f.rental_duration, f.rental_rate, f.replacement_cost, f.film_id AS f_film, s.store_id AS f_store,
         t.staff_id AS f_staff, d1.full_date AS d1, d2.full_date AS d2
  FROM enriched e LEFT JOIN film f ON f.film_id = e.film_id LEFT JOIN store s ON s.store_id = e.store_id
  LEFT JOIN staff t ON t.staff_id = e.staff_id
  LEFT JOIN days d1 ON d1.full_date = CAST(rental_date AS DATE)
  LEFT JOIN days d2 ON d2.full_date = CAST(return_date AS DATE)),
fact_rental AS (
  SELECT {key('rental_id')} AS gl_fact_rental_key, rental_id,
         {key('f_film')} AS film_key, {key('f_store')} AS store_key, {key('f_staff')} AS staff_key,
         CAST(strftime(d1, '%Y%m%d') AS INTEGER) AS rental_date_key,
         CAST(strftime(d2, '%Y%m%d') AS INTEGER) AS return_date_key,
         CAST(rental_date AS DATE) AS rental_date, rental_date AS rental_datetime,
         CAST(return_date AS DATE) AS return_date, return_date AS return_datetime, rental_duration_actual,
         CAST(rental_duration AS SMALLINT) AS rental_duration_planned, rental_rate, replacement_cost,
         CAST(coalesce(revenue_amount, rental_rate) AS DECIMAL(28,2)) AS revenue_amount,
         extract(dow FROM rental_date) IN (0, 6) AS is_weekend_rental, false AS is_holiday_rental,
         CAST(extract(hour FROM rental_date) AS INTEGER) AS rental_hour,
         CAST(extract(quarter FROM rental_date) AS INTEGER) AS rental_quarter,
         CAST(extract(month FROM rental_date) AS INTEGER) AS rental_month,
         CAST(extract(year FROM rental_date) AS INTEGER) AS rental_year,
         {NOW} AS gl_created_time, {NOW} AS gl_updated_time
  FROM fact)
"""


def rental(sql: str) -> str:
    return f"WITH {SOURCES} {sql}"


def audited(entity: str, id_: str, columns: str, source: str, touched=False, metrics: str = "") -> str:
    middle = f"{NOW} AS last_update," if touched else ""
    link = "CAST(NULL AS VARCHAR) AS sl_source_bronze_key," if touched else ""
    return rental(
        f"""SELECT {key(id_)} AS sl_{entity}_key, CAST({id_} AS BIGINT) AS {id_}, {columns}, {middle}
        {NOW} AS sl_created_time, {NOW} AS sl_updated_time, {link} true AS sl_is_active,
        CAST(NULL AS DOUBLE) AS sl_data_quality_score {metrics} FROM {source}"""
    )


ORACLE["sl_language"] = audited("language", "language_id", "rpad(left(name, 20), 20, ' ') AS name", "language", True)
ORACLE["sl_address"] = audited(
    "address",
    "address_id",
    "left(address, 50) AS address, address2, left(district, 20) AS district, CAST(city_id AS BIGINT) AS city_id, postal_code, phone",
    "address LEFT JOIN address_c USING (address_id)",
    True,
    ", coalesce(sl_customer_count, 0) AS sl_customer_count, coalesce(sl_store_count, 0) AS sl_store_count",
)
ORACLE["sl_store"] = audited(
    "store",
    "store_id",
    "manager_staff_id, CAST(address_id AS BIGINT) AS address_id",
    "store LEFT JOIN store_m USING (store_id)",
    True,
    """, coalesce(sl_total_revenue, 0) AS sl_total_revenue, coalesce(sl_total_customers, 0) AS sl_total_customers,
    coalesce(sl_total_rentals, 0) AS sl_total_rentals, sl_avg_rental_rate""",
)
FILM = """left(title, 255) AS title, description, CAST(release_year AS INTEGER) AS release_year,
  CAST(language_id AS BIGINT) AS language_id, CAST(NULL AS BIGINT) AS original_language_id,
  CAST(rental_duration AS SMALLINT) AS rental_duration, rental_rate, CAST(length AS SMALLINT) AS length,
  replacement_cost, left(rating, 10) AS rating"""
ORACLE["sl_film"] = audited(
    "film",
    "film_id",
    FILM,
    "film LEFT JOIN film_m USING (film_id)",
    True,
    """, coalesce(sl_rental_count, 0) AS sl_rental_count,
    coalesce(sl_total_revenue, CAST(0 AS DECIMAL(28,2))) AS sl_total_revenue, sl_avg_rental_duration""",
)
PERSON = """left(first_name, 45) AS first_name, left(last_name, 45) AS last_name,
  first_name || ' ' || last_name AS full_name, left(email, 50) AS email, CAST(store_id AS BIGINT) AS store_id,
  CAST(address_id AS BIGINT) AS address_id, active AS is_active"""
ORACLE["sl_customer"] = audited(
    "customer", "customer_id", f"{PERSON}, {EPOCH} AS create_date, {EPOCH} AS last_update", "client"
)
ORACLE["sl_staff"] = audited(
    "staff", "staff_id", f"{PERSON}, left(username, 16) AS username, {EPOCH} AS last_update", "staff"
)
ORACLE["sl_inventory"] = audited(
    "inventory", "inventory_id", f"film_id, CAST(store_id AS BIGINT) AS store_id, {EPOCH} AS last_update", "inventory"
)
ORACLE["sl_rental_enriched"] = audited(
    "rental",
    "rental_id",
    """rental_date, return_date, customer_id, staff_id, film_id, CAST(store_id AS BIGINT) AS store_id,
    rental_duration_actual, CAST(NULL AS DOUBLE) AS rental_duration_planned,
    CAST(NULL AS DECIMAL(4,2)) AS rental_rate, CAST(NULL AS DECIMAL(5,2)) AS replacement_cost,
    revenue_amount, last_update""",
    "enriched",
)
ORACLE["film_metrics"] = rental("SELECT * FROM film_m")
ORACLE["store_metrics"] = rental(
    """SELECT CAST(store_id AS BIGINT) AS store_id, sl_total_revenue, sl_total_customers, sl_total_rentals,
    sl_avg_rental_rate FROM store_m"""
)
ORACLE["address_counters"] = rental("SELECT * FROM address_c")
ORACLE["staff_metrics"] = rental("SELECT * FROM staff_m")

ORACLE["dim_film"] = rental(
    f"""SELECT {key('film_id')} AS gl_dim_film_key, film_id, title, description, CAST(release_year AS INTEGER) AS release_year,
    rating, coalesce(rpad(name, 20, ' '), 'Unknown') AS language_name,
    {empty('original_language_name category_names primary_category actor_names lead_actor')},
    CAST(length AS SMALLINT) AS length_minutes, CAST(rental_duration AS SMALLINT) AS rental_duration_days,
    rental_rate, replacement_cost, false AS has_trailers, false AS has_commentaries, false AS has_deleted_scenes,
    false AS has_behind_scenes, 0 AS special_features_count, 0 AS total_inventory_copies,
    coalesce(sl_rental_count, 0) AS total_rentals,
    coalesce(sl_total_revenue, CAST(0 AS DECIMAL(28,2))) AS total_revenue,
    sl_avg_rental_duration AS avg_rental_duration, {empty('rental_frequency popularity_score', 'DOUBLE')},
    {empty('length_category price_tier')}, false AS is_classic, true AS is_currently_available,
    {empty('last_rental_date', 'TIMESTAMP')}, {empty('days_since_last_rental', 'INTEGER')}
    FROM film LEFT JOIN language USING (language_id) LEFT JOIN film_m USING (film_id)"""
)
ORACLE["dim_store"] = rental(
    f"""SELECT {key('store_id')} AS gl_dim_store_key, CAST(store_id AS BIGINT) AS store_id, manager_staff_id,
    '' AS manager_first_name, '' AS manager_last_name, '' AS manager_full_name, {empty('manager_email')},
    address AS address_line1, address2 AS address_line2, district, '' AS city, postal_code, phone, '' AS country,
    {NOW} AS last_update, coalesce(sl_total_customers, 0) AS total_customers,
    coalesce(sl_total_rentals, 0) AS total_rentals, coalesce(sl_total_revenue, 0) AS total_revenue,
    sl_avg_rental_rate AS avg_rental_rate, 0 AS total_inventory_items, 0 AS active_customers,
    {empty('revenue_per_customer', 'DECIMAL(8,2)')},
    {empty('inventory_turnover_rate customer_retention_rate avg_rentals_per_day', 'DOUBLE')},
    {empty('store_tier primary_customer_segment')}, false AS is_flagship_store
    FROM store LEFT JOIN address USING (address_id) LEFT JOIN store_m USING (store_id)"""
)
ORACLE["dim_staff"] = rental(
    f"""SELECT {key('t.staff_id')} AS gl_dim_staff_key, t.staff_id, first_name, last_name,
    first_name || ' ' || last_name AS full_name, left(email, 50) AS email, left(username, 16) AS username,
    active AS is_active, CAST(t.store_id AS BIGINT) AS store_id, a.address AS store_address,
    (t.store_id = s.store_id AND t.staff_id = s.manager_staff_id) AS is_store_manager,
    {empty('store_city address_line1 address_line2 district city postal_code phone country')},
    {EPOCH} AS last_update, coalesce(total_rentals_processed, 0) AS total_rentals_processed,
    coalesce(total_payments_processed, 0) AS total_payments_processed,
    coalesce(total_payment_amount, CAST(0 AS DECIMAL(28,2))) AS total_payment_amount, avg_payment_amount,
    {empty('avg_rentals_per_day avg_payments_per_day customer_satisfaction_score team_performance_score', 'DOUBLE')},
    {empty('performance_tier specialization')}, false AS is_top_performer, {empty('managed_staff_count', 'INTEGER')},
    {empty('store_revenue_under_management', 'DECIMAL(12,2)')}
    FROM staff t LEFT JOIN store s ON s.store_id = t.store_id LEFT JOIN address a ON a.address_id = s.address_id
    LEFT JOIN staff_m m ON m.staff_id = t.staff_id"""
)
ORACLE["dim_date"] = rental(
    """, p AS (SELECT full_date AS d, extract(dow FROM full_date) IN (0, 6) AS we, DATE '2000-01-01' AS t FROM days)
    SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS full_date, CAST(day(d) AS INTEGER) AS day_of_month,
    CAST(dayofyear(d) AS INTEGER) AS day_of_year, CAST(extract(dow FROM d) AS INTEGER) AS day_of_week,
    dayname(d) AS day_name, left(dayname(d), 3) AS day_name_short, CAST(weekofyear(d) AS INTEGER) AS week_of_year,
    CAST((day(d) - 1) // 7 + 1 AS INTEGER) AS week_of_month,
    CASE WHEN we THEN 'Weekend' ELSE 'Weekday' END AS weekday_indicator, CAST(month(d) AS INTEGER) AS month_number,
    monthname(d) AS month_name, left(monthname(d), 3) AS month_name_short, strftime(d, '%Y-%m') AS month_year,
    CAST(quarter(d) AS INTEGER) AS quarter_number, 'Q' || quarter(d) AS quarter_name,
    year(d) || '-Q' || quarter(d) AS quarter_year, CAST(year(d) AS INTEGER) AS year_number, we AS is_weekend,
    NOT we AS is_weekday, false AS is_holiday, NOT we AS is_business_day, CAST(NULL AS VARCHAR) AS holiday_name,
    CAST(NULL AS VARCHAR) AS holiday_type, CAST(year(d) AS INTEGER) AS fiscal_year,
    CAST(quarter(d) AS INTEGER) AS fiscal_quarter, CAST(month(d) AS INTEGER) AS fiscal_month,
    d = t AS is_current_day, date_trunc('week', d) = date_trunc('week', t) AS is_current_week,
    date_trunc('month', d) = date_trunc('month', t) AS is_current_month,
    date_trunc('quarter', d) = date_trunc('quarter', t) AS is_current_quarter, year(d) = year(t) AS is_current_year,
    CAST(date_diff('day', t, d) AS INTEGER) AS days_from_today, last_day(d) = d AS is_month_end,
    last_day(d) = d AND month(d) IN (3, 6, 9, 12) AS is_quarter_end, last_day(d) = d AND month(d) = 12 AS is_year_end,
    (year(d) % 4 = 0 AND year(d) % 100 <> 0) OR year(d) % 400 = 0 AS is_leap_year,
    CASE WHEN month(d) IN (12, 1, 2) THEN 'Winter' WHEN month(d) <= 5 THEN 'Spring'
         WHEN month(d) <= 8 THEN 'Summer' ELSE 'Autumn' END AS season FROM p"""
)
ORACLE["fact_rental"] = rental("SELECT * FROM fact_rental")
ORACLE["fact_rollup"] = rental(
    """SELECT rental_year, rental_quarter, rental_month,
    CAST(grouping(rental_year, rental_quarter, rental_month) AS INTEGER) AS level,
    CAST(sum(revenue_amount) AS DECIMAL(28,2)) AS revenue, count(*) AS rentals,
    count(*) FILTER (is_weekend_rental) AS weekend_rentals
    FROM fact_rental GROUP BY ROLLUP (rental_year, rental_quarter, rental_month)"""
)
ORACLE["rentals_by_hour"] = rental(
    """SELECT is_weekend_rental, rental_hour, CAST(sum(revenue_amount) AS DECIMAL(28,2)) AS revenue, count(*) AS rentals
    FROM fact_rental GROUP BY 1, 2"""
)
ORACLE["overdue_returns"] = rental(
    """SELECT rental_id, first_name, last_name, return_date FROM client JOIN rental USING (customer_id)
    WHERE return_date < DATE '2000-01-01' AND return_date IS NOT NULL"""
)
ORACLE["top_films_by_revenue"] = rental(
    """SELECT f.film_id, f.title, CAST(sum(p.amount) AS DECIMAL(28,2)) AS total_revenue
    FROM film f JOIN inventory i ON f.film_id = i.film_id JOIN rental r ON i.inventory_id = r.inventory_id
    JOIN payment p ON r.rental_id = p.rental_id GROUP BY f.film_id, f.title
    ORDER BY total_revenue DESC, f.film_id LIMIT 10"""
)
ORACLE["customer_value"] = rental(
    """SELECT c.customer_id, c.first_name || ' ' || c.last_name AS customer_name,
    count(DISTINCT r.rental_id) AS rental_count, CAST(sum(p.amount) AS DECIMAL(28,2)) AS lifetime_value
    FROM client c LEFT JOIN rental r ON c.customer_id = r.customer_id LEFT JOIN payment p ON r.rental_id = p.rental_id
    GROUP BY c.customer_id, c.first_name, c.last_name ORDER BY lifetime_value DESC NULLS LAST, c.customer_id"""
)
ORACLE["film_language_check"] = rental(
    """SELECT film_id, title, coalesce(rpad(name, 20, ' '), 'Unknown') AS language_name
    FROM film LEFT JOIN language USING (language_id) ORDER BY film_id LIMIT 5"""
)
ORACLE["facts_without_film"] = rental(
    f"""SELECT 'fact_rental' AS table_name, 'orphans' AS check_name, 'film_key' AS column_name, n AS failing_rows,
    CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
      SELECT count(*) AS n FROM fact_rental fr LEFT JOIN (SELECT {key('film_id')} AS k FROM film) d ON d.k = fr.film_key
      WHERE d.k IS NULL)"""
)
ORACLE["mean_by_category"] = """SELECT event_type,
  CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(value) AS mean_value FROM events GROUP BY 1"""
AMOUNTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ROWS = f"SELECT * REPLACE ({', '.join(f'{dec(c)} AS {c}' for c in AMOUNTS)}) FROM lineitem"
ORACLE["sums_by_category"] = f"""SELECT l_returnflag, {', '.join(
    f"CAST(sum({c}) AS DECIMAL(28,2)) AS {c}" for c in ['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', *AMOUNTS]
)} FROM ({LINE_ROWS}) GROUP BY 1"""
ORACLE["customers_of_orders"] = f"""SELECT o_custkey AS custkey, o_orderkey, {dec('o_totalprice')} AS total, c_name, c_mktsegment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""

# ---------------------------------------------------------------- bronze

ORDERS = f"SELECT * REPLACE ({dec('o_totalprice')} AS o_totalprice) FROM orders"
STAMP = """'2025-01-01T00:00:00.000000' AS bronze_load_timestamp, 'shop' AS bronze_source_system,
  'orders' AS bronze_source_table, '{host}' AS bronze_source_host, '{method}' AS bronze_extraction_method"""
ORACLE["bronze_stamp"] = f"SELECT *, {STAMP.format(host='db.example.com', method='full_snapshot')} FROM ({ORDERS})"
ORACLE["json_round_trip"] = f"SELECT *, {STAMP.format(host='db', method='full_snapshot')} FROM ({ORDERS})"
ORACLE["incremental_scan"] = f"""SELECT *, {STAMP.format(host='db.example.com', method='incremental')}
  FROM ({ORDERS}) WHERE o_orderdate > TIMESTAMP '2000-06-30 00:00:00'"""
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def as_text(columns: list[str]) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)


def batch(source: str, columns: list[str], table: str, batch_id: str) -> str:
    return f"""SELECT {as_text(columns)}, {NOW} AS br_load_time, '{table}' AS br_source_table,
    '{batch_id}' AS br_batch_id, true AS br_is_current, md5({joined(*columns)}) AS br_record_hash FROM ({source})"""


ORACLE["bronze_batch"] = batch(ORDERS, ORDER_COLUMNS, "orders", "batch-1")
ORACLE["record_hash"] = f"""SELECT c_custkey, md5({joined('c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment')})
  AS br_record_hash FROM (SELECT * REPLACE ({dec('c_acctbal')} AS c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment)
  FROM customer)"""
ORACLE["document_hash"] = f"""SELECT doc_id, md5({joined('doc_id', 'text', 'lang', 'source', 'n_chars')}) AS br_record_hash
  FROM documents"""
ORACLE["surrogate_keys"] = f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {key('l_orderkey')} AS order_key,
  {uuid(joined('l_orderkey', 'l_linenumber', 'l_partkey'))} AS line_key FROM lineitem"""
ORACLE["filtered_scan"] = f"""SELECT * FROM ({LINE_ROWS}) WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_suppkey = 1
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100"""
ORACLE["equality_filter"] = f"SELECT * FROM ({ORDERS}) WHERE o_orderstatus = 'F'"
ORACLE["top_rows"] = f"SELECT * FROM ({ORDERS}) ORDER BY o_orderkey LIMIT 1000"
ORACLE["next_marks"] = """SELECT 'orders' AS source_table, max(o_orderdate) AS mark FROM orders UNION ALL
  SELECT 'lineitem', max(l_shipdate) FROM lineitem UNION ALL SELECT 'events', max(ts) FROM events"""
STARS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS source_table, count(*) AS row_count FROM {t}" for t in STARS)
ORACLE["scan_summaries"] = f"SELECT *, least(row_count, 1000) AS sample_rows_read FROM ({COUNTS})"
ORACLE["ingestion_log"] = f"""SELECT source_table, 'staging' AS target_schema, row_count, {NOW} AS ingestion_time,
  'run-1' AS run_id, CASE WHEN row_count IS NULL THEN 'failed' ELSE 'success' END AS status
  FROM ({COUNTS} UNION ALL SELECT 'missing_table', NULL)"""
ORACLE["csv_round_trip"] = f"SELECT * REPLACE ({dec('s_acctbal')} AS s_acctbal) FROM supplier"
ORACLE["partitioned_snapshot"] = f"""SELECT *, CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST(month(o_orderdate) AS INTEGER) AS month FROM ({ORDERS})"""

LANDED = ["language", "address", "store", "film", "customer", "staff", "inventory", "rental", "payment"]
ORACLE["tenant_run"] = rental(
    " UNION ALL ".join(
        f"SELECT '{tenant}' AS tenant, 'staging' AS layer, 'br_{t}' AS table_name, count(*) AS row_count "
        f"FROM {'client' if t == 'customer' else t} {f'WHERE rental_id % 2 = {rest}' if t in ('rental', 'payment') else ''}"
        for rest, tenant in enumerate(["even_rentals", "odd_rentals"])
        for t in LANDED
    )
)
ORACLE["tenant_build"] = rental(
    "SELECT *, CASE WHEN rental_id % 2 = 0 THEN 'even_rentals' ELSE 'odd_rentals' END AS tenant FROM fact_rental"
)
BUILT = {
    "staging": {
        "br_language": "language", "br_address": "address", "br_store": "store", "br_film": "film",
        "br_customer": "client", "br_staff": "staff", "br_inventory": "inventory", "br_rental": "rental",
        "br_payment": "payment",
    },
    "silver": {
        "sl_language": "language", "sl_address": "address", "sl_store": "store", "sl_film": "film",
        "sl_customer": "client", "sl_staff": "staff", "sl_inventory": "inventory", "sl_rental_enriched": "rental",
    },
    "gold": {
        "dim_film": "film", "dim_store": "store", "dim_staff": "staff", "dim_date": "days", "fact_rental": "rental",
    },
}
ORACLE["warehouse_build"] = rental(
    " UNION ALL ".join(
        f"SELECT '{layer}' AS layer, '{name}' AS table_name, count(*) AS row_count FROM {source}"
        for layer, tables in BUILT.items()
        for name, source in tables.items()
    ).replace("FROM days", "FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) FROM (SELECT "
              "least(min(rental_date), min(return_date)) AS lo, greatest(max(rental_date), max(return_date)) AS hi "
              "FROM rental))")
)

# ---------------------------------------------------------------- conform, stack, merge

ORACLE["silver_cast"] = """SELECT p_partkey, left(p_name, 8) AS p_name, rpad(left(p_brand, 12), 12, ' ') AS p_brand,
  CAST(NULL AS BOOLEAN) AS p_type, CAST(p_size AS SMALLINT) AS p_size,
  TRY_CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(4,2)) AS p_retailprice FROM part"""
ORACLE["cast_rejects"] = """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_type,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS p_retailprice,
  concat_ws(',', CASE WHEN length(p_name) > 8 THEN 'cut:p_name' END, CASE WHEN length(p_brand) > 12 THEN 'cut:p_brand' END,
    'cast:p_type', CASE WHEN p_retailprice >= 100 THEN 'cast:p_retailprice' END) AS failed_checks FROM part"""
PARTIES = f"""SELECT upper(c_name) AS name, lower(c_name) || '@sales.example.com' AS email, c_nationkey AS nation_id,
    {dec('c_acctbal')} AS balance, c_mktsegment AS segment, 'sales' AS source_system FROM customer
  UNION ALL SELECT upper(s_name), lower(s_name) || '@buying.example.com', s_nationkey, {dec('s_acctbal')}, NULL, 'purchasing'
  FROM supplier"""
ORACLE["party_stack"] = PARTIES
ORACLE["party_dedup"] = f"""SELECT *, balance >= 0 AS in_credit FROM ({PARTIES}) QUALIFY row_number() OVER (
  PARTITION BY nation_id, balance >= 0 ORDER BY source_system = 'sales', balance DESC, name DESC) = 1"""
NEWEST = """SELECT * FROM orders QUALIFY row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
ORACLE["upsert"] = f"""SELECT c_custkey AS custkey, o_orderkey AS last_order,
  coalesce({dec('o_totalprice')}, {dec('c_acctbal')}) AS amount FROM customer LEFT JOIN ({NEWEST}) ON o_custkey = c_custkey"""
ORACLE["latest_order_per_customer"] = f"SELECT * REPLACE ({dec('o_totalprice')} AS o_totalprice) FROM ({NEWEST})"
SUPPLIERS = f"""SELECT s_suppkey, s_name,
  CASE WHEN s_acctbal < 0 THEN TIMESTAMP '2025-02-01 00:00:00' END AS inactivated_date,
  CASE WHEN s_acctbal < 0 THEN TIMESTAMP '2025-02-01 00:00:00' ELSE {NOW} END AS systime FROM supplier"""
ORACLE["soft_delete"] = SUPPLIERS
ORACLE["active_rows"] = f"SELECT * FROM ({SUPPLIERS}) WHERE inactivated_date IS NULL"
ORACLE["inactive_rows"] = f"SELECT * FROM ({SUPPLIERS}) WHERE inactivated_date IS NOT NULL"
ORACLE["table_kinds"] = f"""SELECT *, {NOW} AS created_at,
  TIMESTAMP '2025-02-01 00:00:00' AS updated_at, o_orderdate AS effective_time, {NOW} AS systime FROM ({ORDERS})"""
ORACLE["mapped_load"] = f"""SELECT upper(c_name) AS name, lower(c_name) || '@sales.example.com' AS email,
  c_nationkey AS nation_id, {dec('c_acctbal')} AS balance, c_mktsegment AS segment FROM customer"""

# ---------------------------------------------------------------- quality


def line(table: str, check: str, column: str, count: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{check}' AS check_name, '{column}' AS column_name,
    CAST(n AS BIGINT) AS failing_rows, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT ({count}) AS n)"""


def nulls(table: str, source: str, *columns: str) -> list[str]:
    return [line(table, "not_null", c, f"SELECT count(*) FROM {source} WHERE {c} IS NULL") for c in columns]


def unique(table: str, source: str, columns: str) -> str:
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns.split(","))
    return line(
        table, "unique", columns,
        f"SELECT count(*) FROM (SELECT {columns} FROM {source} WHERE {known} GROUP BY {columns} HAVING count(*) > 1)",
    )


def related(table: str, child: str, column: str, parent: str, field: str, check: str = "relationships") -> str:
    known = f"c.{column} IS NOT NULL AND" if check == "relationships" else ""
    return line(
        table, check, column,
        f"SELECT count(*) FROM {child} c WHERE {known} NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{field} = c.{column})",
    )


def union(lines: list[str]) -> str:
    return " UNION ALL ".join(lines)


ORACLE["quality_report"] = union(
    [
        *nulls("customer", "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
        line("customer", "accepted_values", "c_mktsegment",
             "SELECT count(*) FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD')"),
        *nulls("orders", "orders", *ORDER_COLUMNS),
        line("orders", "accepted_values", "o_orderstatus", "SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"),
        unique("customer", "customer", "c_custkey"),
        unique("orders", "orders", "o_orderkey"),
        unique("lineitem", "lineitem", "l_orderkey,l_linenumber"),
        related("orders", "orders", "o_custkey", "customer", "c_custkey"),
        related("lineitem", "lineitem", "l_orderkey", "orders", "o_orderkey"),
        line("lineitem", "row_count_match", "*", "SELECT abs((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM orders))"),
    ]
)
KEYED = {
    "sl_language": ("language", "language_id"), "sl_address": ("address", "address_id"), "sl_store": ("store", "store_id"),
    "sl_film": ("film", "film_id"), "sl_customer": ("client", "customer_id"), "sl_staff": ("staff", "staff_id"),
    "sl_inventory": ("inventory", "inventory_id"), "sl_rental_enriched": ("enriched", "rental_id"),
    "dim_film": ("film", "film_id"), "dim_store": ("store", "store_id"), "dim_staff": ("staff", "staff_id"),
    "dim_date": ("(SELECT strftime(full_date, '%Y%m%d') AS date_key FROM days)", "date_key"),
    "fact_rental": ("fact_rental", "gl_fact_rental_key"),
}
ORACLE["model_checks"] = rental(
    union(
        [x for name, (source, id_) in KEYED.items() for x in (*nulls(name, source, id_), unique(name, source, id_))]
        + nulls("sl_customer", "client", "email")
        + [
            related("sl_rental_enriched", "enriched", "film_id", "film", "film_id"),
            related("sl_rental_enriched", "enriched", "store_id", "store", "store_id"),
            related("sl_rental_enriched", "enriched", "staff_id", "staff", "staff_id"),
            related("fact_rental", "fact_rental", "film_key", f"(SELECT {key('film_id')} AS k FROM film)", "k"),
        ]
    )
)
ORACLE["landed_match"] = union([line(t, "row_count_match", "*", "SELECT 0") for t in STARS])
EXPECTED = "(VALUES ('region', 5), ('nation', 24), ('orders', NULL), ('lineitem', NULL), ('missing_table', NULL))"
ORACLE["row_count_check"] = f"""SELECT table_name, coalesce(row_count, 0) AS row_count, CAST(expected AS BIGINT) AS expected,
  CASE WHEN coalesce(row_count, 0) = 0 THEN 'FAIL' WHEN expected IS NULL OR row_count = expected THEN 'PASS' ELSE 'WARN' END AS status
  FROM {EXPECTED} e(table_name, expected) LEFT JOIN ({COUNTS}) ON source_table = table_name"""
LINES = """(SELECT CASE WHEN l_returnflag <> 'R' THEN l_orderkey END AS order_ref, l_linenumber, l_partkey FROM lineitem)"""
FINISHED = "(SELECT * FROM orders WHERE o_orderstatus = 'F')"
ORACLE["orphan_lines"] = union(
    [related("lines", LINES, "order_ref", FINISHED, "o_orderkey", c) for c in ("relationships", "orphans")]
)
ORACLE["orphan_rows"] = f"SELECT c.* FROM {LINES} c LEFT JOIN {FINISHED} p ON o_orderkey = order_ref WHERE o_orderkey IS NULL"
ORACLE["bronze_check"] = union(
    [
        *[line("orders", "not_null", f"bronze_{c}", "SELECT 0") for c in ("load_timestamp", "source_system", "source_table")],
        line("orders", "not_null", "bronze_source_host", "SELECT count(*) FROM orders WHERE o_orderstatus = 'O'"),
        line("orders", "not_null", "bronze_extraction_method", "SELECT 0"),
        line("orders", "accepted_values", "bronze_extraction_method", "SELECT count(*) FROM orders WHERE o_orderstatus = 'P'"),
    ]
)
ORACLE["contract_check"] = union(
    [
        line("part", "missing_column", "p_container", "SELECT 1"),
        line("part", "extra_column", "p_comment", "SELECT 1"),
        line("part", "cast", "p_partkey", "SELECT 0"),
        line("part", "cut", "p_name", "SELECT count(*) FROM part WHERE length(p_name) > 8"),
        line("part", "cut", "p_brand", "SELECT count(*) FROM part WHERE length(p_brand) > 12"),
        line("part", "cast", "p_type", "SELECT count(*) FROM part"),
        line("part", "cast", "p_size", "SELECT count(*) FROM part WHERE p_size > 32767"),
        line("part", "cast", "p_retailprice", "SELECT count(*) FROM part WHERE CAST(p_retailprice AS DECIMAL(18,2)) >= 1000"),
    ]
)
ORACLE["quality_score"] = """SELECT o_orderkey, (CAST(o_custkey IS NOT NULL AS INTEGER) + CAST(o_orderstatus IN ('F', 'O') AS INTEGER)
  + CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) + CAST(o_totalprice > 100000 AS INTEGER)) / CAST(4 AS DOUBLE)
  AS sl_data_quality_score FROM orders"""
PROFILE = union(
    [
        f"""SELECT 'orders' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
        count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value
        FROM ({ORDERS})"""
        for c in ORDER_COLUMNS
    ]
)
ORACLE["profile"] = PROFILE
ORACLE["profile_one_pass"] = f"SELECT * EXCLUDE (distinct_count) FROM ({PROFILE})"
ORACLE["history_pair_check"] = union(
    [
        line("accounts", "tracked_column_missing", "segment", "SELECT 1"),
        line("accounts", "excluded_column_present", "holder_cache", "SELECT 1"),
        """SELECT 'accounts', 'tracked_columns', '*', CAST(5 AS BIGINT), 'PASS'""",
        """SELECT 'accounts', 'excluded_columns', '*', CAST(1 AS BIGINT), 'PASS'""",
    ]
)

# ---------------------------------------------------------------- history

ACCOUNTS = f"""before AS (
  SELECT c_custkey AS account_id, c_name AS holder, c_nationkey AS nation_id, {dec('c_acctbal')} AS balance,
         c_mktsegment AS segment, lower(c_name) AS holder_cache FROM customer),
charged AS (SELECT o_custkey, sum({dec('o_totalprice')}) AS charged FROM orders
            WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1),
later AS (
  SELECT account_id, holder, nation_id, CAST(balance - coalesce(charged, 0) AS DECIMAL(18,2)) AS balance,
         nullif(segment, 'MACHINERY') AS segment, upper(holder) AS holder_cache
  FROM before LEFT JOIN charged ON o_custkey = account_id WHERE balance >= 0 OR charged IS NOT NULL
  UNION ALL
  SELECT -s_suppkey - 1, s_name, s_nationkey, {dec('s_acctbal')}, 'SUPPLIER', upper(s_name) FROM supplier),
ops AS (
  SELECT 'INSERT' AS operation_type, n.* FROM later n WHERE account_id NOT IN (SELECT account_id FROM before)
  UNION ALL SELECT 'DELETE', o.* FROM before o WHERE account_id NOT IN (SELECT account_id FROM later)
  UNION ALL SELECT 'UPDATE', n.* FROM later n JOIN before o USING (account_id)
    WHERE o.holder IS DISTINCT FROM n.holder OR o.nation_id IS DISTINCT FROM n.nation_id
       OR o.balance IS DISTINCT FROM n.balance OR o.segment IS DISTINCT FROM n.segment)"""
ORACLE["snapshot_diff"] = f"""WITH {ACCOUNTS} SELECT account_id, holder, nation_id, balance, segment,
  {uuid(joined('account_id', "'batch-1'", 'operation_type'))} AS history_id, {NOW} AS effective_time, {NOW} AS systime,
  operation_type FROM ops"""
ORACLE["apply_history"] = f"WITH {ACCOUNTS} SELECT account_id, holder, nation_id, balance, segment FROM later"
ORACLE["latest_snapshot"] = f"WITH {ACCOUNTS} SELECT * FROM later"

HISTORY = f"""changes AS (
  SELECT user_id, event_type, ts, event_id, lag(event_type) OVER w AS before, row_number() OVER w AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
history AS (
  SELECT user_id, event_type, event_id, ts AS effective_time, {NOW} AS systime,
         CASE WHEN n = 1 THEN 'INSERT' ELSE 'UPDATE' END AS operation_type
  FROM changes WHERE n = 1 OR event_type IS DISTINCT FROM before),
spans AS (
  SELECT user_id, event_type, effective_time AS valid_from,
         lead(effective_time) OVER (PARTITION BY user_id ORDER BY effective_time, event_id) AS valid_to FROM history),
versions AS (SELECT *, valid_to IS NULL AS is_current FROM spans WHERE valid_to IS NULL OR valid_from < valid_to)"""
HISTORY_ID = uuid(joined("user_id", "event_id", "operation_type"))
HISTORY_ROWS = f"""WITH {HISTORY} SELECT user_id, event_type, {HISTORY_ID} AS history_id, effective_time, systime, operation_type
  FROM history"""
ORACLE["history_from_events"] = HISTORY_ROWS
ORACLE["stream_history"] = HISTORY_ROWS
ORACLE["stream_history_batches"] = HISTORY_ROWS
ORACLE["history_append"] = f"SELECT *, CAST(effective_time AS DATE) AS effective_date FROM ({HISTORY_ROWS})"
ORACLE["history_with_deletes"] = f"""WITH changes AS (
  SELECT user_id, event_type, ts, event_id, lag(event_type) OVER w AS before
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  ops AS (SELECT *, CASE WHEN event_type = 'error' THEN CASE WHEN before <> 'error' THEN 'DELETE' END
    WHEN before IS NULL OR before = 'error' THEN 'INSERT' WHEN event_type <> before THEN 'UPDATE' END AS operation_type FROM changes)
  SELECT user_id, CASE WHEN operation_type = 'DELETE' THEN before ELSE event_type END AS event_type,
  {HISTORY_ID} AS history_id, ts AS effective_time, {NOW} AS systime, operation_type FROM ops WHERE operation_type IS NOT NULL"""
ORACLE["scd2_from_events"] = f"WITH {HISTORY} SELECT * FROM versions"
ORACLE["scd2_busy_users"] = f"WITH {HISTORY} SELECT * FROM versions"
ORACLE["as_of_read"] = f"""WITH {HISTORY} SELECT * FROM versions WHERE valid_from <= TIMESTAMP '2024-01-15 12:00:00'
  AND (valid_to IS NULL OR TIMESTAMP '2024-01-15 12:00:00' < valid_to)"""
ORACLE["as_of_lookup"] = f"""WITH {HISTORY},
  probes AS (SELECT event_id, user_id, ts - INTERVAL 1 HOUR AS asked_at FROM events)
  SELECT p.event_id, p.user_id, p.asked_at, v.event_type AS as_of_event_type, v.valid_from AS as_of_valid_from
  FROM probes p ASOF LEFT JOIN versions v ON p.user_id = v.user_id AND p.asked_at >= v.valid_from"""
ORACLE["as_of_lookup_busy_users"] = ORACLE["as_of_lookup"]
ORACLE["rebuild_current"] = """SELECT user_id, event_type FROM events QUALIFY row_number() OVER (
  PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
ORACLE["reconcile"] = "SELECT user_id, event_type AS operation_type FROM events WHERE false"

ORACLE["reconcile_spoiled"] = f"""WITH newest AS ({ORACLE['rebuild_current']})
  SELECT user_id, 'DELETE' AS operation_type FROM newest WHERE user_id % 5 = 0
  UNION ALL SELECT user_id, 'UPDATE' FROM newest WHERE user_id % 5 = 1
  UNION ALL SELECT -user_id - 1, 'INSERT' FROM newest WHERE user_id % 5 = 2"""
ORACLE["record_hash_arrays"] = """SELECT p_partkey, CAST(4 AS BIGINT) AS forms,
  CAST(CASE WHEN p_type LIKE '% %' THEN 4 ELSE 3 END AS BIGINT) AS hashes FROM part"""
ORACLE["record_hash_prefixed"] = batch(
    "SELECT p_partkey, p_brand AS br_code, p_type AS bronze_kind FROM part", ["p_partkey", "br_code", "bronze_kind"], "parts", "batch-1"
)

# ---------------------------------------------------------------- streams

EVENTS = f"SELECT * REPLACE ({dec('value')} AS value) FROM events"
EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
ORACLE["stream_landing"] = batch(EVENTS, EVENT_COLUMNS, "events", "stream-0")
ORACLE["stream_landing_once"] = ORACLE["stream_landing"]
ORACLE["stream_without_repeats"] = f"SELECT *, md5({joined(*EVENT_COLUMNS)}) AS br_record_hash FROM ({EVENTS})"

RECENT = "ts >= TIMESTAMP '2024-01-20 00:00:00'"
ORACLE["stream_late_rows"] = f"""SELECT event_id, ts, CASE WHEN {RECENT} THEN 'stream-0' ELSE 'stream-1' END AS br_batch_id,
  NOT ({RECENT}) AND ts < (SELECT max(ts) FROM events WHERE {RECENT}) - INTERVAL 7 DAY AS late FROM events"""
ORACLE["stream_landing_two_sources"] = """SELECT event_id, name || '-0' AS br_batch_id FROM events, (VALUES ('first'), ('second')) n(name)"""
ORACLE["stream_history_null_times"] = f"""WITH events AS (SELECT * REPLACE (CASE WHEN event_id % 3 <> 0 THEN ts END AS ts) FROM events),
  {HISTORY.replace('ORDER BY ts, event_id', 'ORDER BY ts NULLS FIRST, event_id')}
  SELECT user_id, event_type, {HISTORY_ID} AS history_id, effective_time, systime, operation_type FROM history"""

# ---------------------------------------------------------------- generated rows


def share(seed: int, label: str, *ids: str) -> str:
    text = " || '|' || ".join([f"'{seed}|{label}'", *[f"CAST({i} AS VARCHAR)" for i in ids]])
    return f"(CAST('0x' || left(md5({text}), 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def whole(seed: int, label: str, low: int, high: int, *ids: str) -> str:
    return f"CAST(floor({share(seed, label, *ids)} * {high - low + 1}) + {low} AS INTEGER)"


def one_of(seed: int, label: str, values: list[str], *ids: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[{whole(seed, label, 1, len(values), *ids)}]"


def later(start: str, seed: int, label: str, days, hours, minutes, id_: str) -> str:
    total = (
        f"{whole(seed, label + '_days', *days, id_)} * 1440 + {whole(seed, label + '_hours', *hours, id_)} * 60"
        f" + {whole(seed, label + '_minutes', *minutes, id_)}"
    )
    return f"({start} + to_minutes({total}))"


def before(days: int) -> str:
    return f"({NOW} - INTERVAL {days} DAY)"


def transactions(source: str, id_: str, seed: int) -> str:
    created = later(before(30), seed, "created", (0, 30), (0, 23), (0, 59), id_)
    updated = later("created_at", seed, "updated", (1, 5), (0, 23), (0, 0), id_)
    return f"""SELECT *, updated_at AS systime FROM (SELECT *,
      CASE WHEN {share(seed, 'changed', id_)} < 0.3 THEN {updated} ELSE created_at END AS updated_at
      FROM (SELECT *, {created} AS created_at FROM ({source})))"""


COUNTRIES = [
    "United States", "Canada", "United Kingdom", "Germany", "France", "Japan", "Australia", "Brazil", "India", "China",
    "Mexico", "Italy", "Spain", "Netherlands", "Sweden", "Norway", "Switzerland", "Austria", "Belgium", "Denmark",
]
NAMES = {
    "first": ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gita", "Hugo"],
    "last": ["Adler", "Brook", "Costa", "Dietz", "Evans", "Fabre", "Gupta", "Holm"],
}


def person(seed: int, label: str, id_: str) -> str:
    first, last = (one_of(seed, f"{label}_{part}", NAMES[part], id_) for part in ("first", "last"))
    return f"({first} || ' ' || {last})"


def reference(source: str, id_: str, seed: int) -> str:
    return f"""SELECT *, CASE WHEN {share(seed, 'inactive', id_)} < 0.2 THEN {NOW} END AS inactivated_date,
    {NOW} AS systime FROM ({source})"""


ORACLE["synth_reference"] = reference("SELECT c_custkey FROM customer", "c_custkey", 1)
LISTED = ", ".join(f"'{c}'" for c in COUNTRIES)
ORACLE["synth_countries"] = reference(
    f"""SELECT s_suppkey, name, upper(left(name, 2)) AS code, true AS active
    FROM (SELECT s_suppkey, ([{LISTED}])[s_suppkey % 20 + 1] AS name FROM supplier)""",
    "s_suppkey",
    2,
)
ORACLE["synth_transactions"] = transactions("SELECT o_orderkey FROM orders", "o_orderkey", 3)
SYMBOLS = ["AAPL", "GOOGL", "MSFT", "AMZN", "TSLA", "NVDA", "META", "NFLX"]
ORACLE["synth_trades"] = transactions(
    f"""SELECT o_orderkey, {one_of(4, 'symbol', SYMBOLS, 'o_orderkey')} AS symbol,
    {whole(4, 'quantity', 1, 1000, 'o_orderkey')} AS quantity,
    CAST({whole(4, 'price', 5000, 50000, 'o_orderkey')} * 0.01 AS DECIMAL(12,2)) AS price,
    {one_of(4, 'side', ['BUY', 'SELL'], 'o_orderkey')} AS side FROM orders""",
    "o_orderkey",
    4,
)
ORACLE["synth_temporal"] = f"""SELECT c_custkey, {later(before(60), 5, 'effective', (0, 60), (0, 23), (0, 59), 'c_custkey')}
  AS effective_time, {NOW} AS systime FROM customer"""
ORACLE["synth_versions"] = f"""SELECT c_custkey, version,
  {before(30)} + to_hours((version - 1) * 120 + {whole(6, 'hour', 9, 17, 'c_custkey', 'version')}) AS effective_time,
  {NOW} AS systime FROM customer, (VALUES (1), (2), (3)) v(version)"""
ORACLE["synth_columns"] = f"""SELECT c_custkey AS id, {person(7, 'name', 'c_custkey')} AS name,
  lower(replace({person(7, 'email', 'c_custkey')}, ' ', '.')) || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
  {whole(7, 'amount', 0, 100000, 'c_custkey')} / CAST(100 AS DOUBLE) AS amount,
  {later(before(30), 7, 'created', (0, 29), (0, 23), (0, 59), 'c_custkey')} AS created FROM customer"""


def noisy(column: str, value: str) -> str:
    return f"CASE WHEN NOT {share(9, 'noise_' + column, 'p_partkey')} < 0.1 THEN {value} END AS {column}"


ORACLE["synth_for_schema"] = f"""SELECT p_partkey,
  {', '.join(noisy(c, person(8, c, 'p_partkey')) for c in ('p_name', 'p_brand', 'p_type'))},
  {noisy('p_size', whole(8, 'p_size', 0, 100, 'p_partkey'))},
  {noisy('p_retailprice', whole(8, 'p_retailprice', 0, 100000, 'p_partkey') + ' / CAST(100 AS DOUBLE)')} FROM part"""

# ---------------------------------------------------------------- tables kept up to date

ORACLE["keyed_merge"] = ORACLE["upsert"]
ORACLE["keyed_merge_files"] = """WITH near AS (
  SELECT count(*) AS n FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders) + 20), total AS (SELECT count(*) AS n FROM orders)
  SELECT CAST(v AS INTEGER) AS version, CAST(total.n - CASE WHEN v = 3 THEN near.n ELSE 0 END AS BIGINT) AS rows,
    CAST(CASE WHEN v IN (2, 3) THEN 1 ELSE 0 END AS INTEGER) AS rewritten, v > 1 AS most_kept
  FROM near, total, (SELECT unnest([1, 2, 3, 4]) AS v)"""
ORACLE["scd2_incremental"] = ORACLE["scd2_from_events"]
ORACLE["digest_diff"] = ORACLE["snapshot_diff"]
ORACLE["digest_shares"] = """SELECT pair, 2 * (SELECT count(*) FROM orders) AS rows, pair = 'first-changed' AS differ, true AS reads_less
  FROM (SELECT unnest(['first-same', 'first-changed']) AS pair)"""
ORACLE["stream_history_corrected"] = ORACLE["history_with_deletes"]
ORACLE["stream_landing_unique"] = ORACLE["stream_without_repeats"]
ORACLE["rollup_maintained"] = rental(
    """SELECT rental_year, rental_quarter, rental_month,
    CAST(grouping(rental_year, rental_quarter, rental_month) AS INTEGER) AS level,
    CAST(sum(revenue_amount) AS DECIMAL(28,2)) AS revenue, count(*) AS rentals, count(*) FILTER (is_weekend_rental) AS weekend_rentals,
    CAST(min(revenue_amount) AS DECIMAL(28,2)) AS least_revenue_amount, CAST(max(revenue_amount) AS DECIMAL(28,2)) AS largest_revenue_amount
    FROM fact_rental GROUP BY ROLLUP (rental_year, rental_quarter, rental_month)"""
)
ORACLE["sketch_profile"] = f"""SELECT column_name, row_count, null_count, min_value, max_value, true AS distinct_close, true AS median_close,
  true AS heavy_close FROM ({PROFILE}) WHERE column_name IN ('o_custkey', 'o_orderdate', 'o_orderpriority', 'o_totalprice')"""
ORACLE["even_ranges"] = "SELECT count(*) AS rows, true AS every_row_in_a_range, true AS even, true AS none_empty FROM lineitem"
ORACLE["bulk_load_resumed"] = f"SELECT o_orderkey, o_custkey, {dec('o_totalprice')} AS total FROM orders"
