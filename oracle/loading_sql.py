"""Oracle SQL (DuckDB) for load, inspection and quality queries."""

from oracle.fixture_sql import CTES, FACT_DEPS, FLAT_DEPS, STAR_DEPS
from oracle.sqlkit import big, ymd, with_ctes

# column of the flat fact -> its expression over the oracle's flat_fact
FLAT_COLUMNS = {c: c for c in (
    "shipment_id date_key city postcode_pc4 dispatch_date dispatch_datetime delivery_datetime month_name year_num "
    "yr_month warehouse_id carrier vehicle_type order_value_eur weight_kg attempt_1_status attempt_2_status "
    "fail_reason final_status delivery_cost_eur route_km co2_emission_kg temp_celsius rain_mm wind_speed_kmh "
    "is_first_attempt_fail is_returned is_peak_period is_zero_emission is_multi_attempt").split()}
FLAT_COLUMNS["product_category"] = "category_name"
VEHICLES = "('Cargo Bike', 'Electric Van', 'Diesel Van', 'Cargo Van')"

SQL = {}

SQL["calendar_span"] = with_ctes(CTES, FACT_DEPS, """
SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS BIGINT) AS date_key, strftime(d, '%Y-%m-%d') AS full_date,
       CAST(year(d) AS BIGINT) AS year, CAST(quarter(d) AS BIGINT) AS quarter,
       CAST(month(d) AS BIGINT) AS month_number, monthname(d) AS month_name,
       CAST(weekofyear(d) AS BIGINT) AS week_number, CAST(isodow(d) AS BIGINT) AS day_of_week_number,
       dayname(d) AS day_of_week_name, CAST(day(d) AS BIGINT) AS day_of_month, isodow(d) >= 6 AS is_weekend,
       hol IS NOT NULL AS is_public_holiday, hol AS holiday_name, month(d) IN (11, 12) AS is_peak_period,
       CASE WHEN month(d) IN (11, 12) THEN 'Q4 peak' END AS peak_event_name,
       strftime(d, '%Y-%m') AS year_month, CAST(year(d) AS VARCHAR) || '-Q' || CAST(quarter(d) AS VARCHAR) AS year_quarter
FROM (SELECT d, CASE month(d) * 100 + day(d) WHEN 101 THEN 'New Year''s Day' WHEN 427 THEN 'King''s Day'
                     WHEN 1225 THEN 'Christmas Day' WHEN 1226 THEN 'Second Christmas Day' END AS hol
      FROM (SELECT CAST(unnest(generate_series(date_trunc('year', lo), date_trunc('year', hi) + INTERVAL 1 YEAR
                                               - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d
            FROM (SELECT MIN(CAST(dispatch_datetime AS DATE)) AS lo, MAX(CAST(dispatch_datetime AS DATE)) AS hi
                  FROM fact)))""")

SQL["profile_deliveries"] = with_ctes(CTES, FLAT_DEPS, "\nUNION ALL\n".join(
    f"SELECT COUNT(*) AS row_count, {len(FLAT_COLUMNS)} AS column_count, '{c}' AS column_name, "
    f"COUNT(*) - COUNT({e}) AS null_count FROM flat_fact" for c, e in FLAT_COLUMNS.items()))

SQL["dispatch_range"] = with_ctes(CTES, FLAT_DEPS, f"""
SELECT {ymd('MIN(dispatch_date)')} AS min_value, {ymd('MAX(dispatch_date)')} AS max_value FROM flat_fact""")

SQL["city_list"] = with_ctes(CTES, FLAT_DEPS, "SELECT DISTINCT city FROM flat_fact")

SQL["fail_reason_counts"] = with_ctes(CTES, FLAT_DEPS, """
SELECT fail_reason, COUNT(*) AS count FROM flat_fact GROUP BY fail_reason
ORDER BY count DESC, fail_reason NULLS FIRST LIMIT 5""")

SQL["peak_event_counts"] = with_ctes(CTES, ["forecast", "forecast_full"], """
SELECT peak_event_name AS peak_event, COUNT(*) AS count FROM forecast_full GROUP BY peak_event_name
ORDER BY count DESC, peak_event NULLS FIRST LIMIT 5""")

SQL["verify_counts"] = with_ctes(
    CTES, FLAT_DEPS + ["dim_driver", "inv_base", "inventory", "forecast", "dim_date"], """
SELECT 'dim_postcodes' AS table_name, COUNT(*) AS row_count FROM dim_postcode
UNION ALL SELECT 'dim_drivers', COUNT(*) FROM dim_driver
UNION ALL SELECT 'fact_deliveries', COUNT(*) FROM flat_fact
UNION ALL SELECT 'warehouse_inventory', COUNT(*) FROM inventory
UNION ALL SELECT 'daily_volume_forecast', COUNT(*) FROM forecast
UNION ALL SELECT 'kpi_summary', COUNT(*) FROM (
    SELECT DISTINCT d.year_month, p.city FROM fact f JOIN dim_date d ON f.date_key = d.date_key
    JOIN dim_postcode p ON f.postcode_pc4 = p.postcode_pc4)""")

SQL["verify_load"] = with_ctes(CTES, STAR_DEPS + ["dim_driver"], """
, pair AS (
  SELECT 'fact_deliveries' AS t, (SELECT COUNT(*) FROM fact) AS got, (SELECT COUNT(*) FROM lineitem) AS want
  UNION ALL SELECT 'dim_postcodes', (SELECT COUNT(*) FROM dim_postcode), (SELECT COUNT(*) FROM nation)
  UNION ALL SELECT 'dim_drivers', (SELECT COUNT(*) FROM dim_driver), (SELECT COUNT(*) FROM supplier)),
whole AS (SELECT CAST(SUM(got) AS BIGINT) AS n, bool_and(got = want) AS fine FROM pair)
SELECT t AS table_name, got AS row_count, want AS expected_count,
       CASE WHEN got = want THEN 'OK' ELSE 'MISMATCH' END AS status, whole.n AS total_rows, whole.fine AS all_ok
FROM pair, whole""")

# fixed values: the reference warehouses and categories a load seeds
SQL["seed_warehouses"] = with_ctes(CTES, ["dim_warehouse"], """
, seed(warehouse_id, city, latitude, longitude, max_capacity_units) AS (VALUES
    ('WH-AMS-01', 'Amsterdam', 52.3123, 4.9432, 15000), ('WH-RTD-01', 'Rotterdam', 51.8872, 4.5292, 12000),
    ('WH-UTR-01', 'Utrecht', 52.0642, 5.0847, 8000), ('WH-DHG-01', 'Den Haag', 52.0417, 4.3614, 9000),
    ('WH-EHV-01', 'Eindhoven', 51.4091, 5.5019, 5000))
SELECT warehouse_id, city, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude,
       CAST(max_capacity_units AS BIGINT) AS max_capacity_units FROM dim_warehouse
UNION ALL
SELECT warehouse_id, city, CAST(latitude AS DOUBLE), CAST(longitude AS DOUBLE), CAST(max_capacity_units AS BIGINT)
FROM seed WHERE warehouse_id NOT IN (SELECT warehouse_id FROM dim_warehouse)""")

SQL["seed_categories"] = """
WITH cats AS (SELECT DISTINCT p_type AS category_name FROM part),
seed(category_name, avg_order_value_eur, avg_weight_kg, base_fail_rate_pct, cbs_commodity_group) AS (VALUES
    ('Electronics', 285.00, 1.20, 10.0, 'Machinery and transport equipment'),
    ('Fashion', 65.00, 0.40, 14.0, 'Miscellaneous manufactured articles'),
    ('Home & Garden', 95.00, 3.10, 16.0, 'Manufactured goods'),
    ('Books & Media', 22.00, 0.60, 8.0, 'Miscellaneous manufactured articles'),
    ('Sports', 78.00, 1.80, 12.0, 'Miscellaneous manufactured articles'),
    ('Health & Beauty', 45.00, 0.50, 9.0, 'Chemicals and related products'),
    ('Food & Grocery', 38.00, 2.40, 7.0, 'Food and live animals'),
    ('Toys & Games', 55.00, 0.90, 11.0, 'Miscellaneous manufactured articles'))
SELECT category_name, CAST(NULL AS DOUBLE) AS avg_order_value_eur, CAST(NULL AS DOUBLE) AS avg_weight_kg,
       CAST(NULL AS DOUBLE) AS base_fail_rate_pct, CAST(NULL AS VARCHAR) AS cbs_commodity_group FROM cats
UNION ALL
SELECT category_name, CAST(avg_order_value_eur AS DOUBLE), CAST(avg_weight_kg AS DOUBLE),
       CAST(base_fail_rate_pct AS DOUBLE), cbs_commodity_group
FROM seed WHERE category_name NOT IN (SELECT category_name FROM cats)"""


def _report(table: str, source: str, rules) -> str:
    parts = []
    for check, col, bad in rules:
        parts.append(f"SELECT '{table}' AS table_name, '{check}' AS check_name, '{col}' AS column_name, "
                     f"CAST(SUM(CASE WHEN {bad} THEN 1 ELSE 0 END) AS BIGINT) AS failed_rows FROM {source}")
    return "\nUNION ALL\n".join(parts)


def _nn(*cols):
    return [("not_null", c, f"{c} IS NULL") for c in cols]


FACT_RULES = [
    *_nn("shipment_id", "date_key", "postcode_pc4", "warehouse_id", "category_id", "dispatch_datetime",
         "carrier", "vehicle_type", "order_value_eur", "weight_kg", "attempt_1_status", "final_status",
         "delivery_cost_eur"),
    ("domain", "vehicle_type", f"NOT (vehicle_type IN {VEHICLES})"),
    ("domain", "attempt_1_status", "NOT (attempt_1_status IN ('Success', 'Failed'))"),
    ("domain", "attempt_2_status", "NOT (attempt_2_status IN ('Success', 'Failed', 'N/A'))"),
    ("domain", "final_status", "NOT (final_status IN ('Delivered', 'Delivered (2nd attempt)', 'Returned'))"),
    ("range", "order_value_eur", "NOT (order_value_eur > 0)"),
    ("range", "weight_kg", "NOT (weight_kg > 0)"),
    ("range", "delivery_cost_eur", "NOT (delivery_cost_eur >= 0)"),
]
# the oracle fact keeps the category name as its category key
_FACT_SRC = "(SELECT *, category_name AS category_id FROM fact)"

SQL["fact_quality_report"] = with_ctes(CTES, FACT_DEPS, _report("fact_deliveries", _FACT_SRC, FACT_RULES))

SQL["dimension_quality_report"] = with_ctes(
    CTES, ["dim_driver", "dim_postcode", "inv_base", "inventory"], "\nUNION ALL\n".join([
        _report("dim_driver", "dim_driver", [
            *_nn("driver_id", "driver_name", "city", "years_experience", "vehicle_type", "contract_type",
                 "is_active"),
            ("domain", "vehicle_type", f"NOT (vehicle_type IN {VEHICLES})"),
            ("domain", "contract_type", "NOT (contract_type IN ('Fulltime', 'Parttime', 'Freelance'))"),
            ("range", "avg_rating", "NOT (rating_tenths >= 10 AND rating_tenths <= 50)"),
            ("range", "years_experience", "NOT (years_experience >= 0)")]),
        _report("dim_postcode", "dim_postcode", [
            *_nn("city", "latitude", "longitude"),
            ("domain", "housing_density", "NOT (housing_density IN ('Very High', 'High', 'Medium', 'Low'))"),
            ("domain", "zone_type", "NOT (zone_type IN ('Residential', 'Commercial', 'Mixed'))")]),
        _report("mart_inventory_snapshot", "inventory", [
            *_nn("snapshot_date", "warehouse_id", "product_category"),
            ("domain", "stock_status", "NOT (stock_status IN ('Critical', 'Low', 'Normal'))")]),
    ]))


def _unique(table, source, keys):
    k = ", ".join(keys)
    return (f"SELECT '{table}' AS table_name, '{','.join(keys)}' AS key_columns, COUNT(*) AS duplicate_keys, "
            f"CAST(COALESCE(SUM(n), 0) AS BIGINT) AS rows_with_duplicate_key "
            f"FROM (SELECT {k}, COUNT(*) AS n FROM {source} GROUP BY {k} HAVING COUNT(*) > 1)")


SQL["key_uniqueness"] = with_ctes(CTES, FACT_DEPS + ["inv_base", "inventory"], "\nUNION ALL\n".join([
    _unique("fact_deliveries", "fact", ["shipment_id"]),
    _unique("lineitem", "lineitem", ["l_orderkey", "l_linenumber"]),
    _unique("mart_inventory_snapshot", "inventory", ["snapshot_date", "sku_code"]),
]))


def _orphans(child_name, child, parent_name, parent, ckey, pkey, label):
    return (f"SELECT '{child_name}' AS child_table, '{parent_name}' AS parent_table, '{label}' AS key_column, "
            f"COUNT(*) AS orphan_rows FROM {child} c WHERE c.{ckey} IS NOT NULL "
            f"AND c.{ckey} NOT IN (SELECT {pkey} FROM {parent})")


SQL["reference_integrity"] = with_ctes(
    CTES, STAR_DEPS + ["dim_warehouse", "inv_base", "inventory"], "\nUNION ALL\n".join([
        _orphans("fact_deliveries", "fact", "dim_date", "dim_date", "date_key", "date_key", "date_key"),
        _orphans("fact_deliveries", "fact", "dim_postcode", "dim_postcode", "postcode_pc4", "postcode_pc4",
                 "postcode_pc4"),
        _orphans("fact_deliveries", "fact", "dim_warehouse", "dim_warehouse", "warehouse_id", "warehouse_id",
                 "warehouse_id"),
        _orphans("fact_deliveries", "fact", "dim_product_category", "(SELECT DISTINCT p_type FROM part)",
                 "category_name", "p_type", "category_id"),
        _orphans("mart_inventory_snapshot", "inventory", "dim_warehouse", "dim_warehouse", "warehouse_id",
                 "warehouse_id", "warehouse_id"),
    ]))

SQL["lineitem_validation"] = """
WITH dup AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1),
t AS (
  SELECT list_filter([
      CASE WHEN l.l_orderkey IS NULL THEN 'not_null:l_orderkey' END,
      CASE WHEN l.l_linenumber IS NULL THEN 'not_null:l_linenumber' END,
      CASE WHEN l.l_shipdate IS NULL THEN 'not_null:l_shipdate' END,
      CASE WHEN NOT (l.l_returnflag IN ('A', 'N', 'R')) THEN 'domain:l_returnflag' END,
      CASE WHEN NOT (l.l_linestatus IN ('O', 'F')) THEN 'domain:l_linestatus' END,
      CASE WHEN NOT (l.l_quantity > 0) THEN 'range:l_quantity' END,
      CASE WHEN NOT (l.l_discount >= 0 AND l.l_discount <= 1) THEN 'range:l_discount' END,
      CASE WHEN d.l_orderkey IS NOT NULL THEN 'duplicate:l_orderkey,l_linenumber' END,
      CASE WHEN l.l_orderkey IS NOT NULL AND o.o_orderkey IS NULL THEN 'orphan:l_orderkey' END
    ], lambda x: x IS NOT NULL) AS r
  FROM lineitem l
  LEFT JOIN dup d ON l.l_orderkey = d.l_orderkey AND l.l_linenumber = d.l_linenumber
  LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders) o ON l.l_orderkey = o.o_orderkey)
SELECT reason, COUNT(*) AS rows
FROM (SELECT unnest(CASE WHEN len(r) = 0 THEN ['valid'] ELSE list_concat(['rejected'], r) END) AS reason FROM t)
GROUP BY reason"""

# repeated line keys are reported by key_uniqueness, not rejected
_FACT_BAD = " OR ".join(f"COALESCE({bad}, FALSE)" for _, _, bad in FACT_RULES)

# rows, rejected rows, partitions and newest value of each stored table
_STORED = with_ctes(
    CTES, STAR_DEPS + ["dim_driver", "dim_warehouse", "inv_base", "inventory", "forecast"], f"""
, mart AS (SELECT DISTINCT d.year_month, p.city, f.category_name FROM fact f JOIN dim_date d ON f.date_key = d.date_key
           JOIN dim_postcode p ON f.postcode_pc4 = p.postcode_pc4),
stored(table_name, good, bad, partitions, newest) AS (
  SELECT 'fact_deliveries', SUM(CASE WHEN bad THEN 0 ELSE 1 END), SUM(CASE WHEN bad THEN 1 ELSE 0 END),
         COUNT(DISTINCT CASE WHEN NOT bad THEN year_month END),
         {ymd('MAX(CASE WHEN NOT bad THEN CAST(dispatch_datetime AS DATE) END)')}
  FROM (SELECT ({_FACT_BAD}) AS bad, year_month, dispatch_datetime FROM {_FACT_SRC})
  UNION ALL SELECT 'dim_date', COUNT(*), 0, 1, NULL FROM dim_date
  UNION ALL SELECT 'dim_postcode', COUNT(*), 0, 1, NULL FROM dim_postcode
  UNION ALL SELECT 'dim_driver', COUNT(*), 0, 1, NULL FROM dim_driver
  UNION ALL SELECT 'dim_warehouse', COUNT(*), 0, 1, NULL FROM dim_warehouse
  UNION ALL SELECT 'dim_product_category', COUNT(DISTINCT p_type), 0, 1, NULL FROM part
  UNION ALL SELECT 'mart_inventory_snapshot', COUNT(*), 0, COUNT(DISTINCT snapshot_date), {ymd('MAX(snapshot_date)')}
  FROM inventory
  UNION ALL SELECT 'mart_daily_forecast', COUNT(*), 0, 1, {ymd('MAX(forecast_date)')} FROM forecast
  UNION ALL SELECT 'kpi_state', COUNT(*), 0, COUNT(DISTINCT year_month), NULL FROM mart
  UNION ALL SELECT 'mart_monthly_kpi', COUNT(DISTINCT (year_month, city)), 0, COUNT(DISTINCT year_month), NULL FROM mart)
""")

SQL["load_audit"] = _STORED + """
SELECT table_name, 'FULL' AS load_type, CAST(good AS BIGINT) AS rows_inserted, CAST(0 AS BIGINT) AS rows_updated,
       CAST(bad AS BIGINT) AS rows_rejected, 'SUCCESS' AS status, CAST(NULL AS VARCHAR) AS error_message,
       TRUE AS has_duration
FROM stored"""

SQL["load_manifest"] = _STORED + """
SELECT table_name, 'FULL' AS load_type, CAST(good AS BIGINT) AS row_count, CAST(partitions AS BIGINT) AS partitions,
       newest
FROM stored"""

SQL["daily_forecast"] = with_ctes(CTES, ["forecast", "forecast_full"], f"""
SELECT {ymd('forecast_date')} AS forecast_date, city, day_of_week, {big('week_number')} AS week_number,
       month_name, {big('year')} AS year, is_public_holiday, is_peak_period, peak_event_name,
       CAST(actual_volume AS DOUBLE) AS actual_volume, CAST(forecast_volume AS DOUBLE) AS forecast_volume,
       CAST(forecast_error AS DOUBLE) AS forecast_error, data_type
FROM forecast_full""")
