"""The delivery model rebuilt from the given tables in DuckDB SQL.

Written independently of the Spark code from the rules in FIXTURES.md,
part B.  Dialect notes: delivery time uses ``to_hours``; ISO weekday is
``isodow``; month and day names are ``monthname`` / ``dayname``.
"""

CTES = {
    "f_base": """
    SELECT l.*, o.o_orderpriority, c.c_nationkey, c.c_mktsegment, p.p_type,
           CAST(l.l_shipdate AS DATE) AS d,
           (l.l_returnflag = 'R' AND l.l_quantity <= 8 + (c.c_nationkey % 5) * 4) AS failed,
           CAST(1 + CAST(l.l_discount AS DECIMAL(4,2)) * 100 AS DECIMAL(7,2)) AS route
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN part p ON l.l_partkey = p.p_partkey""",
    "fact": """
    SELECT
      concat_ws('-', 'SHP', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS shipment_id,
      CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS date_key,
      CAST(c_nationkey + 1000 AS INTEGER) AS postcode_pc4,
      'WH-' || CAST(l_suppkey % 5 AS VARCHAR) AS warehouse_id,
      p_type AS category_name,
      l_shipdate AS dispatch_datetime,
      CASE WHEN NOT failed OR l_linestatus = 'F'
           THEN l_shipdate + to_hours(l_linenumber * 7) END AS delivery_datetime,
      c_mktsegment AS carrier,
      (['Cargo Bike', 'Electric Van', 'Diesel Van', 'Cargo Van'])[CAST(l_suppkey % 4 AS INTEGER) + 1] AS vehicle_type,
      CAST(l_extendedprice AS DECIMAL(10,2)) AS order_value_eur,
      CAST(l_quantity AS DECIMAL(7,2)) AS weight_kg,
      CASE WHEN failed THEN 'Failed' ELSE 'Success' END AS attempt_1_status,
      CASE WHEN NOT failed THEN 'N/A' WHEN l_linestatus = 'F' THEN 'Success' ELSE 'Failed' END AS attempt_2_status,
      CASE WHEN failed THEN CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Not home'
                                 ELSE o_orderpriority END END AS fail_reason,
      CASE WHEN NOT failed THEN 'Delivered' WHEN l_linestatus = 'F' THEN 'Delivered (2nd attempt)'
           ELSE 'Returned' END AS final_status,
      CAST(2 + CAST(l_quantity AS DECIMAL(4,0)) * 0.10 AS DECIMAL(8,2)) AS delivery_cost_eur,
      route AS route_km,
      CAST(route * CASE WHEN l_suppkey % 4 < 2 THEN 0.0200 ELSE 0.2100 END AS DECIMAL(8,4)) AS co2_emission_kg,
      CAST(l_linenumber * 3 AS DECIMAL(5,1)) AS temp_celsius,
      CASE WHEN NOT (l_linenumber = 7 AND l_suppkey % 10 = 0)
           THEN CAST(CAST(l_tax AS DECIMAL(4,2)) * 120 AS DECIMAL(6,1)) END AS rain_mm,
      CAST(l_linenumber * 5 AS DECIMAL(5,1)) AS wind_speed_kmh,
      month(d) IN (11, 12) AS is_peak_period,
      strftime(d, '%Y-%m') AS year_month,
      failed AS is_first_attempt_fail,
      (failed AND l_linestatus <> 'F') AS is_returned,
      (l_suppkey % 4 < 2) AS is_zero_emission,
      failed AS is_multi_attempt
    FROM f_base""",
    "dim_postcode": """
    SELECT CAST(n_nationkey + 1000 AS INTEGER) AS postcode_pc4, r_name AS city, n_name AS district,
           CAST(52 + n_nationkey * 0.01 AS DECIMAL(7,4)) AS latitude,
           CAST(4 + n_nationkey * 0.01 AS DECIMAL(7,4)) AS longitude,
           (['Very High', 'High', 'Medium', 'Low'])[n_nationkey % 4 + 1] AS housing_density,
           CAST(6 + n_nationkey * 0.75 AS DECIMAL(5,2)) AS historical_fail_rate_pct,
           (n_nationkey % 2 = 0) AS parcel_locker_nearby,
           (['Residential', 'Commercial', 'Mixed'])[n_nationkey % 3 + 1] AS zone_type,
           CASE WHEN 6 + n_nationkey * 0.75 >= 20 THEN 'High'
                WHEN 6 + n_nationkey * 0.75 >= 12 THEN 'Medium' ELSE 'Low' END AS fail_risk_tier
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "flat_fact": """
    SELECT f.*, p.city, CAST(f.dispatch_datetime AS DATE) AS dispatch_date,
           monthname(CAST(f.dispatch_datetime AS DATE)) AS month_name,
           year(CAST(f.dispatch_datetime AS DATE)) AS year_num, f.year_month AS yr_month
    FROM fact f LEFT JOIN dim_postcode p ON f.postcode_pc4 = p.postcode_pc4""",
    "flat_postcodes": """
    SELECT postcode_pc4, city, district, zone_type,
           CASE WHEN parcel_locker_nearby THEN 'Yes' ELSE 'No' END AS parcel_locker_nearby,
           historical_fail_rate_pct
    FROM dim_postcode""",
    "dim_date": """
    SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS date_key, d AS full_date,
           year(d) AS year, quarter(d) AS quarter, month(d) AS month_number, monthname(d) AS month_name,
           weekofyear(d) AS week_number, isodow(d) AS day_of_week_number, dayname(d) AS day_of_week_name,
           day(d) AS day_of_month, isodow(d) >= 6 AS is_weekend,
           hol IS NOT NULL AS is_public_holiday, hol AS holiday_name,
           month(d) IN (11, 12) AS is_peak_period,
           CASE WHEN month(d) IN (11, 12) THEN 'Q4 peak' END AS peak_event_name,
           strftime(d, '%Y-%m') AS year_month,
           CAST(year(d) AS VARCHAR) || '-Q' || CAST(quarter(d) AS VARCHAR) AS year_quarter
    FROM (SELECT d,
                 CASE month(d) * 100 + day(d) WHEN 101 THEN 'New Year''s Day' WHEN 427 THEN 'King''s Day'
                      WHEN 1225 THEN 'Christmas Day' WHEN 1226 THEN 'Second Christmas Day' END AS hol
          FROM (SELECT CAST(unnest(generate_series(lo, hi - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d
                FROM (SELECT date_trunc('year', MIN(l_shipdate)) AS lo,
                             date_trunc('year', MAX(l_shipdate)) + INTERVAL 1 YEAR AS hi FROM lineitem)))""",
    "forecast_full": """
    SELECT forecast_date, city, dayname(forecast_date) AS day_of_week, weekofyear(forecast_date) AS week_number,
           monthname(forecast_date) AS month_name, year(forecast_date) AS year,
           CASE month(forecast_date) * 100 + day(forecast_date) WHEN 101 THEN TRUE WHEN 427 THEN TRUE
                WHEN 1225 THEN TRUE WHEN 1226 THEN TRUE ELSE FALSE END AS is_public_holiday,
           month(forecast_date) IN (11, 12) AS is_peak_period,
           CASE WHEN month(forecast_date) IN (11, 12) THEN 'Q4 peak' END AS peak_event_name,
           actual_volume, forecast_volume, actual_volume - forecast_volume AS forecast_error,
           'Actual' AS data_type
    FROM forecast""",
    "dim_warehouse": """
    SELECT 'WH-' || CAST(r_regionkey AS VARCHAR) AS warehouse_id, r_name AS city,
           CAST(52 + r_regionkey * 0.1 AS DECIMAL(7,4)) AS latitude,
           CAST(4 + r_regionkey * 0.1 AS DECIMAL(7,4)) AS longitude,
           CAST(5000 + r_regionkey * 2000 AS INTEGER) AS max_capacity_units
    FROM region WHERE r_regionkey IN (SELECT s_suppkey % 5 FROM supplier)""",
    "dim_driver": """
    SELECT 'DRV-' || CAST(s_suppkey AS VARCHAR) AS driver_id, s_name AS driver_name, r_name AS city,
           CAST(s_suppkey % 20 AS INTEGER) AS years_experience,
           (['Cargo Bike', 'Electric Van', 'Diesel Van', 'Cargo Van'])[CAST(s_suppkey % 4 AS INTEGER) + 1] AS vehicle_type,
           (['Fulltime', 'Parttime', 'Freelance'])[CAST(s_suppkey % 3 AS INTEGER) + 1] AS contract_type,
           CAST(30 + s_suppkey % 25 AS INTEGER) AS avg_deliveries_day,
           CAST((30 + s_suppkey % 21) AS DECIMAL(4,0)) / 10 AS rating_dbl,
           CAST(30 + s_suppkey % 21 AS INTEGER) AS rating_tenths,
           CAST(65 + (s_suppkey * 17) % 35 AS INTEGER) AS otd,
           CAST(CASE WHEN s_suppkey % 23 = 7 THEN 30 ELSE 2 + (s_suppkey * 3) % 17 END AS INTEGER) AS fail,
           s_suppkey % 10 <> 4 AS is_active,
           s_suppkey % 4 < 2 AS is_zero_emission
    FROM supplier JOIN region ON s_suppkey % 5 = r_regionkey""",
    "driver": """
    SELECT *, CASE WHEN otd >= 95 AND fail <= 8 THEN 'Elite'
                   WHEN otd >= 85 AND fail <= 15 THEN 'Standard'
                   WHEN otd >= 70 THEN 'Developing' ELSE 'Under Review' END AS performance_band
    FROM dim_driver""",
    "inv_base": """
    SELECT last_day(CAST(l_shipdate AS DATE)) AS snapshot_date, l_suppkey % 5 AS wh,
           p_type AS product_category,
           CAST(SUM(l_quantity) AS BIGINT) AS outbound,
           CAST(SUM(l_quantity * l_linenumber) AS BIGINT) AS stock,
           COUNT(*) AS n,
           MIN(CAST(l_shipdate AS DATE)) AS last_replenish_date,
           SUM(CAST(l_extendedprice AS DECIMAL(10,2))) AS value
    FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY 1, 2, 3""",
    "inventory": """
    SELECT snapshot_date, 'WH-' || CAST(wh AS VARCHAR) AS warehouse_id, product_category,
           'WH-' || CAST(wh AS VARCHAR) || '-' || product_category AS sku_code,
           stock AS current_stock_units, 5000 + wh * 2000 AS max_capacity_units,
           500 AS reorder_point, 1000 AS reorder_qty, outbound AS avg_daily_outbound,
           ((20 * stock + outbound) // (2 * outbound)) AS supply_tenths,
           n % 5 AS stockout_days_ytd, last_replenish_date,
           2 + length(product_category) % 3 AS supplier_lead_days,
           value AS inventory_value_eur,
           CASE WHEN ((20 * stock + outbound) // (2 * outbound)) < 30 THEN 'Critical'
                WHEN ((20 * stock + outbound) // (2 * outbound)) < 40 THEN 'Low' ELSE 'Normal' END AS stock_status,
           ((2 * stock * 10000 + (5000 + wh * 2000)) // (2 * (5000 + wh * 2000))) AS util_hundredths
    FROM inv_base""",
    "forecast": """
    SELECT CAST(ts AS DATE) AS forecast_date, r_name AS city, COUNT(*) AS actual_volume,
           60 + isodow(CAST(ts AS DATE)) - 1 AS forecast_volume
    FROM events JOIN region ON user_id % 5 = r_regionkey
    GROUP BY 1, 2, 4""",
}

FACT_DEPS = ["f_base", "fact"]
FLAT_DEPS = ["f_base", "fact", "dim_postcode", "flat_fact"]
FLAT_PC_DEPS = FLAT_DEPS + ["flat_postcodes"]
STAR_DEPS = ["f_base", "fact", "dim_postcode", "dim_date"]
