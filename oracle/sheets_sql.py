"""Oracle SQL (DuckDB) for the loaded raw sheets: the model's own values, less
the rows whose raw text no contract can read (FIXTURES.md, part D)."""

from oracle.fixture_sql import CTES, FLAT_DEPS
from oracle.sqlkit import big, dbl, ts, with_ctes, ymd

DRV = ["dim_driver", "driver"]
INV = ["inv_base", "inventory"]
FORE = ["forecast", "forecast_full"]
K = "CAST(substr(driver_id, 5) AS BIGINT)"
LAST = "temp_celsius = 21"
NO_VAN, NO_RATING = f"{K} % 50 = 49", f"{K} % 40 = 39"
NO_STATUS, NO_WEIGHT = f"({LAST} AND postcode_pc4 % 10 = 3)", f"({LAST} AND postcode_pc4 % 10 = 7)"
NO_STOCK = "(stockout_days_ytd = 3 AND month(snapshot_date) = 2)"
NO_VOLUME = "day(forecast_date) = 31"

SQL = {}

SQL["sheet_drivers"] = with_ctes(CTES, DRV, f"""
SELECT driver_id, driver_name, city, {big('years_experience')} AS years_experience, vehicle_type, contract_type,
       rating_tenths / 10.0 AS avg_rating, {dbl('otd')} AS on_time_rate_pct,
       CASE WHEN {K} % 7 = 0 THEN TRUE ELSE is_active END AS is_active,
       {ymd(f"DATE '2018-01-01' + CAST({K} % 1000 AS INTEGER)")} AS join_date
FROM driver WHERE NOT ({NO_VAN}) AND NOT ({NO_RATING})""")

SQL["sheet_deliveries"] = with_ctes(CTES, FLAT_DEPS, f"""
SELECT shipment_id, {ts('dispatch_datetime')} AS dispatch_datetime, month_name, {big('year_num')} AS year_num, yr_month,
       {big('postcode_pc4')} AS postcode_pc4, vehicle_type, {dbl('weight_kg')} AS weight_kg, attempt_1_status,
       attempt_2_status, fail_reason, final_status, {dbl('delivery_cost_eur')} AS delivery_cost_eur, is_peak_period
FROM flat_fact WHERE NOT {NO_STATUS} AND NOT {NO_WEIGHT}""")

SQL["sheet_inventory"] = with_ctes(CTES, INV, f"""
SELECT {ymd('snapshot_date')} AS snapshot_date, warehouse_id, sku_code, product_category,
       {big('current_stock_units')} AS current_stock_units, supply_tenths / 10.0 AS days_of_supply,
       {big('stockout_days_ytd')} AS stockout_days_ytd, stock_status
FROM inventory WHERE NOT {NO_STOCK}""")

SQL["sheet_forecast"] = with_ctes(CTES, FORE, f"""
SELECT {ymd('forecast_date')} AS forecast_date, city, month_name, {big('year')} AS year_num, is_public_holiday,
       is_peak_period, peak_event_name AS peak_event, {dbl('actual_volume')} AS actual_volume,
       {dbl('forecast_volume')} AS forecast_volume, data_type
FROM forecast_full WHERE NOT {NO_VOLUME}""")

SQL["sheet_rejects"] = with_ctes(CTES, FLAT_DEPS + DRV + INV + FORE, f"""
SELECT * FROM (
  SELECT 'dim_drivers' AS sheet, 'domain:vehicle_type' AS reason, COUNT(*) AS rejected_rows FROM driver WHERE {NO_VAN}
  UNION ALL SELECT 'dim_drivers', 'type:avg_rating', COUNT(*) FROM driver WHERE {NO_RATING}
  UNION ALL SELECT 'fact_deliveries', 'domain:attempt_1_status', COUNT(*) FROM flat_fact WHERE {NO_STATUS}
  UNION ALL SELECT 'fact_deliveries', 'not_null:weight_kg', COUNT(*) FROM flat_fact WHERE {NO_WEIGHT}
  UNION ALL SELECT 'warehouse_inventory', 'type:current_stock_units', COUNT(*) FROM inventory WHERE {NO_STOCK}
  UNION ALL SELECT 'daily_volume_forecast', 'not_null:forecast_volume', COUNT(*) FROM forecast_full WHERE {NO_VOLUME})
WHERE rejected_rows > 0""")
