"""Oracle SQL (DuckDB) for the driver and inventory queries and view V2."""

from oracle.fixture_sql import CTES
from oracle.sqlkit import big, cnt, rdiv, rint, with_ctes, ymd

DRV = ["dim_driver", "driver"]
INV = ["inv_base", "inventory", "dim_warehouse"]
STD_H = "CAST(ROUND(CAST(stddev_samp(fail) AS DECIMAL(38,12)), 2) * 100 AS BIGINT)"

SQL = {}

SQL["driver_scorecard"] = with_ctes(CTES, DRV, """
SELECT driver_id, driver_name, city, vehicle_type, contract_type, CAST(years_experience AS BIGINT) AS years_experience,
       performance_band, is_zero_emission, CAST(otd AS DOUBLE) AS benchmark_otd_pct,
       CAST(fail AS DOUBLE) AS benchmark_fail_pct, CAST(avg_deliveries_day AS BIGINT) AS benchmark_daily_vol,
       rating_tenths / 10.0 AS avg_rating,
       """ + rdiv("avg_deliveries_day * 100", "40", 1) + """ AS efficiency_index,
       (5 * otd + 3 * (100 - fail) + 4 * rating_tenths) / 10.0 AS composite_score
FROM driver WHERE is_active""")

SQL["band_distribution"] = with_ctes(CTES, DRV, f"""
SELECT city, performance_band, COUNT(*) AS driver_count,
       {rdiv('SUM(otd)', 'COUNT(*)', 1)} AS avg_otd_pct,
       {rdiv('SUM(fail)', 'COUNT(*)', 1)} AS avg_fail_pct,
       {rdiv('SUM(rating_tenths)', 'COUNT(*) * 10', 2)} AS avg_rating,
       {rdiv('SUM(years_experience)', 'COUNT(*)', 1)} AS avg_experience_yrs
FROM driver WHERE is_active GROUP BY city, performance_band""")

SQL["driver_outliers"] = with_ctes(CTES, DRV, f"""
, c AS (SELECT city, {rint('SUM(fail)', 'COUNT(*)', 2)} AS avg_h, {STD_H} AS sd_h
        FROM driver WHERE is_active GROUP BY city)
SELECT d.driver_id, d.driver_name, d.city, d.vehicle_type, CAST(d.fail AS DOUBLE) AS fail_rate_pct,
       c.avg_h / 100.0 AS city_avg_fail, (d.fail * 100 - c.avg_h) / 100.0 AS above_avg_pp,
       {rdiv('d.fail * 100 - c.avg_h', 'c.sd_h', 2)} AS z_score,
       CASE WHEN d.fail * 100 > c.avg_h + 2 * c.sd_h THEN '🔴 Flag'
            WHEN d.fail * 100 > c.avg_h + c.sd_h THEN '🟡 Watch' ELSE '🟢 Normal' END AS alert_status
FROM driver d JOIN c ON d.city = c.city WHERE d.is_active""")

SQL["vehicle_fail_stats"] = with_ctes(CTES, DRV, f"""
SELECT vehicle_type, COUNT(*) AS drivers, {rdiv('SUM(fail)', 'COUNT(*)', 2)} AS avg_fail_rate,
       CAST(MIN(fail) AS DOUBLE) AS min_fail_rate, CAST(MAX(fail) AS DOUBLE) AS max_fail_rate,
       {STD_H} / 100.0 AS stddev_fail_rate, {rdiv('SUM(otd)', 'COUNT(*)', 2)} AS avg_otd_rate
FROM driver WHERE is_active GROUP BY vehicle_type""")

_LATEST = """
FROM inventory i JOIN dim_warehouse w ON i.warehouse_id = w.warehouse_id
WHERE i.snapshot_date = (SELECT MAX(snapshot_date) FROM inventory)"""

SQL["inventory_status"] = with_ctes(CTES, INV, f"""
SELECT w.city, i.warehouse_id, i.product_category, i.sku_code, {big('i.current_stock_units')} AS current_stock_units,
       {big('i.max_capacity_units')} AS max_capacity_units, i.util_hundredths / 100.0 AS utilisation_pct,
       i.supply_tenths / 10.0 AS days_of_supply, {big('i.reorder_point')} AS reorder_point,
       {big('i.reorder_qty')} AS reorder_qty, {big('i.avg_daily_outbound')} AS avg_daily_outbound, i.stock_status,
       CASE WHEN i.supply_tenths <= i.supplier_lead_days * 10 THEN '🔴 Order Now'
            WHEN i.supply_tenths <= i.supplier_lead_days * 20 THEN '🟡 Order Soon' ELSE '🟢 OK' END AS procurement_flag,
       {big('i.stockout_days_ytd')} AS stockout_days_ytd, CAST(i.inventory_value_eur AS DOUBLE) AS inventory_value_eur,
       {ymd('i.last_replenish_date')} AS last_replenish_date, {big('i.supplier_lead_days')} AS supplier_lead_days
{_LATEST}""")

SQL["inventory_value"] = with_ctes(CTES, INV, f"""
SELECT w.city, i.warehouse_id, CAST(SUM(i.inventory_value_eur) AS DOUBLE) AS total_inventory_value_eur,
       {rdiv('SUM(i.util_hundredths)', 'COUNT(i.util_hundredths) * 100', 1)} AS avg_utilisation_pct,
       {big(cnt("i.stock_status = 'Critical'"))} AS critical_sku_count,
       {big(cnt("i.stock_status = 'Low'"))} AS low_sku_count,
       {big('SUM(i.stockout_days_ytd)')} AS total_stockout_days
{_LATEST}
GROUP BY w.city, i.warehouse_id""")

SQL["supply_trend"] = with_ctes(CTES, INV, f"""
, daily AS (SELECT snapshot_date, warehouse_id, {rint('SUM(supply_tenths)', 'COUNT(supply_tenths)', 0)} AS a_t,
                   {big(cnt("stock_status = 'Critical'"))} AS critical_skus
            FROM inventory GROUP BY snapshot_date, warehouse_id)
SELECT {ymd('snapshot_date')} AS snapshot_date, warehouse_id, a_t / 10.0 AS avg_days_of_supply, critical_skus,
       {rdiv('SUM(a_t) OVER w', 'COUNT(a_t) OVER w * 10', 1)} AS rolling_7d_avg_supply
FROM daily
WINDOW w AS (PARTITION BY warehouse_id ORDER BY snapshot_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")

SQL["inventory_health"] = with_ctes(CTES, INV, f"""
SELECT i.warehouse_id, w.city, i.product_category, i.sku_code, {big('i.current_stock_units')} AS current_stock_units,
       {big('i.max_capacity_units')} AS max_capacity_units, i.util_hundredths / 100.0 AS utilisation_pct,
       i.supply_tenths / 10.0 AS days_of_supply, {big('i.reorder_point')} AS reorder_point, i.stock_status,
       {big('i.stockout_days_ytd')} AS stockout_days_ytd,
       CASE WHEN i.supply_tenths <= i.supplier_lead_days * 10 THEN 'ORDER NOW'
            WHEN i.supply_tenths <= i.supplier_lead_days * 20 THEN 'ORDER SOON' ELSE 'OK' END AS procurement_action,
       CAST(i.inventory_value_eur AS DOUBLE) AS inventory_value_eur, {ymd('i.snapshot_date')} AS snapshot_date
{_LATEST}""")
