"""Oracle SQL (DuckDB) for the flat-model business questions and VF."""

from oracle.fixture_sql import CTES, FLAT_DEPS, FLAT_PC_DEPS
from oracle.sqlkit import big, cnt, dbl, rdiv, units, with_ctes

FAILED = "attempt_1_status = 'Failed'"
NOT_HOME = "attempt_1_status = 'Failed' AND fail_reason = 'Not home'"
ZERO = "vehicle_type IN ('Cargo Bike', 'Electric Van')"
FOSSIL = "vehicle_type IN ('Cargo Van', 'Diesel Van')"
COST_C = units("delivery_cost_eur", 2)   # cents
CO2_U = units("co2_emission_kg", 4)      # 0.1 g


def _flat(body, deps=FLAT_DEPS):
    return with_ctes(CTES, deps, body)


def _rate(pred, s):
    return rdiv(f"{cnt(pred)} * 100", "COUNT(*)", s)


def _wasted(count_expr, s=0, extra_num="1", extra_den="1"):
    """count × AVG(cost) (× extra_num / extra_den) rounded to s places."""
    return rdiv(f"({count_expr}) * SUM({COST_C}) * {extra_num}", f"COUNT(*) * 100 * {extra_den}", s)


SQL = {}

SQL["scan_deliveries"] = _flat(f"""
SELECT shipment_id, {big('date_key')} AS date_key, city, {big('postcode_pc4')} AS postcode_pc4,
       category_name AS product_category, strftime(dispatch_date, '%Y-%m-%d') AS dispatch_date,
       strftime(dispatch_datetime, '%Y-%m-%d %H:%M:%S') AS dispatch_datetime,
       strftime(delivery_datetime, '%Y-%m-%d %H:%M:%S') AS delivery_datetime,
       is_peak_period, is_first_attempt_fail, is_returned, is_zero_emission, is_multi_attempt,
       month_name, {big('year_num')} AS year_num, yr_month, warehouse_id, carrier, vehicle_type, {dbl('order_value_eur')} AS order_value_eur,
       {dbl('weight_kg')} AS weight_kg, attempt_1_status, attempt_2_status, fail_reason, final_status,
       {dbl('delivery_cost_eur')} AS delivery_cost_eur, {dbl('route_km')} AS route_km,
       {dbl('co2_emission_kg')} AS co2_emission_kg, {dbl('temp_celsius')} AS temp_celsius,
       {dbl('rain_mm')} AS rain_mm, {dbl('wind_speed_kmh')} AS wind_speed_kmh
FROM flat_fact""")

SQL["city_volume"] = _flat("""
SELECT city, COUNT(*) AS total_shipments FROM flat_fact GROUP BY city""")

SQL["city_fails"] = _flat(f"""
SELECT city, COUNT(*) AS total_shipments, {big(cnt(FAILED))} AS total_fails
FROM flat_fact GROUP BY city""")

SQL["city_fail_rate"] = _flat(f"""
SELECT city, COUNT(*) AS total_shipments, {big(cnt(FAILED))} AS total_fails,
       {_rate(FAILED, 1)} AS fail_rate_pct
FROM flat_fact GROUP BY city""")

SQL["city_fail_cost"] = _flat(f"""
SELECT city, COUNT(*) AS total_shipments, {big(cnt(FAILED))} AS total_fails,
       {_rate(FAILED, 1)} AS fail_rate_pct,
       {rdiv(f'SUM({COST_C})', 'COUNT(*) * 100', 2)} AS avg_cost_eur,
       {_wasted(cnt(FAILED))} AS wasted_cost_eur
FROM flat_fact GROUP BY city""")

SQL["city_scorecard"] = _flat(f"""
SELECT city, COUNT(*) AS total_shipments, {big(cnt(FAILED))} AS total_fails,
       {_rate(FAILED, 1)} AS fail_rate_pct,
       {_wasted(cnt(FAILED))} AS wasted_cost_eur,
       {dbl(f'ROUND(SUM(CASE WHEN {FAILED} THEN co2_emission_kg ELSE 0 END) * 1000, 1)')} AS wasted_co2_grams,
       {_rate(ZERO, 1)} AS zero_emission_pct
FROM flat_fact GROUP BY city""")

SQL["reason_counts"] = _flat(f"""
SELECT fail_reason, COUNT(*) AS total_fails FROM flat_fact WHERE {FAILED} GROUP BY fail_reason""")

SQL["reason_cost"] = _flat(f"""
SELECT fail_reason, total_fails,
       {rdiv('total_fails * 100', 'SUM(total_fails) OVER ()', 1)} AS pct_of_all_fails,
       wasted_cost_eur, wasted_co2_grams
FROM (SELECT fail_reason, COUNT(*) AS total_fails,
             {dbl('ROUND(SUM(delivery_cost_eur), 0)')} AS wasted_cost_eur,
             {dbl('ROUND(SUM(co2_emission_kg) * 1000, 1)')} AS wasted_co2_grams
      FROM flat_fact WHERE {FAILED} GROUP BY fail_reason)""")

SQL["reason_by_city"] = _flat(f"""
SELECT city, fail_reason, total_fails,
       {rdiv('total_fails * 100', 'SUM(total_fails) OVER (PARTITION BY city)', 1)} AS pct_within_city
FROM (SELECT city, fail_reason, COUNT(*) AS total_fails
      FROM flat_fact WHERE {FAILED} GROUP BY city, fail_reason)""")

SQL["co2_total"] = _flat(f"""
SELECT {dbl('ROUND(SUM(co2_emission_kg), 2)')} AS total_co2_kg,
       {rdiv(f'SUM({CO2_U})', 'COUNT(co2_emission_kg) * 10', 2)} AS avg_co2_grams_per_delivery,
       {dbl(f'ROUND(SUM(CASE WHEN {FAILED} THEN co2_emission_kg ELSE 0 END), 2)')} AS co2_from_failed_kg,
       {rdiv(f'SUM(CASE WHEN {FAILED} THEN {CO2_U} ELSE 0 END) * 100', f'SUM({CO2_U})', 1)} AS wasted_co2_pct
FROM flat_fact""")

SQL["co2_by_vehicle"] = _flat(f"""
SELECT vehicle_type, total_shipments,
       {rdiv('total_shipments * 100', 'SUM(total_shipments) OVER ()', 1)} AS fleet_share_pct,
       total_co2_kg, avg_co2_grams, fail_rate_pct,
       {rdiv('co2_u * 100', 'SUM(total_shipments) OVER () * 10000', 1)} AS share_of_total_co2_pct
FROM (SELECT vehicle_type, COUNT(*) AS total_shipments, SUM({CO2_U}) AS co2_u,
             {dbl('ROUND(SUM(co2_emission_kg), 3)')} AS total_co2_kg,
             {rdiv(f'SUM({CO2_U})', 'COUNT(*) * 10', 2)} AS avg_co2_grams,
             {_rate(FAILED, 1)} AS fail_rate_pct
      FROM flat_fact GROUP BY vehicle_type)""")

SQL["electrification_potential"] = _flat(f"""
SELECT vehicle_type, COUNT(*) AS shipments,
       {dbl('ROUND(SUM(co2_emission_kg), 3)')} AS actual_co2_kg,
       {rdiv(f'SUM({CO2_U})', 'COUNT(*) * 10', 2)} AS avg_co2_grams,
       {_rate(ZERO, 1)} AS zero_em_pct,
       {dbl('ROUND(COUNT(*) * 0.0006, 3)')} AS co2_if_all_electric_kg,
       {dbl('ROUND(SUM(co2_emission_kg) - COUNT(*) * 0.0006, 3)')} AS co2_saving_potential_kg
FROM flat_fact GROUP BY vehicle_type""")

SQL["postcode_fail_top"] = _flat(f"""
SELECT {big('postcode_pc4')} AS postcode_pc4, city, COUNT(*) AS total_shipments,
       {big(cnt(FAILED))} AS total_fails, {_rate(FAILED, 1)} AS fail_rate_pct
FROM flat_fact GROUP BY postcode_pc4, city
ORDER BY fail_rate_pct DESC, postcode_pc4 LIMIT 10""")

_JOIN_PC = "flat_fact f JOIN flat_postcodes p ON f.postcode_pc4 = p.postcode_pc4"

SQL["postcode_vs_history"] = _flat(f"""
SELECT {big('f.postcode_pc4')} AS postcode_pc4, f.city, p.district, p.zone_type, p.parcel_locker_nearby,
       {dbl('p.historical_fail_rate_pct')} AS historical_fail_rate_pct,
       COUNT(*) AS total_shipments, {big(cnt(FAILED))} AS total_fails,
       {_rate(FAILED, 1)} AS actual_fail_rate_pct,
       {rdiv(f"{cnt(FAILED)} * 10000 - COUNT(*) * {units('p.historical_fail_rate_pct', 2)}", 'COUNT(*) * 100', 1)} AS vs_historical_pp,
       {_wasted(cnt(FAILED))} AS wasted_cost_eur
FROM {_JOIN_PC}
GROUP BY f.postcode_pc4, f.city, p.district, p.zone_type, p.parcel_locker_nearby, p.historical_fail_rate_pct
ORDER BY actual_fail_rate_pct DESC, f.postcode_pc4 LIMIT 10""", FLAT_PC_DEPS)

SQL["locker_roi"] = _flat(f"""
SELECT *, CASE WHEN parcel_locker_nearby = 'No' AND fail_rate_pct > 11 THEN 'Install locker - High Priority'
               WHEN parcel_locker_nearby = 'No' THEN 'Review coverage' ELSE 'Monitor' END AS recommendation
FROM (SELECT {big('f.postcode_pc4')} AS postcode_pc4, f.city, p.district, p.parcel_locker_nearby, p.zone_type,
             COUNT(*) AS total_shipments, {big(cnt(FAILED))} AS total_fails,
             {_rate(FAILED, 1)} AS fail_rate_pct,
             {_wasted(cnt(FAILED))} AS wasted_cost_eur,
             {_wasted(cnt(FAILED), 0, '4')} AS est_annual_waste_eur
      FROM {_JOIN_PC}
      GROUP BY f.postcode_pc4, f.city, p.district, p.parcel_locker_nearby, p.zone_type)
ORDER BY wasted_cost_eur DESC, postcode_pc4 LIMIT 15""", FLAT_PC_DEPS)

SQL["locker_impact"] = _flat(f"""
SELECT {big('f.postcode_pc4')} AS postcode_pc4, f.city, p.district,
       COUNT(*) AS total_shipments, {big(cnt(FAILED))} AS total_fails,
       {_rate(FAILED, 1)} AS fail_rate_pct,
       {_wasted(cnt(FAILED))} AS wasted_cost_3yr_eur,
       {_wasted(cnt(FAILED), 0, '1', '3')} AS wasted_cost_annual_eur,
       {rdiv(f'SUM(CASE WHEN {FAILED} THEN {CO2_U} ELSE 0 END)', '30', 1)} AS wasted_co2_annual_grams,
       {_wasted(cnt(NOT_HOME), 0, '60', '300')} AS annual_saving_eur
FROM {_JOIN_PC}
WHERE f.postcode_pc4 IN (1004, 1009, 1014)
GROUP BY f.postcode_pc4, f.city, p.district""", FLAT_PC_DEPS)

SQL["dispatch_impact"] = _flat(f"""
SELECT city, total_shipments, not_home_fails, not_home_rate_pct,
       {dbl('nh_cost')} AS wasted_cost_3yr_eur,
       {rdiv('nh_cost', '3', 0)} AS wasted_cost_annual_eur,
       {dbl('nh_co2_g')} AS wasted_co2_3yr_grams,
       {rdiv('nh_cost * 70', '300', 0)} AS annual_saving_eur,
       {rdiv(f"{units('nh_co2_g', 1)} * 70", '3000', 1)} AS annual_co2_saving_grams
FROM (SELECT city, COUNT(*) AS total_shipments, {big(cnt(NOT_HOME))} AS not_home_fails,
             {_rate(NOT_HOME, 2)} AS not_home_rate_pct,
             ROUND(SUM(CASE WHEN {NOT_HOME} THEN delivery_cost_eur ELSE 0 END), 0) AS nh_cost,
             ROUND(SUM(CASE WHEN {NOT_HOME} THEN co2_emission_kg ELSE 0 END) * 1000, 1) AS nh_co2_g
      FROM flat_fact GROUP BY city)""")

_SCEN = """
SELECT '{name}' AS recommendation, {n} AS impacted_deliveries,
       {cost} AS annual_cost_saving_eur, {co2} AS annual_co2_saving_grams
FROM flat_fact {where}"""


def _scenario(name, pred, cost_pct, co2_pct, where=""):
    return _SCEN.format(
        name=name, n=big(cnt(pred)), where=where,
        cost=rdiv(f"SUM(CASE WHEN {pred} THEN {COST_C} ELSE 0 END) * {cost_pct}", "100 * 100 * 3", 0),
        co2=rdiv(f"SUM(CASE WHEN {pred} THEN {CO2_U} ELSE 0 END) * {co2_pct}", "10 * 100 * 3", 1))


SQL["combined_impact"] = _flat(
    "SELECT *, " + rdiv("CAST(annual_cost_saving_eur AS BIGINT) * 45000", "1", 0)
    + " AS postnl_scale_saving_eur FROM (\n"
    + _scenario("Parcel lockers — Zones 1004, 1009, 1014", NOT_HOME, 60, 60,
                "WHERE postcode_pc4 IN (1004, 1009, 1014)")
    + "\nUNION ALL" + _scenario("Predictive dispatch — all cities", NOT_HOME, 70, 70)
    + "\nUNION ALL" + _scenario("Fleet electrification — 50% to 80%", FOSSIL, 2, 30)
    + ")")
