"""The two published views: enriched deliveries (V1), inventory health (V2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.functions import derive
from parcelscope.operators.joins import latest_only, star


# V1 [J3 P10 F7] — four star joins; small dimensions are broadcast by their size
def deliveries_enriched(m) -> DataFrame:
    f = star(m, None,
             dim_date=["full_date", "year", "month_name", "quarter", "week_number",
                       "day_of_week_name", "is_weekend", "is_public_holiday",
                       "peak_event_name", ("is_peak_period", "_cal_peak")],
             dim_postcode=["city", "district", "housing_density", "zone_type", "fail_risk_tier",
                           "parcel_locker_nearby"],
             dim_warehouse=[],
             dim_product_category=["category_name"])
    return f.select(
        "shipment_id", "dispatch_datetime", "delivery_datetime",
        derive.transit_hours().alias("transit_hours"),
        F.col("full_date").alias("dispatch_date"),
        "year", "month_name", "quarter", "week_number", "day_of_week_name", "is_weekend",
        "is_public_holiday", F.col("_cal_peak").alias("is_peak_period"), "peak_event_name",
        "city", "postcode_pc4", "district", "housing_density", "zone_type",
        F.col("fail_risk_tier").alias("zone_risk_tier"), "parcel_locker_nearby",
        "warehouse_id", F.col("category_name").alias("product_category"),
        "carrier", "vehicle_type", "is_zero_emission", "order_value_eur", "weight_kg",
        "attempt_1_status", "attempt_2_status", "fail_reason", "final_status",
        "is_first_attempt_fail", "is_returned", "is_multi_attempt", "delivery_cost_eur",
        "route_km", "co2_emission_kg", "temp_celsius", "rain_mm", "wind_speed_kmh",
        F.col("is_peak_period").alias("shipment_in_peak"))


# V2 [J4 P11 P14]
def inventory_health(m) -> DataFrame:
    inv = latest_only(m, "mart_inventory_snapshot", "snapshot_date")
    w = m.dim_warehouse.select("warehouse_id", "city")
    return inv.join(w, "warehouse_id").select(
        "warehouse_id", "city", "product_category", "sku_code", "current_stock_units",
        "max_capacity_units", "utilisation_pct", "days_of_supply", "reorder_point",
        "stock_status", "stockout_days_ytd",
        derive.procurement_action().alias("procurement_action"),
        "inventory_value_eur", "snapshot_date")
