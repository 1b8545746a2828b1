"""Warehouse and inventory (snapshot mart): KD1–KD3.

"Latest snapshot" is a scalar subquery on ``max(snapshot_date)``; with the
mart partitioned by ``snapshot_date`` the filter prunes to one folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelscope import schemas as S
from parcelscope.functions import derive
from parcelscope.functions import metrics as M
from parcelscope.functions.metrics import count_if
from parcelscope.operators.joins import latest_only


def _latest_with_city(m) -> DataFrame:
    inv = latest_only(m, "mart_inventory_snapshot", "snapshot_date")
    return inv.join(m.dim_warehouse.select("warehouse_id", "city"), "warehouse_id")


# KD1 [J4 P11 P14] — status sorted descending as text: Normal, Low, Critical
def inventory_status(m, labels=S.PROCUREMENT_FLAGS) -> DataFrame:
    return (_latest_with_city(m).select(
        "city", "warehouse_id", "product_category", "sku_code", "current_stock_units",
        "max_capacity_units", "utilisation_pct", "days_of_supply", "reorder_point",
        "reorder_qty", "avg_daily_outbound", "stock_status",
        derive.procurement_action(labels=labels).alias("procurement_flag"),
        "stockout_days_ytd", "inventory_value_eur", "last_replenish_date", "supplier_lead_days")
        .orderBy(F.desc("stock_status"), "days_of_supply", "sku_code", "warehouse_id"))


# KD2 [A2 P14]
def inventory_value(m) -> DataFrame:
    return (_latest_with_city(m).groupBy("city", "warehouse_id").agg(
        F.sum("inventory_value_eur").alias("total_inventory_value_eur"),
        M.round_mean(F.col("utilisation_pct"), 1).alias("avg_utilisation_pct"),
        count_if(F.col("stock_status") == "Critical").alias("critical_sku_count"),
        count_if(F.col("stock_status") == "Low").alias("low_sku_count"),
        F.sum("stockout_days_ytd").alias("total_stockout_days"))
        .orderBy(F.desc("total_inventory_value_eur"), "city", "warehouse_id"))


# KD3 [W6] — 7-row moving mean of the already rounded daily average
def supply_trend(m, rows: int = S.ROLLING_ROWS) -> DataFrame:
    daily = m.mart_inventory_snapshot.groupBy("snapshot_date", "warehouse_id").agg(
        M.round_mean(F.col("days_of_supply"), 1).alias("avg_days_of_supply"),
        count_if(F.col("stock_status") == "Critical").alias("critical_skus"))
    w = Window.partitionBy("warehouse_id").orderBy("snapshot_date").rowsBetween(-(rows - 1), 0)
    moving = F.sum("avg_days_of_supply").over(w) / F.count("avg_days_of_supply").over(w).cast(M.COUNT_T)
    return (daily.withColumn("rolling_7d_avg_supply", F.round(moving, 1))
            .orderBy("warehouse_id", F.desc("snapshot_date")))
