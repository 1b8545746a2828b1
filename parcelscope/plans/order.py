"""Order of the sorted statements, as data (O1, O2).

A result's rows come in an order that no set comparison sees.  ``ORDERS`` names
each statement's sort keys; ``statement_positions`` counts every row's position
under them, in ranges (``operators.ranks``), so the order itself can be joined,
stored and compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope import schemas as S
from parcelscope.functions import metrics as M
from parcelscope.operators.ranks import positions
from parcelscope.plans import drivers, inventory, routes


def band_rank():
    return M.rank_of(F.col("performance_band"), S.PERFORMANCE_BANDS[:3])


# statement: (query, sort keys, columns that name the row)
ORDERS = {
    "postcode_performance": (routes.postcode_performance, [("actual_fail_rate_pct", "desc"), ("postcode_pc4", "asc")],
                             ["postcode_pc4"]),
    "fail_reason_by_city": (routes.fail_reason_by_city,
                            [("city", "asc"), ("occurrences", "desc"), ("fail_reason", "asc")], ["city", "fail_reason"]),
    "vehicle_mix_by_city": (routes.vehicle_mix_by_city,
                            [("city", "asc"), ("shipments", "desc"), ("vehicle_type", "asc")], ["city", "vehicle_type"]),
    "driver_scorecard": (drivers.driver_scorecard, [("composite_score", "desc"), ("driver_id", "asc")], ["driver_id"]),
    "driver_outliers": (drivers.driver_outliers, [("z_score", "desc_nulls_first"), ("driver_id", "asc")], ["driver_id"]),
    "vehicle_fail_stats": (drivers.vehicle_fail_stats, [("avg_fail_rate", "asc"), ("vehicle_type", "asc")],
                           ["vehicle_type"]),
    "band_distribution": (lambda m: drivers.band_distribution(m).withColumn("band_rank", band_rank()),
                          [("city", "asc"), ("band_rank", "asc")], ["city", "performance_band"]),
    "inventory_status": (inventory.inventory_status,
                         [("stock_status", "desc"), ("days_of_supply", "asc"), ("sku_code", "asc"),
                          ("warehouse_id", "asc")], ["sku_code", "warehouse_id"]),
    "inventory_value": (inventory.inventory_value,
                        [("total_inventory_value_eur", "desc"), ("city", "asc"), ("warehouse_id", "asc")],
                        ["warehouse_id"]),
}


def statement_order(m, name: str) -> DataFrame:
    """``(statement, position, row_name)`` of one sorted statement."""
    query, order, names = ORDERS[name]
    rows = query(m).select(*dict.fromkeys([c for c, _ in order] + names))
    return positions(rows, "position", order).select(
        F.lit(name).alias("statement"), "position",
        F.concat_ws("|", *[F.col(c).cast("string") for c in names]).alias("row_name"))


def statement_positions(m) -> DataFrame:
    return reduce(DataFrame.unionByName, [statement_order(m, name) for name in ORDERS])
