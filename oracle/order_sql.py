"""Oracle SQL (DuckDB) for the order of the sorted statements."""

from oracle.dims_sql import SQL as DIMS
from oracle.star_sql import SQL as STAR

BAND = "CASE performance_band WHEN 'Elite' THEN 1 WHEN 'Standard' THEN 2 WHEN 'Developing' THEN 3 ELSE 4 END"
# statement: (its ORDER BY, the columns that name a row)
SORTS = {
    "postcode_performance": ("actual_fail_rate_pct DESC, postcode_pc4", ["postcode_pc4"]),
    "fail_reason_by_city": ("city, occurrences DESC, fail_reason", ["city", "fail_reason"]),
    "vehicle_mix_by_city": ("city, shipments DESC, vehicle_type", ["city", "vehicle_type"]),
    "driver_scorecard": ("composite_score DESC, driver_id", ["driver_id"]),
    "driver_outliers": ("z_score DESC NULLS FIRST, driver_id", ["driver_id"]),
    "vehicle_fail_stats": ("avg_fail_rate, vehicle_type", ["vehicle_type"]),
    "band_distribution": (f"city, {BAND}", ["city", "performance_band"]),
    "inventory_status": ("stock_status DESC, days_of_supply, sku_code, warehouse_id", ["sku_code", "warehouse_id"]),
    "inventory_value": ("total_inventory_value_eur DESC, city, warehouse_id", ["warehouse_id"]),
}
STATEMENTS = DIMS | STAR


def _positions(name: str) -> str:
    order, names = SORTS[name]
    return (f"SELECT '{name}' AS statement, row_number() OVER (ORDER BY {order}) AS position,\n"
            f"       concat_ws('|', {', '.join(names)}) AS row_name FROM (\n{STATEMENTS[name]})")


SQL = {"statement_positions": "\nUNION ALL\n".join(_positions(n) for n in SORTS)}
