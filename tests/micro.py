"""Hand-made delivery models for edge cases the mapped data cannot show."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from parcelscope import schemas as S
from parcelscope.functions import derive
from parcelscope.sources import calendar
from parcelscope.sources.model import Model

ZONES = [  # postcode, city, district, hist rate, locker
    (1001, "Amsterdam", "Centrum", Decimal("9.00"), True),
    (1002, "Amsterdam", "Noord", Decimal("14.00"), False),
    (3001, "Rotterdam", "Centrum", Decimal("21.00"), False),
]
CATEGORIES = ["Books", "Electronics", "Fashion"]


def shipment(i, day, postcode, failed=False, category="Books", vehicle="Cargo Bike",
             cost="5.00", second=None, reason=None, returned=False):
    d = dt.datetime.fromisoformat(day)
    second = second if second is not None else ("N/A" if not failed else "Success")
    final = "Returned" if returned else ("Delivered (2nd attempt)" if failed else "Delivered")
    return {
        "shipment_id": f"S{i}", "date_key": d.year * 10000 + d.month * 100 + d.day,
        "postcode_pc4": postcode, "warehouse_id": "WH-0", "category": category,
        "dispatch_datetime": d, "delivery_datetime": None if returned else d + dt.timedelta(hours=5),
        "carrier": "PostNL", "vehicle_type": vehicle, "order_value_eur": Decimal("50.00"),
        "weight_kg": Decimal("1.50"), "attempt_1_status": "Failed" if failed else "Success",
        "attempt_2_status": second, "fail_reason": reason if failed else None, "final_status": final,
        "delivery_cost_eur": Decimal(cost), "route_km": Decimal("10.00"),
        "co2_emission_kg": Decimal("0.2000"), "temp_celsius": Decimal("10.0"),
        "rain_mm": Decimal("1.0"), "wind_speed_kmh": Decimal("5.0"),
        "is_peak_period": d.month in (11, 12), "year_month": d.strftime("%Y-%m"),
    }


def model(spark, shipments, drivers=None) -> Model:
    cats = spark.createDataFrame([(c,) for c in CATEGORIES], "category_name string").select(
        F.xxhash64("category_name").alias("category_id"), "category_name",
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in S.DIM_PRODUCT_CATEGORY.fields[2:]])
    rows = []
    for s in shipments:
        r = dict(s)
        r.pop("category")
        rows.append(r)
    base_schema = S.FACT_DELIVERIES
    plain = [f for f in base_schema.fields
             if f.name not in ("category_id", "is_first_attempt_fail", "is_returned",
                               "is_zero_emission", "is_multi_attempt")]
    from pyspark.sql import types as T
    fact = spark.createDataFrame([tuple(r[f.name] for f in plain) + (s["category"],)
                                  for r, s in zip(rows, shipments)],
                                 T.StructType(plain + [T.StructField("category", T.StringType())]))
    fact = derive.fact_flags(fact.withColumn("category_id", F.xxhash64("category")).drop("category"))
    fact = fact.select(*[f.name for f in base_schema.fields])
    zones = spark.createDataFrame(
        [(pc, city, dist, None, None, None, None, "High", None, None, h, lock, "Residential")
         for pc, city, dist, h, lock in ZONES],
        T.StructType(S.DIM_POSTCODE.fields[:-1])).withColumn("fail_risk_tier", derive.fail_risk_tier())
    tables = {
        "fact_deliveries": fact,
        "dim_date": calendar.build_dim_date(spark, "2024-01-01", "2024-12-31"),
        "dim_postcode": zones,
        "dim_warehouse": spark.createDataFrame([("WH-0", "Amsterdam", None, None, 1000)], S.DIM_WAREHOUSE),
        "dim_product_category": cats,
    }
    if drivers is not None:
        tables["dim_driver"] = drivers
    return Model(spark, tables)


def drivers(spark, rows):
    """rows: (driver_id, city, fail_rate, active)."""
    data = [(i, f"name {i}", city, 3, "Cargo Bike", "Fulltime", 40, Decimal("4.50"), Decimal("90.00"),
             Decimal(fail), active, dt.date(2020, 1, 1), "Standard", True)
            for i, city, fail, active in rows]
    return spark.createDataFrame(data, S.DIM_DRIVER)
