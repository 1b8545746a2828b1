"""Map the driver's TPC-H-style tables onto the delivery model.

The reference ships no data, so every delivery table is derived from the
given tables by fixed rules (shipment = line item, zone = customer nation,
city = customer region, driver = supplier, stock = monthly line-item flow,
daily volume = events).  The rules are integer/decimal expressions so any
SQL engine can rebuild the same rows.

Scale: the fact build is the only large job: orders ⋈ customer, then line
item ⋈ that on the order key, then ⋈ part — line items cross the network
twice when nothing is small enough to broadcast; AQE splits a skewed key.
Dimensions are bounded by construction (zones by nations, cities by
regions, the calendar by its day range); Spark broadcasts them by their
bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope import schemas as S
from parcelscope.functions import derive
from parcelscope.functions.metrics import COUNT_T, dec, label_by_index
from parcelscope.sources import calendar

# Fixed values of the fixture mapping (see FIXTURES.md, part B).
NOT_HOME_PRIORITIES = ["1-URGENT", "2-HIGH"]
POSTCODE_BASE = 1000
WAREHOUSE_PREFIX = "WH-"
CO2_KG_PER_KM_ZERO = "0.0200"
CO2_KG_PER_KM_FOSSIL = "0.2100"
REORDER_POINT = 500
REORDER_QTY = 1000
BASE_CAPACITY = 5000
CAPACITY_STEP = 2000
FORECAST_BASE = 60
# columns of the fact that follow from its own others (``derive.fact_flags``)
FLAGS = ("is_first_attempt_fail", "is_returned", "is_zero_emission", "is_multi_attempt")


def _wh(idx) -> F.Column:
    return F.concat(F.lit(WAREHOUSE_PREFIX), idx.cast("string"))


def fact_rows(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, part: DataFrame) -> DataFrame:
    """The source columns of each shipment, not yet derived: about half the
    bytes of the fact's row, so a load moves these."""
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                         "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                         "l_linestatus", "l_shipdate")
    o = orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    c = customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    p = part.select("p_partkey", F.xxhash64("p_type").alias("category_id"))
    # Join order: orders ⋈ customer first (order-sized shuffle), so line
    # items are shuffled only twice — by order key, then by part key — when
    # the sides are too large to broadcast.
    oc = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = (li.join(oc, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(p, F.col("l_partkey") == F.col("p_partkey")))
    return j.select(*li.columns, "o_orderpriority", "c_nationkey", "c_mktsegment", "category_id")


def derive_fact(rows: DataFrame, kept=()) -> DataFrame:
    """The fact's columns of ``fact_rows``, after the columns ``kept``; a fact
    column among these is taken as it is."""
    failed = (F.col("l_returnflag") == "R") & (
        F.col("l_quantity") <= F.lit(8) + (F.col("c_nationkey") % 5) * 4)
    second_ok = F.col("l_linestatus") == "F"
    day = F.to_date(F.col("l_shipdate"))
    veh_idx = F.col("l_suppkey") % 4
    route = (F.lit(1) + F.col("l_discount").cast("decimal(4,2)") * 100).cast("decimal(7,2)")
    co2_factor = F.when(veh_idx < 2, dec(CO2_KG_PER_KM_ZERO)).otherwise(dec(CO2_KG_PER_KM_FOSSIL))
    final = (F.when(~failed, F.lit("Delivered"))
             .when(second_ok, F.lit("Delivered (2nd attempt)"))
             .otherwise(F.lit(S.RETURNED)))
    columns = [
        F.concat_ws("-", F.lit("SHP"), F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
                    F.col("l_suppkey").cast("string")).alias("shipment_id"),
        (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int").alias("date_key"),
        (F.col("c_nationkey") + POSTCODE_BASE).cast("short").alias("postcode_pc4"),
        _wh(F.col("l_suppkey") % 5).alias("warehouse_id"),
        F.col("category_id"),
        F.col("l_shipdate").alias("dispatch_datetime"),
        F.when(final != S.RETURNED,
               F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber") * 7))
        .alias("delivery_datetime"),
        F.col("c_mktsegment").alias("carrier"),
        label_by_index(veh_idx, S.VEHICLE_TYPES).alias("vehicle_type"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("order_value_eur"),
        F.col("l_quantity").cast("decimal(7,2)").alias("weight_kg"),
        F.when(failed, F.lit(S.FAILED)).otherwise(F.lit("Success")).alias("attempt_1_status"),
        F.when(~failed, F.lit("N/A")).when(second_ok, F.lit("Success"))
        .otherwise(F.lit(S.FAILED)).alias("attempt_2_status"),
        F.when(failed, F.when(F.col("o_orderpriority").isin(NOT_HOME_PRIORITIES), F.lit(S.NOT_HOME))
               .otherwise(F.col("o_orderpriority"))).alias("fail_reason"),
        final.alias("final_status"),
        (F.lit(2) + F.col("l_quantity").cast("decimal(4,0)") * dec("0.10"))
        .cast("decimal(8,2)").alias("delivery_cost_eur"),
        route.alias("route_km"),
        (route * co2_factor).cast("decimal(8,4)").alias("co2_emission_kg"),
        (F.col("l_linenumber") * 3).cast("decimal(5,1)").alias("temp_celsius"),
        F.when(~((F.col("l_linenumber") == 7) & (F.col("l_suppkey") % 10 == 0)),
               (F.col("l_tax").cast("decimal(4,2)") * 120).cast("decimal(6,1)")).alias("rain_mm"),
        (F.col("l_linenumber") * 5).cast("decimal(5,1)").alias("wind_speed_kmh"),
        F.month(day).isin(11, 12).alias("is_peak_period"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
    ]
    names = [f for f in S.FACT_DELIVERIES.fieldNames() if f not in FLAGS]
    own = [c.alias(n) for n, c in zip(names, columns) if n not in kept]
    return derive.fact_flags(rows.select(*kept, *own))


def build_fact(lineitem: DataFrame, orders: DataFrame, customer: DataFrame,
               part: DataFrame) -> DataFrame:
    return derive_fact(fact_rows(lineitem, orders, customer, part))


def build_dim_postcode(nation: DataFrame, region: DataFrame) -> DataFrame:
    n = F.col("n_nationkey")
    hist = (F.lit(6) + n * dec("0.75")).cast("decimal(5,2)")
    return (nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                (n + POSTCODE_BASE).cast("short").alias("postcode_pc4"),
                F.col("r_name").alias("city"),
                F.col("n_name").alias("district"),
                (F.lit(52) + n * dec("0.01")).cast("decimal(7,4)").alias("latitude"),
                (F.lit(4) + n * dec("0.01")).cast("decimal(7,4)").alias("longitude"),
                F.lit(None).cast("int").alias("population_est"),
                F.lit(None).cast("int").alias("avg_income_eur"),
                label_by_index(n % 4, S.HOUSING_DENSITIES).alias("housing_density"),
                F.lit(None).cast("decimal(5,1)").alias("pct_apartments"),
                F.lit(None).cast("decimal(4,2)").alias("avg_parcel_per_wk"),
                hist.alias("historical_fail_rate_pct"),
                (n % 2 == 0).alias("parcel_locker_nearby"),
                label_by_index(n % 3, S.ZONE_TYPES).alias("zone_type"),
                derive.fail_risk_tier(hist).alias("fail_risk_tier"),
            ))


def build_dim_driver(supplier: DataFrame, region: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    otd = (F.lit(65) + (s * 17) % 35).cast("decimal(5,2)")
    fail = F.when(s % 23 == 7, F.lit(30)).otherwise(F.lit(2) + (s * 3) % 17).cast("decimal(5,2)")
    rating = ((F.lit(30) + s % 21).cast("decimal(4,0)") / 10).cast("decimal(3,2)")
    veh = label_by_index(s % 4, S.VEHICLE_TYPES)
    return (supplier.join(region, (s % 5) == F.col("r_regionkey"))
            .select(
                F.concat(F.lit("DRV-"), s.cast("string")).alias("driver_id"),
                F.col("s_name").alias("driver_name"),
                F.col("r_name").alias("city"),
                (s % 20).cast("short").alias("years_experience"),
                veh.alias("vehicle_type"),
                label_by_index(s % 3, S.CONTRACT_TYPES).alias("contract_type"),
                (F.lit(30) + s % 25).cast("short").alias("avg_deliveries_day"),
                rating.alias("avg_rating"),
                otd.alias("on_time_rate_pct"),
                fail.alias("fail_rate_pct"),
                (s % 10 != 4).alias("is_active"),
                F.date_add(F.lit("2018-01-01").cast("date"), (s % 1000).cast("int")).alias("join_date"),
                derive.performance_band(otd, fail).alias("performance_band"),
                derive.is_zero_emission(veh).alias("is_zero_emission"),
            ))


def build_dim_warehouse(supplier: DataFrame, region: DataFrame) -> DataFrame:
    """One row per warehouse some supplier ships from (index ``s_suppkey %
    5``), placed in the city of the region with that number."""
    used = supplier.select((F.col("s_suppkey") % 5).alias("r_regionkey")).distinct()
    k = F.col("r_regionkey")
    return region.join(used, "r_regionkey", "left_semi").select(
        _wh(k).alias("warehouse_id"),
        F.col("r_name").alias("city"),
        (F.lit(52) + k * dec("0.1")).cast("decimal(7,4)").alias("latitude"),
        (F.lit(4) + k * dec("0.1")).cast("decimal(7,4)").alias("longitude"),
        (F.lit(BASE_CAPACITY) + k * CAPACITY_STEP).cast("int").alias("max_capacity_units"),
    )


def build_dim_product_category(part: DataFrame) -> DataFrame:
    # one row per product type; the id is a hash of the name, so no global
    # numbering pass is needed and the fact can compute it independently
    return (part.select(F.col("p_type").alias("category_name")).distinct()
            .select(F.xxhash64("category_name").alias("category_id"), "category_name",
                    F.lit(None).cast("decimal(8,2)").alias("avg_order_value_eur"),
                    F.lit(None).cast("decimal(5,2)").alias("avg_weight_kg"),
                    F.lit(None).cast("decimal(5,2)").alias("base_fail_rate_pct"),
                    F.lit(None).cast("string").alias("cbs_commodity_group")))


def build_inventory_snapshot(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    li = lineitem.select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                         "l_extendedprice", "l_shipdate")
    p = part.select("p_partkey", "p_type")
    wh_idx = F.col("l_suppkey") % 5
    g = (li.join(p, F.col("l_partkey") == F.col("p_partkey"))
         .groupBy(F.last_day(F.to_date("l_shipdate")).alias("snapshot_date"),
                  wh_idx.alias("wh_idx"), F.col("p_type").alias("product_category"))
         .agg(F.sum("l_quantity").cast("bigint").alias("outbound"),
              F.sum(F.col("l_quantity") * F.col("l_linenumber")).cast("bigint").alias("stock"),
              F.count(F.lit(1)).alias("n"),
              F.min(F.to_date("l_shipdate")).alias("last_replenish_date"),
              F.sum(F.col("l_extendedprice").cast("decimal(10,2)")).alias("value")))
    supply = F.round(F.col("stock").cast(COUNT_T) / F.nullif(F.col("outbound"), F.lit(0)).cast(COUNT_T),
                     1).cast("decimal(24,1)")
    wh = _wh(F.col("wh_idx"))
    cap = (F.lit(BASE_CAPACITY) + F.col("wh_idx") * CAPACITY_STEP).cast("int")
    out = g.select(
        "snapshot_date",
        wh.alias("warehouse_id"),
        "product_category",
        F.concat(wh, F.lit("-"), F.col("product_category")).alias("sku_code"),
        F.col("stock").alias("current_stock_units"),
        cap.alias("max_capacity_units"),
        F.lit(REORDER_POINT).alias("reorder_point"),
        F.lit(REORDER_QTY).alias("reorder_qty"),
        F.col("outbound").alias("avg_daily_outbound"),
        supply.alias("days_of_supply"),
        (F.col("n") % 5).cast("short").alias("stockout_days_ytd"),
        "last_replenish_date",
        (F.lit(2) + F.length("product_category") % 3).cast("short").alias("supplier_lead_days"),
        F.round(F.col("value") / F.nullif(F.col("stock"), F.lit(0)).cast(COUNT_T), 2)
        .cast("decimal(24,2)").alias("unit_cost_eur"),
        F.col("value").cast("decimal(30,2)").alias("inventory_value_eur"),
        derive.stock_status(supply).alias("stock_status"),
    )
    return out.withColumn("utilisation_pct", derive.utilisation_pct())


def build_daily_forecast(events: DataFrame, region: DataFrame) -> DataFrame:
    g = (events.select(F.to_date("ts").alias("forecast_date"), (F.col("user_id") % 5).alias("k"))
         .groupBy("forecast_date", "k").agg(F.count(F.lit(1)).alias("actual")))
    d = F.col("forecast_date")
    hol = calendar.holiday_of(d)
    peak = calendar.peak_of(d)
    fc = (F.lit(FORECAST_BASE) + F.weekday(d)).cast("decimal(10,0)")
    out = (g.join(region, F.col("k") == F.col("r_regionkey"))
           .select(
               d, F.col("r_name").alias("city"),
               F.date_format(d, "EEEE").alias("day_of_week"),
               F.weekofyear(d).cast("short").alias("week_number"),
               F.date_format(d, "MMMM").alias("month_name"),
               F.year(d).cast("short").alias("year"),
               hol.isNotNull().alias("is_public_holiday"),
               peak.isNotNull().alias("is_peak_period"),
               peak.alias("peak_event_name"),
               F.col("actual").cast("decimal(10,0)").alias("actual_volume"),
               fc.alias("forecast_volume"),
               F.lit(None).cast("decimal(10,0)").alias("forecast_lower_95"),
               F.lit(None).cast("decimal(10,0)").alias("forecast_upper_95"),
               F.lit(None).cast("decimal(8,4)").alias("forecast_mape"),
               F.lit("Actual").alias("data_type"),
           ))
    return out.withColumn("forecast_error", derive.forecast_error())
