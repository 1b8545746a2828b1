"""Load, inspection and data-quality jobs over the model (S7–S13, M4–M10).

Each function is a query like the KPI ones: it reads the model (or the
given source tables) and returns a lazy DataFrame.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelscope import schemas as S
from parcelscope.operators import quality as Q
from parcelscope.operators.joins import top1_per_group
from parcelscope.plans import marts, routes
from parcelscope.session import shared_dir
from parcelscope.sources import calendar, ingest, raw_fixture, sheets
from parcelscope.sources.load import load_log
from parcelscope.sources.manifest import Catalog, literal_rows, new_id
from parcelscope.sources.model import MARKS, with_calendar


# S13 — calendar over the whole years the shipments span
def calendar_span(m) -> DataFrame:
    return calendar.calendar_spanning(m.fact_deliveries, "dispatch_datetime")


# S13 — holidays and peak periods as tables, here found in the shipments:
# each year's busiest month inside its busiest quarter, and its busiest day
def busy_periods(m):
    """(holidays, peaks) tables for ``with_calendar``."""
    days = (m.fact_deliveries.groupBy("date_key").agg(F.count(F.lit(1)).alias("n"))
            .join(m.dim_date.select("date_key", "full_date", "year"), "date_key"))
    top_day = top1_per_group(days, ["year"], [F.desc("n"), F.asc("full_date")])
    holidays = top_day.select("full_date", F.concat(F.lit("Busiest day "), F.col("year")).alias("holiday_name"))

    def busiest(unit: str, label: str, priority: int):
        start = F.to_date(F.date_trunc(unit, "full_date"))
        n = days.groupBy("year", start.alias("start_date")).agg(F.sum("n").alias("n"))
        end = F.date_sub(F.add_months("start_date", 1 if unit == "month" else 3), 1)
        return top1_per_group(n, ["year"], [F.desc("n"), F.asc("start_date")]).select(
            "start_date", end.alias("end_date"), F.concat(F.lit(label), F.col("year")).alias("peak_event_name"),
            F.lit(priority).alias("priority"))

    return holidays, busiest("month", "Busiest month ", 1).unionByName(busiest("quarter", "Busiest quarter ", 2))


def calendar_from_tables(m) -> DataFrame:
    """The calendar's marked days, with holidays and peaks from tables."""
    return (with_calendar(m, *busy_periods(m)).dim_date.where("is_public_holiday or is_peak_period")
            .select("date_key", "full_date", "is_public_holiday", "holiday_name", "is_peak_period", "peak_event_name"))


def peaks_from_tables(m) -> DataFrame:
    """KB4 on the model whose peaks come from a table."""
    return routes.peak_vs_normal(with_calendar(m, *busy_periods(m)))


# S8
def profile_deliveries(m) -> DataFrame:
    return ingest.profile(m.flat_fact)


# S9
def dispatch_range(m) -> DataFrame:
    return ingest.value_range(m.flat_rows, "dispatch_date")


def city_list(m) -> DataFrame:
    return ingest.distinct_values(m.flat_cities, "city")


# S10 — top-5 fail reasons including the NULL (no failure) group
def fail_reason_counts(m, k: int = 5) -> DataFrame:
    return ingest.value_counts(m.flat_rows, "fail_reason", k)


# S10 — as the load inspects the forecast sheet: top-5 peak events
# including the NULL (ordinary day) group
def peak_event_counts(m, k: int = 5) -> DataFrame:
    return ingest.value_counts(m.flat_forecast, "peak_event", k)


# VF [S11 U1] — row counts of the six flat tables the notebook loads
def flat_tables(m) -> dict:
    return {
        "dim_postcodes": m.flat_postcodes,
        "dim_drivers": m.flat_drivers,
        "fact_deliveries": m.flat_fact,
        "warehouse_inventory": m.flat_inventory,
        "daily_volume_forecast": m.flat_forecast,
        "kpi_summary": marts.build_monthly_kpi(m),
    }


# stored table behind each flat table
FLAT_OF = {"dim_postcodes": "dim_postcode", "dim_drivers": "dim_driver", "fact_deliveries": "fact_deliveries",
           "warehouse_inventory": "mart_inventory_snapshot", "daily_volume_forecast": "mart_daily_forecast",
           "kpi_summary": "mart_monthly_kpi"}


def verify_counts(m, expected: dict | None = None) -> DataFrame:
    """Counts of a committed model are the manifest's, noted while each table
    was written; other models are counted."""
    if not m.commits:
        return ingest.verify_counts(flat_tables(m), expected)
    shape = T.StructType([T.StructField("table_name", T.StringType()), T.StructField("row_count", T.LongType())])
    counts = literal_rows(m.spark, shape, [(flat, m.commits[t].row_count) for flat, t in FLAT_OF.items()])
    return counts if expected is None else ingest.with_expected(counts, expected)


# S11 — a load's tables against its sources: counts, status, total, flag
def verify_load(m) -> DataFrame:
    return ingest.verify_against(
        {"fact_deliveries": m.fact_deliveries, "dim_postcodes": m.dim_postcode, "dim_drivers": m.dim_driver},
        {"fact_deliveries": m.sources["lineitem"], "dim_postcodes": m.sources["nation"],
         "dim_drivers": m.sources["supplier"]})


# S7 — seed the reference warehouses / categories unless the key exists
def seed_warehouses(m) -> DataFrame:
    spark = m.spark
    seed = spark.createDataFrame(
        [(w, c, Decimal(la), Decimal(lo), cap) for w, c, la, lo, cap in S.WAREHOUSE_SEED],
        S.DIM_WAREHOUSE)
    return ingest.seed_if_absent(m.dim_warehouse, seed, ["warehouse_id"])


def seed_categories(m) -> DataFrame:
    spark = m.spark
    schema = T.StructType([f for f in S.DIM_PRODUCT_CATEGORY.fields if f.name != "category_id"])
    seed = (spark.createDataFrame(
        [(n, Decimal(v), Decimal(w), Decimal(r), g) for n, v, w, r, g in S.CATEGORY_SEED], schema)
        .withColumn("category_id", F.xxhash64("category_name")))
    out = ingest.seed_if_absent(m.dim_product_category, seed, ["category_id", "category_name"])
    return out.drop("category_id")


# M4–M6 on the fact: one aggregation pass for all row rules
def fact_rules() -> list:
    return [
        *Q.not_null("shipment_id", "date_key", "postcode_pc4", "warehouse_id", "category_id",
                    "dispatch_datetime", "carrier", "vehicle_type", "order_value_eur", "weight_kg",
                    "attempt_1_status", "final_status", "delivery_cost_eur"),
        Q.domain("vehicle_type", S.VEHICLE_TYPES),
        Q.domain("attempt_1_status", S.ATTEMPT_1_STATUSES),
        Q.domain("attempt_2_status", S.ATTEMPT_2_STATUSES),
        Q.domain("final_status", S.FINAL_STATUSES),
        Q.in_range("order_value_eur", lo=0, lo_inclusive=False),
        Q.in_range("weight_kg", lo=0, lo_inclusive=False),
        Q.in_range("delivery_cost_eur", lo=0),
    ]


def fact_quality_report(m) -> DataFrame:
    return Q.rule_report(m.fact_deliveries, fact_rules(), "fact_deliveries")


def dimension_quality_report(m) -> DataFrame:
    drivers = Q.rule_report(m.dim_driver, [
        *Q.not_null("driver_id", "driver_name", "city", "years_experience", "vehicle_type",
                    "contract_type", "is_active"),
        Q.domain("vehicle_type", S.VEHICLE_TYPES),
        Q.domain("contract_type", S.CONTRACT_TYPES),
        Q.in_range("avg_rating", 1, 5),
        Q.in_range("years_experience", lo=0),
    ], "dim_driver")
    zones = Q.rule_report(m.dim_postcode, [
        *Q.not_null("city", "latitude", "longitude"),
        Q.domain("housing_density", S.HOUSING_DENSITIES),
        Q.domain("zone_type", S.ZONE_TYPES),
    ], "dim_postcode")
    stock = Q.rule_report(m.mart_inventory_snapshot, [
        *Q.not_null("snapshot_date", "warehouse_id", "product_category"),
        Q.domain("stock_status", S.STOCK_STATUSES),
    ], "mart_inventory_snapshot")
    return Q.union_all([drivers, zones, stock])


# M7 — the shipment id is unique; the raw line key (order, line) is not
def key_uniqueness(m) -> DataFrame:
    return Q.union_all([
        Q.check_unique(m.fact_deliveries, ["shipment_id"], "fact_deliveries"),
        Q.check_unique(m.sources["lineitem"], ["l_orderkey", "l_linenumber"], "lineitem"),
        Q.check_unique(m.mart_inventory_snapshot, ["snapshot_date", "sku_code"],
                       "mart_inventory_snapshot"),
    ])


# M8 — every foreign key of the fact and the inventory snapshot; the keys
# of one child table are checked in a single pass over it
def reference_integrity(m) -> DataFrame:
    def ref(parent, key):
        return (m.tables[parent], key, parent)

    return Q.union_all([
        Q.check_references(m.fact_deliveries, [
            ref("dim_date", "date_key"), ref("dim_postcode", "postcode_pc4"),
            ref("dim_warehouse", "warehouse_id"), ref("dim_product_category", "category_id"),
        ], "fact_deliveries"),
        Q.check_references(m.mart_inventory_snapshot, [ref("dim_warehouse", "warehouse_id")],
                           "mart_inventory_snapshot"),
    ])


# M9 — validate the raw line items before they become shipments
def lineitem_rules() -> list:
    return [
        *Q.not_null("l_orderkey", "l_linenumber", "l_shipdate"),
        Q.domain("l_returnflag", ["A", "N", "R"]),
        Q.domain("l_linestatus", ["O", "F"]),
        Q.in_range("l_quantity", lo=0, lo_inclusive=False),
        Q.in_range("l_discount", 0, 1),
    ]


def lineitem_validation(m) -> DataFrame:
    """Rows per outcome: 'valid', 'rejected', and per reason that occurs (a
    row with two reasons counts under both), from one scan of the lines."""
    orders = m.sources["orders"].select(F.col("o_orderkey").alias("l_orderkey"))
    return Q.outcome_counts_by_key(m.sources["lineitem"], lineitem_rules(), ["l_orderkey", "l_linenumber"],
                                   orders, "l_orderkey")


# S6 S11 M10 — what the load committed: rows, partitions and newest values
def load_manifest(m) -> DataFrame:
    """The manifest rows of the model's tables, as committed."""
    ids = {c.load_id for c in m.commits.values()}
    rows = m.catalog.commits().filter(F.col("load_id").isin(list(ids)))
    marks = {t: k for t, own in MARKS.items() for k in own}
    newest = F.coalesce(*[F.when(F.col("table_name") == t, F.col("marks")[k]) for t, k in marks.items()])
    return rows.select("table_name", "load_type", "row_count", F.size("parts").alias("partitions"),
                       newest.alias("newest"))


# M10 — the log of the load: one row per table of the run (times left out)
def load_audit(m) -> DataFrame:
    """The final log rows of the load that committed the model's fact; for a
    model that was not written, the fact's row its load would log."""
    if m.commits:
        log = Q.latest_status(load_log(m.catalog).filter(F.col("load_id") == m.commits["fact_deliveries"].load_id))
    else:
        tagged = Q.tag_rejects(m.fact_deliveries, fact_rules())
        log = Q.audit_rows(Q.validation_counts(tagged), "fact_deliveries", "FULL", "SUCCESS")
    return log.select("table_name", "load_type", "rows_inserted", "rows_updated", "rows_rejected", "status",
                      "error_message", (F.col("duration_seconds") >= 0).alias("has_duration"))


# S1–S6 M5 M9 — raw sheets loaded by their contracts (each call is a load of its own)
def load_raw(m, *wanted):
    """(catalog, tables) of a load of the raw files of some sheets."""
    root = shared_dir(m.spark, "sheets", new_id())
    raw = {}
    for s in wanted:
        raw_fixture.write_raw(m, s, f"{root}/raw/{s.name}")
        raw[s.name] = sheets.read_sheet(m.spark, f"{root}/raw/{s.name}", s)
    catalog = Catalog(m.spark, f"{root}/tables")
    return catalog, sheets.load_sheets(catalog, raw, wanted)


def _loaded(sheet):
    return lambda m: load_raw(m, sheet)[1][sheet.name]


sheet_drivers, sheet_deliveries = _loaded(sheets.DRIVERS), _loaded(sheets.DELIVERIES)
sheet_inventory, sheet_forecast = _loaded(sheets.INVENTORY), _loaded(sheets.FORECAST)


def sheet_rejects(m) -> DataFrame:
    """Refused rows of the sheets per reason."""
    catalog, _ = load_raw(m, *sheets.SHEETS)
    return Q.union_all([Q.reject_summary(sheets.rejects(catalog, s)).select(F.lit(s.name).alias("sheet"), "reason", "rejected_rows")
                        for s in sheets.SHEETS])


# P7 — the daily volume mart with its derived forecast error
def daily_forecast(m) -> DataFrame:
    return m.mart_daily_forecast.select(
        "forecast_date", "city", "day_of_week", "week_number", "month_name", "year",
        "is_public_holiday", "is_peak_period", "peak_event_name", "actual_volume",
        "forecast_volume", "forecast_error", "data_type")
