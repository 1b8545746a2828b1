"""Table contracts, enumerations and query parameters.

Fixed values: the labels, thresholds and factors below must equal the
published delivery-KPI definitions for the results to match, so they are
kept together here, in their natural order, as plain text.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values — enumerations (domains checked by quality.check_domain)
# ---------------------------------------------------------------------------
VEHICLE_TYPES = ["Cargo Bike", "Electric Van", "Diesel Van", "Cargo Van"]
ZERO_EMISSION_VEHICLES = ["Cargo Bike", "Electric Van"]
FOSSIL_VEHICLES = ["Cargo Van", "Diesel Van"]
CONTRACT_TYPES = ["Fulltime", "Parttime", "Freelance"]
ZONE_TYPES = ["Residential", "Commercial", "Mixed"]
HOUSING_DENSITIES = ["Very High", "High", "Medium", "Low"]
ATTEMPT_1_STATUSES = ["Success", "Failed"]
ATTEMPT_2_STATUSES = ["Success", "Failed", "N/A"]
FINAL_STATUSES = ["Delivered", "Delivered (2nd attempt)", "Returned"]
DELIVERED_STATUSES = ["Delivered", "Delivered (2nd attempt)"]
STOCK_STATUSES = ["Critical", "Low", "Normal"]
DATA_TYPES = ["Actual", "Forecast"]
LOAD_TYPES = ["FULL", "INCREMENTAL", "REFRESH"]
LOAD_STATUSES = ["RUNNING", "SUCCESS", "FAILED"]

FAILED = "Failed"
NOT_HOME = "Not home"
NO_FAILURE = "No Failure"
RETURNED = "Returned"

# ---------------------------------------------------------------------------
# Fixed values — derived-column rules
# ---------------------------------------------------------------------------
# fail_risk_tier: historical rate >= 20 High, >= 12 Medium, else Low
RISK_TIER_HIGH = 20
RISK_TIER_MEDIUM = 12
RISK_TIERS = ["High", "Medium", "Low"]
# performance_band: (min otd, max fail) per band, checked in order
BAND_ELITE = ("Elite", 95, 8)
BAND_STANDARD = ("Standard", 85, 15)
BAND_DEVELOPING = ("Developing", 70)
BAND_UNDER_REVIEW = "Under Review"
PERFORMANCE_BANDS = ["Elite", "Standard", "Developing", "Under Review"]
# rain bands: upper bounds (exclusive) after the exact-zero band
RAIN_BANDS = ["No rain", "Light (0-2mm)", "Moderate (2-5mm)", "Heavy (5-8mm)", "Extreme (8mm+)"]
RAIN_CUTS = [2, 5, 8]
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
PERIOD_PEAK = "Peak"
PERIOD_NORMAL = "Normal"

# procurement labels: the KPI report and the health view use different texts
PROCUREMENT_FLAGS = ("🔴 Order Now", "🟡 Order Soon", "🟢 OK")
PROCUREMENT_ACTIONS = ("ORDER NOW", "ORDER SOON", "OK")
# driver outlier alert labels
ALERT_LABELS = ("🔴 Flag", "🟡 Watch", "🟢 Normal")
# locker labels of the advanced report (cut-offs 16 and 12, no locker)
LOCKER_LABELS_KPI = ("🔴 Install Locker — High Priority", "🟡 Review Coverage", "🟢 Covered")
LOCKER_CUTS_KPI = (16, 12)
# locker labels of the postcode-risk question (cut-off 11, locker 'No')
LOCKER_LABELS_BQ = ("Install locker - High Priority", "Review coverage", "Monitor")
LOCKER_CUT_BQ = 11

# ---------------------------------------------------------------------------
# Fixed values — query parameters (defaults equal the published queries)
# ---------------------------------------------------------------------------
DIESEL_KG_PER_KM = "0.21"          # counterfactual emission factor
ELECTRIC_KG_PER_SHIPMENT = "0.0006"
TARGET_DAILY_VOLUME = "40.0"       # efficiency index denominator
ROLLING_ALERT_PCT = 15
ROLLING_ROWS = 7
TRAILING_DAYS = 90
DATA_YEARS = 3                     # the dataset spans three years
SCALE_MULTIPLIER = 45000
LOCKER_EFFECT = "0.60"
DISPATCH_EFFECT = "0.70"
EV_COST_EFFECT = "0.02"
EV_CO2_EFFECT = "0.30"
# zones of the locker scenario (a parameter of Q5a and Q5c) and its city
LOCKER_ZONES = (3025, 3012, 3021)
LOCKER_CITY = "Rotterdam"
SCENARIO_NAMES = (
    "Parcel lockers — {place}",
    "Predictive dispatch — all cities",
    "Fleet electrification — 50% to 80%",
)
# composite driver score weights: otd, (100 - fail), rating share of 5
SCORE_WEIGHTS = ("0.5", "0.3", "0.2")
# mart refresh: metrics overwritten on key conflict (others keep old values)
MART_KEYS = ["year_month", "city"]
MART_UPDATE_COLUMNS = [
    "total_shipments", "successful_deliveries", "failed_first_attempt",
    "otd_rate_pct", "first_attempt_fail_pct", "avg_delivery_cost_eur",
    "total_revenue_eur", "total_co2_kg", "electric_vehicle_pct",
]

# seed rows (insert-if-absent) for the warehouse and category dimensions
WAREHOUSE_SEED = [
    ("WH-AMS-01", "Amsterdam", "52.3123", "4.9432", 15000),
    ("WH-RTD-01", "Rotterdam", "51.8872", "4.5292", 12000),
    ("WH-UTR-01", "Utrecht", "52.0642", "5.0847", 8000),
    ("WH-DHG-01", "Den Haag", "52.0417", "4.3614", 9000),
    ("WH-EHV-01", "Eindhoven", "51.4091", "5.5019", 5000),
]
CATEGORY_SEED = [
    ("Electronics", "285.00", "1.20", "10.0", "Machinery and transport equipment"),
    ("Fashion", "65.00", "0.40", "14.0", "Miscellaneous manufactured articles"),
    ("Home & Garden", "95.00", "3.10", "16.0", "Manufactured goods"),
    ("Books & Media", "22.00", "0.60", "8.0", "Miscellaneous manufactured articles"),
    ("Sports", "78.00", "1.80", "12.0", "Miscellaneous manufactured articles"),
    ("Health & Beauty", "45.00", "0.50", "9.0", "Chemicals and related products"),
    ("Food & Grocery", "38.00", "2.40", "7.0", "Food and live animals"),
    ("Toys & Games", "55.00", "0.90", "11.0", "Miscellaneous manufactured articles"),
]

# load-time renames of the flat model (S2 drivers, S3 deliveries, S4
# inventory, S5 forecast)
RENAME_DRIVERS = {"name": "driver_name", "active": "is_active"}
RENAME_DELIVERIES = {"month": "month_name", "year": "year_num", "year_month": "yr_month"}
RENAME_INVENTORY = {"status": "stock_status"}
RENAME_FORECAST = {"date": "forecast_date", "month": "month_name", "year": "year_num"}
# the six flat tables the load writes, with the rename map each one gets
FLAT_RENAMES = {
    "dim_postcodes": {},
    "dim_drivers": RENAME_DRIVERS,
    "fact_deliveries": RENAME_DELIVERIES,
    "warehouse_inventory": RENAME_INVENTORY,
    "daily_volume_forecast": RENAME_FORECAST,
    "kpi_summary": {},
}

# ---------------------------------------------------------------------------
# Star-model contracts (Spark types of the declared columns)
# ---------------------------------------------------------------------------
D = T.DecimalType


def _s(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


DIM_DATE = _s(
    ("date_key", T.IntegerType()), ("full_date", T.DateType()), ("year", T.ShortType()),
    ("quarter", T.ShortType()), ("month_number", T.ShortType()), ("month_name", T.StringType()),
    ("week_number", T.ShortType()), ("day_of_week_number", T.ShortType()),
    ("day_of_week_name", T.StringType()), ("day_of_month", T.ShortType()),
    ("is_weekend", T.BooleanType()), ("is_public_holiday", T.BooleanType()),
    ("holiday_name", T.StringType()), ("is_peak_period", T.BooleanType()),
    ("peak_event_name", T.StringType()), ("year_month", T.StringType()),
    ("year_quarter", T.StringType()),
)

DIM_POSTCODE = _s(
    ("postcode_pc4", T.ShortType()), ("city", T.StringType()), ("district", T.StringType()),
    ("latitude", D(7, 4)), ("longitude", D(7, 4)), ("population_est", T.IntegerType()),
    ("avg_income_eur", T.IntegerType()), ("housing_density", T.StringType()),
    ("pct_apartments", D(5, 1)), ("avg_parcel_per_wk", D(4, 2)),
    ("historical_fail_rate_pct", D(5, 2)), ("parcel_locker_nearby", T.BooleanType()),
    ("zone_type", T.StringType()), ("fail_risk_tier", T.StringType()),
)

DIM_DRIVER = _s(
    ("driver_id", T.StringType()), ("driver_name", T.StringType()), ("city", T.StringType()),
    ("years_experience", T.ShortType()), ("vehicle_type", T.StringType()),
    ("contract_type", T.StringType()), ("avg_deliveries_day", T.ShortType()),
    ("avg_rating", D(3, 2)), ("on_time_rate_pct", D(5, 2)), ("fail_rate_pct", D(5, 2)),
    ("is_active", T.BooleanType()), ("join_date", T.DateType()),
    ("performance_band", T.StringType()), ("is_zero_emission", T.BooleanType()),
)

DIM_WAREHOUSE = _s(
    ("warehouse_id", T.StringType()), ("city", T.StringType()), ("latitude", D(7, 4)),
    ("longitude", D(7, 4)), ("max_capacity_units", T.IntegerType()),
)

DIM_PRODUCT_CATEGORY = _s(
    ("category_id", T.LongType()), ("category_name", T.StringType()),
    ("avg_order_value_eur", D(8, 2)), ("avg_weight_kg", D(5, 2)),
    ("base_fail_rate_pct", D(5, 2)), ("cbs_commodity_group", T.StringType()),
)

FACT_DELIVERIES = _s(
    ("shipment_id", T.StringType()), ("date_key", T.IntegerType()),
    ("postcode_pc4", T.ShortType()), ("warehouse_id", T.StringType()),
    ("category_id", T.LongType()), ("dispatch_datetime", T.TimestampNTZType()),
    ("delivery_datetime", T.TimestampNTZType()), ("carrier", T.StringType()),
    ("vehicle_type", T.StringType()), ("order_value_eur", D(10, 2)), ("weight_kg", D(7, 2)),
    ("attempt_1_status", T.StringType()), ("attempt_2_status", T.StringType()),
    ("fail_reason", T.StringType()), ("final_status", T.StringType()),
    ("delivery_cost_eur", D(8, 2)), ("route_km", D(7, 2)), ("co2_emission_kg", D(8, 4)),
    ("temp_celsius", D(5, 1)), ("rain_mm", D(6, 1)), ("wind_speed_kmh", D(5, 1)),
    ("is_first_attempt_fail", T.BooleanType()), ("is_returned", T.BooleanType()),
    ("is_peak_period", T.BooleanType()), ("is_zero_emission", T.BooleanType()),
    ("is_multi_attempt", T.BooleanType()), ("year_month", T.StringType()),
)

MART_MONTHLY_KPI = _s(
    ("year_month", T.StringType()), ("city", T.StringType()),
    ("total_shipments", T.LongType()), ("successful_deliveries", T.LongType()),
    ("failed_first_attempt", T.LongType()), ("returned_shipments", T.LongType()),
    ("otd_rate_pct", D(6, 2)), ("first_attempt_fail_pct", D(6, 2)),
    ("return_rate_pct", D(6, 2)), ("avg_delivery_cost_eur", D(8, 2)),
    ("total_revenue_eur", D(30, 2)), ("total_co2_kg", D(30, 4)),
    ("avg_co2_per_shipment_kg", D(14, 6)), ("total_route_km", D(30, 2)),
    ("avg_weight_kg", D(9, 2)), ("top_product_category", T.StringType()),
    ("electric_vehicle_pct", D(5, 1)), ("otd_rate_mom_change_pp", D(6, 2)),
    ("cost_mom_change_pct", D(6, 2)), ("refreshed_at", T.TimestampType()),
)

MART_INVENTORY_SNAPSHOT = _s(
    ("snapshot_date", T.DateType()), ("warehouse_id", T.StringType()),
    ("product_category", T.StringType()), ("sku_code", T.StringType()),
    ("current_stock_units", T.LongType()), ("max_capacity_units", T.IntegerType()),
    ("reorder_point", T.IntegerType()), ("reorder_qty", T.IntegerType()),
    ("avg_daily_outbound", T.LongType()), ("days_of_supply", D(24, 1)),
    ("stockout_days_ytd", T.ShortType()), ("last_replenish_date", T.DateType()),
    ("supplier_lead_days", T.ShortType()), ("unit_cost_eur", D(24, 2)),
    ("inventory_value_eur", D(30, 2)), ("stock_status", T.StringType()),
    ("utilisation_pct", D(24, 2)),
)

MART_DAILY_FORECAST = _s(
    ("forecast_date", T.DateType()), ("city", T.StringType()), ("day_of_week", T.StringType()),
    ("week_number", T.ShortType()), ("month_name", T.StringType()), ("year", T.ShortType()),
    ("is_public_holiday", T.BooleanType()), ("is_peak_period", T.BooleanType()),
    ("peak_event_name", T.StringType()), ("actual_volume", D(10, 0)),
    ("forecast_volume", D(10, 0)), ("forecast_lower_95", D(10, 0)),
    ("forecast_upper_95", D(10, 0)), ("forecast_error", D(10, 0)),
    ("forecast_mape", D(8, 4)), ("data_type", T.StringType()),
)

AUDIT_LOAD_LOG = _s(
    ("table_name", T.StringType()), ("load_type", T.StringType()),
    ("rows_inserted", T.LongType()), ("rows_updated", T.LongType()),
    ("rows_rejected", T.LongType()), ("start_time", T.TimestampType()),
    ("end_time", T.TimestampType()), ("duration_seconds", D(18, 2)),
    ("status", T.StringType()), ("error_message", T.StringType()),
    ("loaded_by", T.StringType()), ("load_id", T.StringType()),
)

# stored sums the monthly mart is projected from, one row per month, city and
# category; additive, so a batch is merged in and a withdrawn one taken out
KPI_STATE = _s(
    ("year_month", T.StringType()), ("city", T.StringType()), ("category_name", T.StringType()),
    ("n", T.LongType()), ("ok", T.LongType()), ("fails", T.LongType()), ("returns", T.LongType()),
    ("cost", D(20, 2)), ("n_cost", T.LongType()), ("value", D(22, 2)), ("co2", D(20, 4)),
    ("n_co2", T.LongType()), ("km", D(20, 2)), ("weight", D(20, 2)), ("n_weight", T.LongType()),
    ("zero", T.LongType()),
)
