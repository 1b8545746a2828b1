"""Route performance (star model): KB1–KB4."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelscope.functions import derive
from parcelscope.functions import metrics as M
from parcelscope.functions.metrics import count_if
from parcelscope.operators.joins import day_zone_rollup, per_zone, star

PC_DIMS = ["city", "district", "latitude", "longitude", "zone_type", "housing_density",
           "fail_risk_tier", "parcel_locker_nearby", "historical_fail_rate_pct"]


def N():
    return F.count(F.lit(1))


def FAIL():
    return F.col("is_first_attempt_fail")


# KB1 [J2 A7 A8] — one row per zone with its dimension attributes
def postcode_performance(m) -> DataFrame:
    z = per_zone(m, [
        F.count("shipment_id").alias("total_shipments"),
        count_if(FAIL()).alias("_fails"), N().alias("_n"),
        M.round_mean(F.col("route_km"), 2).alias("avg_route_km"),
        M.round_mean(F.col("delivery_cost_eur"), 2).alias("avg_cost_eur"),
        M.round_mean(F.col("co2_emission_kg"), 3, 1000).alias("avg_co2_grams")], attrs=PC_DIMS)
    exact = F.col("_fails").cast(M.COUNT_T) * 100 / M.nz(F.col("_n")).cast(M.COUNT_T)
    return (z.select(
        "postcode_pc4", *PC_DIMS, "total_shipments",
        F.round(exact, 2).alias("actual_fail_rate_pct"),
        F.round(exact - F.col("historical_fail_rate_pct"), 2).alias("fail_rate_vs_benchmark_pp"),
        "avg_route_km", "avg_cost_eur", "avg_co2_grams")
        .orderBy(F.desc("actual_fail_rate_pct"), "postcode_pc4"))


# KB2 [P18 W2 F3] — groups by the raw reason, labels NULL as 'No Failure'; the share is
# of ALL shipments of the city (successes included)
def fail_reason_by_city(m) -> DataFrame:
    f = star(m, ["fail_reason"], dim_postcode=["city"])
    g = f.groupBy("city", "fail_reason").agg(N().alias("occurrences"))
    return (g.select("city", derive.fail_reason_label().alias("fail_reason"), "occurrences",
                     M.share_of_total(F.col("occurrences"), Window.partitionBy("city"), 2)
                     .alias("pct_of_city_shipments"))
            .orderBy("city", F.desc("occurrences"), "fail_reason"))


# KB3 [W2 A7]
def vehicle_mix_by_city(m) -> DataFrame:
    f = star(m, ["vehicle_type", "is_zero_emission", "route_km", "delivery_cost_eur",
                 "co2_emission_kg", "is_first_attempt_fail"], dim_postcode=["city"])
    g = f.groupBy("city", "vehicle_type", "is_zero_emission").agg(
        N().alias("shipments"),
        M.round_mean(F.col("route_km"), 2).alias("avg_route_km"),
        M.round_mean(F.col("delivery_cost_eur"), 2).alias("avg_cost_eur"),
        M.round_mean(F.col("co2_emission_kg"), 3, 1000).alias("avg_co2_grams"),
        M.rate(FAIL(), 2).alias("fail_rate_pct"))
    return (g.select("city", "vehicle_type", "shipments",
                     M.share_of_total(F.col("shipments"), Window.partitionBy("city"), 1)
                     .alias("city_vehicle_mix_pct"),
                     "avg_route_km", "avg_cost_eur", "avg_co2_grams", "fail_rate_pct",
                     "is_zero_emission")
            .orderBy("city", F.desc("shipments"), "vehicle_type"))


# KB4 [P16 A7] — the peak flag is the shipment's, the event name the calendar's
def peak_vs_normal(m) -> DataFrame:
    p = day_zone_rollup(m, [
        N().alias("shipments"), count_if(FAIL()).alias("_fails"),
        F.sum("delivery_cost_eur").alias("_cost"), F.count("delivery_cost_eur").alias("_n_cost"),
        F.sum("route_km").alias("_km"), F.count("route_km").alias("_n_km")],
        ["city", "peak_event_name", "is_peak_period"], by=["is_peak_period"],
        dim_date=["peak_event_name"], dim_postcode=["city"])
    return (p.select("city", "peak_event_name", derive.period_type().alias("period_type"), "shipments",
                     F.round(M.ratio(F.col("_cost"), F.col("_n_cost")), 2).alias("avg_cost_eur"),
                     M.pct(F.col("_fails"), F.col("shipments"), 2).alias("fail_rate_pct"),
                     F.round(M.ratio(F.col("_km"), F.col("_n_km")), 2).alias("avg_route_km"))
            .orderBy("city", "period_type", "peak_event_name"))
