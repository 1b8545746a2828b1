"""Advanced analytics (star model): KE1–KE6.

Windows (running total, 7-row moving average) run per city over rows that
are already aggregated to a month or a day, so a window partition is at
most a few thousand rows however large the fact grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelscope import schemas as S
from parcelscope.functions import derive
from parcelscope.functions import metrics as M
from parcelscope.functions.metrics import count_if, dec, sum_if
from parcelscope.operators.joins import day_zone_rollup, newest, per_zone, star
from parcelscope.operators.ranks import total


def N():
    return F.count(F.lit(1))


def FAIL():
    return F.col("is_first_attempt_fail")


# KE1 [P15 A14 O2 F4] — grouped by the band label, ordered by the band's rank
def rain_impact(m) -> DataFrame:
    f = m.fact_deliveries.select(derive.rain_band().alias("rain_band"),
                                 derive.rain_band_rank().alias("_rank"),
                                 "is_first_attempt_fail", "delivery_cost_eur", "route_km")
    return (f.groupBy("rain_band").agg(
        N().alias("shipments"),
        M.rate(FAIL(), 2).alias("fail_rate_pct"),
        M.round_mean(F.col("delivery_cost_eur"), 2).alias("avg_cost_eur"),
        M.round_mean(F.col("route_km"), 2).alias("avg_route_km"),
        F.min("_rank").alias("_rank"))
        .orderBy("_rank").drop("_rank"))


# KE2 [A16 W8] — counterfactual CO2 of zero-emission trips at the diesel factor,
# with a running total per city (default RANGE frame, unique order keys)
def co2_savings(m, diesel_kg_per_km=S.DIESEL_KG_PER_KM) -> DataFrame:
    zero = F.col("is_zero_emission")
    g = day_zone_rollup(m, [
        sum_if(zero, F.col("co2_emission_kg")).alias("actual_co2_zero_kg"),
        count_if(zero).alias("zero_em_shipments"),
        count_if(~zero).alias("fossil_shipments"),
        sum_if(zero, F.col("route_km") * dec(diesel_kg_per_km)).alias("counterfactual_co2_kg")],
        ["year", "month_name", "month_number", "city"],
        dim_date=["year", "month_name", "month_number"], dim_postcode=["city"])
    saved = F.col("counterfactual_co2_kg") - F.col("actual_co2_zero_kg")
    running = Window.partitionBy("city").orderBy("year", "month_number")
    return (g.select(
        "year", "month_name", "city", "zero_em_shipments", "fossil_shipments",
        F.round("actual_co2_zero_kg", 4).alias("actual_co2_zero_kg"),
        F.round("counterfactual_co2_kg", 4).alias("counterfactual_co2_kg"),
        F.round(saved, 4).alias("co2_saved_kg"),
        F.round(F.sum(saved).over(running), 3).alias("cumulative_co2_saved_kg"),
        "month_number")
        .orderBy("city", "year", "month_number").drop("month_number"))


# KE3 [A3 O3] — second-attempt extra cost (x2) per zone, annualised /3.0*12,
# top k by that cost with the zone as tie-break
def worst_postcodes(m, k: int = 10, cuts=S.LOCKER_CUTS_KPI, labels=S.LOCKER_LABELS_KPI) -> DataFrame:
    g = per_zone(m, [
        N().alias("total_shipments"),
        count_if(FAIL()).alias("total_fails"),
        sum_if(F.col("is_multi_attempt"), F.col("delivery_cost_eur") * 2).alias("extra"),
        M.rate(FAIL(), 2).alias("actual_fail_rate_pct"),
        M.round_mean(F.col("delivery_cost_eur"), 2).alias("avg_cost_eur")],
        attrs=["city", "district", "parcel_locker_nearby", "historical_fail_rate_pct"])
    no_locker = F.col("parcel_locker_nearby") == F.lit(False)
    rec = (F.when(no_locker & (F.col("actual_fail_rate_pct") > cuts[0]), F.lit(labels[0]))
           .when(no_locker & (F.col("actual_fail_rate_pct") > cuts[1]), F.lit(labels[1]))
           .otherwise(F.lit(labels[2])))
    return (g.select(
        "postcode_pc4", "city", "district", "parcel_locker_nearby", "total_shipments",
        "total_fails", "actual_fail_rate_pct",
        F.round("extra", 2).alias("wasted_cost_eur"),
        F.round(F.col("extra") / dec("3.0") * 12, 2).alias("est_annual_waste_eur"),
        rec.alias("locker_recommendation"))
        .orderBy(F.desc("wasted_cost_eur"), "postcode_pc4").limit(k))


# KE4 [P17 W1] — share of weekly volume: total of the seven aggregated rows
def weekday_pattern(m) -> DataFrame:
    p = day_zone_rollup(m, [
        N().alias("total_shipments"), count_if(FAIL()).alias("_fails"),
        F.sum("delivery_cost_eur").alias("_cost"), F.count("delivery_cost_eur").alias("_n_cost"),
        F.sum("route_km").alias("_km"), F.count("route_km").alias("_n_km")],
        ["day_of_week_number"], dim_date=["day_of_week_number"])
    g = p.select(
        "day_of_week_number", "total_shipments",
        F.round(M.ratio(F.col("_cost"), F.col("_n_cost")), 2).alias("avg_cost_eur"),
        M.pct(F.col("_fails"), F.col("total_shipments"), 2).alias("fail_rate_pct"),
        F.round(M.ratio(F.col("_km"), F.col("_n_km")), 2).alias("avg_route_km"))
    return (g.select(derive.day_name().alias("day_of_week"), "day_of_week_number",
                     "total_shipments", "avg_cost_eur", "fail_rate_pct", "avg_route_km",
                     M.share_of(F.col("total_shipments"), total(g, F.col("total_shipments")), 1)
                     .alias("pct_of_weekly_volume"))
            .orderBy("day_of_week_number"))


def last_dispatch_date(m) -> F.Column:
    """The latest dispatch date of the fact (the default
    ``as_of``; the published query uses today's date, which finds nothing in
    historical data).  The load notes it when it writes the fact."""
    return newest(m, "fact_deliveries", "dispatch_date", F.to_date("dispatch_datetime"))


# KE5 [P13 W6 W7 F8] — trailing window of ``days`` before ``as_of``; the moving average is
# over the last 7 *rows* (days with shipments), unweighted, as published
def rolling_fail_rate(m, days: int = S.TRAILING_DAYS, as_of=None,
                      rows: int = S.ROLLING_ROWS, alert: float = S.ROLLING_ALERT_PCT) -> DataFrame:
    as_of_col = last_dispatch_date(m) if as_of is None else F.lit(as_of).cast("date")
    start = F.date_sub(as_of_col, days)
    # the month filter is implied by the date filter; on the fact's
    # partition column it prunes every month before the window
    in_months = F.col("year_month") >= F.date_format(start, "yyyy-MM")
    f = (star(m, ["is_first_attempt_fail"], where=in_months, dim_date=["full_date"],
              dim_postcode=["city"])
         .filter(F.col("full_date") >= start))
    g = f.groupBy("full_date", "city").agg(
        N().alias("shipments"),
        count_if(FAIL()).alias("fails"),
        M.rate(FAIL(), 2).alias("daily_fail_rate"))
    w = Window.partitionBy("city").orderBy("full_date").rowsBetween(-(rows - 1), 0)
    moving = F.sum("daily_fail_rate").over(w) / F.count("daily_fail_rate").over(w).cast(M.COUNT_T)
    return (g.withColumn("_avg", moving)
            .select("full_date", "city", "shipments", "fails", "daily_fail_rate",
                    F.round("_avg", 2).alias("rolling_7d_fail_rate"),
                    F.coalesce(F.col("_avg") > alert, F.lit(False)).alias("rolling_alert"))
            .orderBy("city", F.desc("full_date")))


# KE6 [A12 A6 O2 P20] — two-level aggregation: per zone, then per risk tier and city;
# the return rate here is by order value (KA1's is by count)
def revenue_at_risk(m, years=S.DATA_YEARS) -> DataFrame:
    ret = F.col("is_returned")
    zone = per_zone(m, [
        F.sum("order_value_eur").alias("total_order_value"),
        sum_if(ret, F.col("order_value_eur")).alias("returned_value"),
        N().alias("shipments"),
        count_if(ret).alias("returns")], attrs=["city", "fail_risk_tier"])
    tier_rank = M.rank_of(F.col("fail_risk_tier"), ["High", "Medium"])
    return (zone.groupBy("fail_risk_tier", "city").agg(
        F.count_distinct("postcode_pc4").alias("zone_count"),
        F.sum("shipments").alias("total_shipments"),
        F.round(F.sum("total_order_value"), 2).alias("total_gmv_eur"),
        F.round(F.sum("returned_value"), 2).alias("gmv_at_risk_eur"),
        F.round(F.sum("returned_value") / M.nz(F.sum("total_order_value")) * 100, 2)
        .alias("return_rate_pct"),
        F.round(F.sum("returned_value") / dec(f"{years}.0"), 2).alias("est_annual_gmv_at_risk_eur"))
        .orderBy(tier_rank, "city"))
