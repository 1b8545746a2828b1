"""Executive overview KPIs (star model): KA1–KA3.

Plan shape: fact ⋈ broadcast(dim_date) ⋈ broadcast(dim_postcode) → partial
aggregate per (month, city) map-side → one small shuffle → final aggregate.
The month-over-month LAG runs on the aggregated city-month rows, never on
raw shipments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelscope import schemas as S
from parcelscope.functions import metrics as M
from parcelscope.functions.metrics import count_if
from parcelscope.operators.joins import day_zone_rollup
from parcelscope.operators.ranks import positions


def N():
    return F.count(F.lit(1))


def DELIVERED():
    return F.col("final_status").isin(S.DELIVERED_STATUSES)


# KA1 [J1 J2 A2 A7 W3 W4 F2 F3 O1] — as published this returns every month of every city (the
# recency rank is not used there); ``latest_only=True`` keeps the newest
# month per city, which is what the dashboard card shows.
def headline_kpis(m, latest_only: bool = False) -> DataFrame:
    p = day_zone_rollup(m, [
        N().alias("total_shipments"),
        count_if(DELIVERED()).alias("delivered"),
        count_if(F.col("is_first_attempt_fail")).alias("first_attempt_fails"),
        count_if(F.col("is_returned")).alias("returned"),
        F.sum("delivery_cost_eur").alias("_cost"), F.count("delivery_cost_eur").alias("_n_cost"),
        F.sum("co2_emission_kg").alias("_co2"), F.count("co2_emission_kg").alias("_n_co2"),
        F.sum("order_value_eur").alias("_value"),
        F.sum("route_km").alias("_km"), F.count("route_km").alias("_n_km"),
        count_if(F.col("is_zero_emission")).alias("zero_emission_count")],
        ["year_month", "city"], dim_date=["year_month"], dim_postcode=["city"])
    base = p.select(
        "year_month", "city", "total_shipments",
        "delivered", "first_attempt_fails", "returned",
        F.round(M.ratio(F.col("_cost"), F.col("_n_cost")), 2).alias("avg_cost_eur"),
        F.round(M.ratio(F.col("_co2"), F.col("_n_co2")), 6).alias("avg_co2_kg"),
        F.round(F.col("_value"), 2).alias("total_revenue_eur"),
        F.round(M.ratio(F.col("_km"), F.col("_n_km")), 2).alias("avg_route_km"),
        "zero_emission_count")
    rates = base.withColumns({
        "otd_rate_pct": M.pct(F.col("delivered"), F.col("total_shipments"), 2),
        "fail_rate_pct": M.pct(F.col("first_attempt_fails"), F.col("total_shipments"), 2),
        "return_rate_pct": M.pct(F.col("returned"), F.col("total_shipments"), 2),
        "zero_emission_pct": M.pct(F.col("zero_emission_count"), F.col("total_shipments"), 1),
    })
    by_month = Window.partitionBy("city").orderBy("year_month")
    ranked = rates.withColumns({
        "prev_otd_rate": F.lag("otd_rate_pct").over(by_month),
        "prev_fail_rate": F.lag("fail_rate_pct").over(by_month),
        "prev_avg_cost": F.lag("avg_cost_eur").over(by_month),
    })
    if latest_only:
        newest_first = Window.partitionBy("city").orderBy(F.desc("year_month"))
        ranked = ranked.withColumn("_recency", F.rank().over(newest_first)).filter("_recency = 1")
    return (ranked.select(
        "city", "year_month", "total_shipments", "delivered", "first_attempt_fails", "returned",
        "otd_rate_pct", "fail_rate_pct", "return_rate_pct", "avg_cost_eur", "avg_co2_kg",
        "total_revenue_eur", "avg_route_km", "zero_emission_pct",
        M.delta_pp(F.col("otd_rate_pct"), F.col("prev_otd_rate"), 2).alias("otd_mom_pp"),
        M.delta_pp(F.col("fail_rate_pct"), F.col("prev_fail_rate"), 2).alias("fail_mom_pp"),
        M.delta_pct(F.col("avg_cost_eur"), F.col("prev_avg_cost"), 2).alias("cost_mom_pct"))
        .orderBy("city", F.desc("year_month")))


# KA2 [J1 J2 A7 O1]
def otd_trend(m) -> DataFrame:
    p = day_zone_rollup(m, [
        N().alias("shipments"), count_if(DELIVERED()).alias("_ok"),
        F.sum("delivery_cost_eur").alias("_cost"), F.count("delivery_cost_eur").alias("_n_cost"),
        F.sum("co2_emission_kg").alias("_co2"), F.count("co2_emission_kg").alias("_n_co2")],
        ["year_month", "city"], dim_date=["year_month"], dim_postcode=["city"])
    return (p.select(
        "year_month", "city", "shipments",
        M.pct(F.col("_ok"), F.col("shipments"), 2).alias("otd_rate_pct"),
        F.round(M.ratio(F.col("_cost"), F.col("_n_cost")), 2).alias("avg_cost_eur"),
        F.round(M.ratio(F.col("_co2"), F.col("_n_co2")) * 1000, 4).alias("avg_co2_grams"))
        .orderBy("year_month", "city"))


# KA3 [A7 W5] — RANK over the unrounded on-time ratio of all carriers, counted in ranges
def carrier_ranking(m) -> DataFrame:
    g = (m.fact_deliveries.groupBy("carrier").agg(
        N().alias("total_shipments"),
        M.round_mean(F.col("delivery_cost_eur"), 2).alias("avg_cost_eur"),
        M.rate(DELIVERED(), 2).alias("otd_rate_pct"),
        M.rate(F.col("is_first_attempt_fail"), 2).alias("fail_rate_pct"),
        M.round_mean(F.col("co2_emission_kg"), 6).alias("avg_co2_kg"),
        (count_if(DELIVERED()).cast(M.COUNT_T) / N().cast(M.COUNT_T)).alias("_otd")))
    return (positions(g, "otd_rank", [("_otd", "desc")], ties=True)
            .drop("_otd").orderBy("otd_rank", "carrier"))
