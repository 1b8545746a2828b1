"""Business questions 1–5 on the flat model (city stored on the fact).

Every query is one scan of the fact with partial (map-side) aggregation;
shares of a total are made over the *aggregated* rows (cities, reasons or
vehicles), never over raw rows; a total of all rows is a scalar subquery.  Top-k lists end in the
postcode as a tie-break because their sort keys are rounded and tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelscope import schemas as S
from parcelscope.functions import metrics as M
from parcelscope.functions.metrics import count_if, dec, sum_if
from parcelscope.operators.joins import per_zone
from parcelscope.operators.ranks import total


def FAILED():
    return F.col("attempt_1_status") == S.FAILED


def NOT_HOME():
    return FAILED() & (F.col("fail_reason") == S.NOT_HOME)


def ZERO():
    return F.col("vehicle_type").isin(S.ZERO_EMISSION_VEHICLES)


def FOSSIL():
    return F.col("vehicle_type").isin(S.FOSSIL_VEHICLES)


def N():
    return F.count(F.lit(1))


def _wasted(count_col) -> F.Column:
    """fails × AVG(cost) — the average-cost basis of wasted cost."""
    return M.times_mean(count_col, F.col("delivery_cost_eur"))


# Q1a [S12] — all columns, no order
def scan_deliveries(m) -> DataFrame:
    return m.flat_fact


# Q1b [A1 O1]
def city_volume(m) -> DataFrame:
    return (m.flat_cities.groupBy("city").agg(N().alias("total_shipments"))
            .orderBy(F.desc("total_shipments"), "city"))


# Q1c [A1 A2 O1]
def city_fails(m) -> DataFrame:
    return (m.flat_cities.groupBy("city")
            .agg(N().alias("total_shipments"), count_if(FAILED()).alias("total_fails"))
            .orderBy(F.desc("total_shipments"), "city"))


# Q1d [A2 A7 O1]
def city_fail_rate(m) -> DataFrame:
    return (m.flat_cities.groupBy("city")
            .agg(N().alias("total_shipments"), count_if(FAILED()).alias("total_fails"),
                 M.rate(FAILED(), 1).alias("fail_rate_pct"))
            .orderBy(F.desc("fail_rate_pct"), "city"))


# Q1e [A7 A9 A4 O1]
def city_fail_cost(m) -> DataFrame:
    return (m.flat_cities.groupBy("city")
            .agg(N().alias("total_shipments"), count_if(FAILED()).alias("total_fails"),
                 M.rate(FAILED(), 1).alias("fail_rate_pct"),
                 M.round_mean(F.col("delivery_cost_eur"), 2).alias("avg_cost_eur"),
                 F.round(_wasted(count_if(FAILED())), 0).alias("wasted_cost_eur"))
            .orderBy(F.desc("fail_rate_pct"), "city"))


# Q1f [A7 A9 A11 O1]
def city_scorecard(m) -> DataFrame:
    return (m.flat_cities.groupBy("city")
            .agg(N().alias("total_shipments"), count_if(FAILED()).alias("total_fails"),
                 M.rate(FAILED(), 1).alias("fail_rate_pct"),
                 F.round(_wasted(count_if(FAILED())), 0).alias("wasted_cost_eur"),
                 F.round(sum_if(FAILED(), F.col("co2_emission_kg")) * 1000, 1).alias("wasted_co2_grams"),
                 M.rate(ZERO(), 1).alias("zero_emission_pct"))
            .orderBy(F.desc("wasted_cost_eur"), "city"))


# Q2a [P12 A1 O1]
def reason_counts(m) -> DataFrame:
    return (m.flat_rows.filter(FAILED()).groupBy("fail_reason").agg(N().alias("total_fails"))
            .orderBy(F.desc("total_fails"), "fail_reason"))


# Q2b [P12 W1 A10 A11] — share of all failures: reasons are free text, so their total is a
# scalar subquery over the aggregated rows, not a window that holds them all
def reason_cost(m) -> DataFrame:
    g = (m.flat_rows.filter(FAILED()).groupBy("fail_reason")
         .agg(N().alias("total_fails"),
              F.round(F.sum("delivery_cost_eur"), 0).alias("wasted_cost_eur"),
              F.round(F.sum("co2_emission_kg") * 1000, 1).alias("wasted_co2_grams")))
    return (g.select("fail_reason", "total_fails",
                     M.share_of(F.col("total_fails"), total(g, F.col("total_fails")), 1)
                     .alias("pct_of_all_fails"),
                     "wasted_cost_eur", "wasted_co2_grams")
            .orderBy(F.desc("total_fails"), "fail_reason"))


# Q2c [P12 W2 O1]
def reason_by_city(m) -> DataFrame:
    g = m.flat_cities.filter(FAILED()).groupBy("city", "fail_reason").agg(N().alias("total_fails"))
    return (g.withColumn("pct_within_city",
                         M.share_of_total(F.col("total_fails"), Window.partitionBy("city"), 1))
            .orderBy("city", F.desc("total_fails"), "fail_reason"))


# Q3a [A13 A4] — one global row (a group that may be empty: divisors guarded)
def co2_total(m) -> DataFrame:
    co2 = F.col("co2_emission_kg")
    failed_co2 = sum_if(FAILED(), co2)
    return m.flat_rows.agg(
        F.round(F.sum(co2), 2).alias("total_co2_kg"),
        M.round_mean(co2, 2, 1000).alias("avg_co2_grams_per_delivery"),
        F.round(failed_co2, 2).alias("co2_from_failed_kg"),
        F.round(failed_co2 / M.nz(F.sum(co2)) * 100, 1).alias("wasted_co2_pct"))


# Q3b [W1 A7 A4] — share_of_total_co2_pct divides CO2 by the total *shipment count*
# as the published query does; it is not a share of CO2.
def co2_by_vehicle(m) -> DataFrame:
    co2 = F.col("co2_emission_kg")
    g = (m.flat_rows.groupBy("vehicle_type")
         .agg(N().alias("total_shipments"), F.sum(co2).alias("_co2"),
              F.round(F.sum(co2), 3).alias("total_co2_kg"),
              M.round_mean(co2, 2, 1000).alias("avg_co2_grams"),
              M.rate(FAILED(), 1).alias("fail_rate_pct")))
    total_n = total(g, F.col("total_shipments"))
    return (g.select("vehicle_type", "total_shipments",
                     M.share_of(F.col("total_shipments"), total_n, 1).alias("fleet_share_pct"),
                     "total_co2_kg", "avg_co2_grams", "fail_rate_pct",
                     F.round(F.col("_co2") / M.nz(total_n.cast(M.COUNT_T)) * 100, 1).alias("share_of_total_co2_pct"))
            .orderBy(F.desc("total_co2_kg"), "vehicle_type"))


# Q3c [A16 A4 A7]
def electrification_potential(m) -> DataFrame:
    co2 = F.col("co2_emission_kg")
    electric = N().cast(M.COUNT_T) * dec(S.ELECTRIC_KG_PER_SHIPMENT)
    return (m.flat_rows.groupBy("vehicle_type")
            .agg(N().alias("shipments"),
                 F.round(F.sum(co2), 3).alias("actual_co2_kg"),
                 M.round_mean(co2, 2, 1000).alias("avg_co2_grams"),
                 M.rate(ZERO(), 1).alias("zero_em_pct"),
                 F.round(electric, 3).alias("co2_if_all_electric_kg"),
                 F.round(F.sum(co2) - electric, 3).alias("co2_saving_potential_kg"))
            .orderBy(F.desc("actual_co2_kg"), "vehicle_type"))


# Q4a [A7 O3]
def postcode_fail_top(m, k: int = 10) -> DataFrame:
    z = per_zone(m, [N().alias("total_shipments"), count_if(FAILED()).alias("total_fails"),
                     M.rate(FAILED(), 1).alias("fail_rate_pct")], attrs=["city"], flat=True)
    return (z.select("postcode_pc4", "city", "total_shipments", "total_fails", "fail_rate_pct")
            .orderBy(F.desc("fail_rate_pct"), "postcode_pc4").limit(k))


# Q4b [J2 A7 A8 A9 O3]
def postcode_vs_history(m, k: int = 10) -> DataFrame:
    fails = count_if(FAILED())
    z = per_zone(m, [N().alias("total_shipments"), fails.alias("total_fails"),
                     F.round(_wasted(fails), 0).alias("wasted_cost_eur")],
                 attrs=["city", "district", "zone_type", "parcel_locker_nearby",
                        "historical_fail_rate_pct"], flat=True)
    exact_rate = (F.col("total_fails").cast(M.COUNT_T) * 100
                  / M.nz(F.col("total_shipments")).cast(M.COUNT_T))
    return (z.select("postcode_pc4", "city", "district", "zone_type", "parcel_locker_nearby",
                     "historical_fail_rate_pct", "total_shipments", "total_fails",
                     F.round(exact_rate, 1).alias("actual_fail_rate_pct"),
                     F.round(exact_rate - F.col("historical_fail_rate_pct"), 1)
                     .alias("vs_historical_pp"),
                     "wasted_cost_eur")
            .orderBy(F.desc("actual_fail_rate_pct"), "postcode_pc4").limit(k))


# Q4c [A7 A9 O3 F4] — label uses the *rounded* rate, strictly greater than the cut-off
def locker_roi(m, k: int = 15, cut: float = S.LOCKER_CUT_BQ,
               labels=S.LOCKER_LABELS_BQ) -> DataFrame:
    fails = count_if(FAILED())
    g = per_zone(m, [N().alias("total_shipments"), fails.alias("total_fails"),
                     M.rate(FAILED(), 1).alias("fail_rate_pct"),
                     F.round(_wasted(fails), 0).alias("wasted_cost_eur"),
                     F.round(_wasted(fails) * 4, 0).alias("est_annual_waste_eur")],
                 attrs=["city", "district", "parcel_locker_nearby", "zone_type"], flat=True)
    g = g.select("postcode_pc4", "city", "district", "parcel_locker_nearby", "zone_type",
                 "total_shipments", "total_fails", "fail_rate_pct", "wasted_cost_eur",
                 "est_annual_waste_eur")
    no_locker = F.col("parcel_locker_nearby") == "No"
    rec = (F.when(no_locker & (F.col("fail_rate_pct") > cut), F.lit(labels[0]))
           .when(no_locker, F.lit(labels[1])).otherwise(F.lit(labels[2])))
    return (g.withColumn("recommendation", rec)
            .orderBy(F.desc("wasted_cost_eur"), "postcode_pc4").limit(k))


# Q5a [P12 A9 A15]
def locker_impact(m, postcodes=S.LOCKER_ZONES, effect=S.LOCKER_EFFECT,
                  years=S.DATA_YEARS) -> DataFrame:
    fails = count_if(FAILED())
    nh = count_if(NOT_HOME())
    z = per_zone(m, [
        N().alias("total_shipments"), fails.alias("total_fails"),
        M.rate(FAILED(), 1).alias("fail_rate_pct"),
        F.round(_wasted(fails), 0).alias("wasted_cost_3yr_eur"),
        F.round(_wasted(fails) / years, 0).alias("wasted_cost_annual_eur"),
        F.round(sum_if(FAILED(), F.col("co2_emission_kg")) * 1000 / years, 1)
        .alias("wasted_co2_annual_grams"),
        F.round(M.scenario_saving(_wasted(nh), effect, years), 0).alias("annual_saving_eur")],
        where=F.col("postcode_pc4").isin(list(postcodes)), attrs=["city", "district"], flat=True)
    return (z.select("postcode_pc4", "city", "district", "total_shipments", "total_fails",
                     "fail_rate_pct", "wasted_cost_3yr_eur", "wasted_cost_annual_eur",
                     "wasted_co2_annual_grams", "annual_saving_eur")
            .orderBy(F.desc("wasted_cost_3yr_eur"), "postcode_pc4"))


# Q5b [A10 A15 P20] — rounds the 3-year bases first, then derives the annual figures
def dispatch_impact(m, effect=S.DISPATCH_EFFECT, years=S.DATA_YEARS) -> DataFrame:
    base = (m.flat_cities.groupBy("city")
            .agg(N().alias("total_shipments"), count_if(NOT_HOME()).alias("not_home_fails"),
                 M.rate(NOT_HOME(), 2).alias("not_home_rate_pct"),
                 F.round(sum_if(NOT_HOME(), F.col("delivery_cost_eur")), 0).alias("nh_cost"),
                 F.round(sum_if(NOT_HOME(), F.col("co2_emission_kg")) * 1000, 1).alias("nh_co2_g")))
    return (base.select(
        "city", "total_shipments", "not_home_fails", "not_home_rate_pct",
        F.col("nh_cost").alias("wasted_cost_3yr_eur"),
        F.round(F.col("nh_cost") / years, 0).alias("wasted_cost_annual_eur"),
        F.col("nh_co2_g").alias("wasted_co2_3yr_grams"),
        F.round(M.scenario_saving(F.col("nh_cost"), effect, years), 0).alias("annual_saving_eur"),
        F.round(M.scenario_saving(F.col("nh_co2_g"), effect, years), 1).alias("annual_co2_saving_grams"))
        .orderBy(F.desc("annual_saving_eur"), "city"))


# Q5c [U1 A15 A3] — the three scenarios from ONE scan: conditional sums, then 3 rows
def combined_impact(m, postcodes=S.LOCKER_ZONES, place=S.LOCKER_CITY, years=S.DATA_YEARS,
                    scale=S.SCALE_MULTIPLIER) -> DataFrame:
    chosen = NOT_HOME() & F.col("postcode_pc4").isin(list(postcodes))
    cost, co2 = F.col("delivery_cost_eur"), F.col("co2_emission_kg")
    a = m.flat_rows.agg(
        count_if(chosen).alias("n1"), sum_if(chosen, cost).alias("c1"), sum_if(chosen, co2).alias("e1"),
        count_if(NOT_HOME()).alias("n2"), sum_if(NOT_HOME(), cost).alias("c2"), sum_if(NOT_HOME(), co2).alias("e2"),
        count_if(FOSSIL()).alias("n3"), sum_if(FOSSIL(), cost).alias("c3"), sum_if(FOSSIL(), co2).alias("e3"))

    def scenario(name, n, c, e, cost_effect, co2_effect):
        return F.struct(
            F.lit(name).alias("recommendation"),
            F.col(n).alias("impacted_deliveries"),
            F.round(M.scenario_saving(F.col(c), cost_effect, years), 0).alias("annual_cost_saving_eur"),
            F.round(M.scenario_saving(F.col(e) * 1000, co2_effect, years), 1)
            .alias("annual_co2_saving_grams"))

    where = " ".join([place, ", ".join(str(p) for p in postcodes)]).strip()
    names = [n.format(place=where) for n in S.SCENARIO_NAMES]
    rows = a.select(F.inline(F.array(
        scenario(names[0], "n1", "c1", "e1", S.LOCKER_EFFECT, S.LOCKER_EFFECT),
        scenario(names[1], "n2", "c2", "e2", S.DISPATCH_EFFECT, S.DISPATCH_EFFECT),
        scenario(names[2], "n3", "c3", "e3", S.EV_COST_EFFECT, S.EV_CO2_EFFECT))))
    return rows.withColumn("postnl_scale_saving_eur",
                           F.round(F.col("annual_cost_saving_eur") * scale, 0))
