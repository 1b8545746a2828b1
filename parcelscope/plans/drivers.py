"""Driver analytics (dimension only — the fact carries no driver): KC1–KC4.

The driver dimension grows with the fleet, so nothing here is broadcast
except per-city statistics (one row per city) in KC3, and those only after
a bounded count proves them small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope import schemas as S
from parcelscope.functions import metrics as M
from parcelscope.functions.metrics import dec


def _active(m) -> DataFrame:
    return m.dim_driver.filter(F.col("is_active"))


def _round_std(col: str, digits: int = 2) -> F.Column:
    # A5 — sample standard deviation (NULL for one driver), rounded as a decimal
    return F.round(F.stddev_samp(col).cast("decimal(38,12)"), digits)


# KC1 [P12 F11 F12 P19] — efficiency = daily volume vs the 40/day target; composite score
# 0.5·otd + 0.3·(100 − fail) + 0.2·(rating / 5 · 100), rounded once
def driver_scorecard(m, target=S.TARGET_DAILY_VOLUME, weights=S.SCORE_WEIGHTS) -> DataFrame:
    d = _active(m)
    w_otd, w_fail, w_rating = (dec(x) for x in weights)
    score = (F.col("benchmark_otd_pct") * w_otd
             + (F.lit(100) - F.col("benchmark_fail_pct")) * w_fail
             + F.col("avg_rating") / dec("5.0") * 100 * w_rating)
    return (d.select(
        "driver_id", "driver_name", "city", "vehicle_type", "contract_type", "years_experience",
        "performance_band", "is_zero_emission",
        F.col("on_time_rate_pct").alias("benchmark_otd_pct"),
        F.col("fail_rate_pct").alias("benchmark_fail_pct"),
        F.col("avg_deliveries_day").alias("benchmark_daily_vol"),
        "avg_rating")
        .withColumns({
            "efficiency_index": F.round(F.col("benchmark_daily_vol").cast(M.COUNT_T) / dec(target) * 100, 1),
            "composite_score": F.round(score, 1),
        })
        .orderBy(F.desc("composite_score"), "driver_id"))


# KC2 [A4 O2 F5]
def band_distribution(m) -> DataFrame:
    return (_active(m).groupBy("city", "performance_band").agg(
        F.count(F.lit(1)).alias("driver_count"),
        M.round_mean(F.col("on_time_rate_pct"), 1).alias("avg_otd_pct"),
        M.round_mean(F.col("fail_rate_pct"), 1).alias("avg_fail_pct"),
        M.round_mean(F.col("avg_rating"), 2).alias("avg_rating"),
        M.round_mean(F.col("years_experience").cast(M.COUNT_T), 1).alias("avg_experience_yrs"))
        .orderBy("city", M.rank_of(F.col("performance_band"), S.PERFORMANCE_BANDS[:3])))


# KC3 [J5 A5 F13 F2] — z-score against the *rounded* city mean and deviation; a city with
# one driver has no deviation: z NULL, status Normal, sorted first
def driver_outliers(m, labels=S.ALERT_LABELS) -> DataFrame:
    d = _active(m)
    city = d.groupBy("city").agg(
        M.round_mean(F.col("fail_rate_pct"), 2).alias("city_avg_fail"),
        _round_std("fail_rate_pct").alias("city_std_fail"))
    j = d.join(city, "city")
    fail, mu, sd = F.col("fail_rate_pct"), F.col("city_avg_fail"), F.col("city_std_fail")
    status = (F.when(fail > mu + 2 * sd, F.lit(labels[0]))
              .when(fail > mu + 1 * sd, F.lit(labels[1]))
              .otherwise(F.lit(labels[2])))
    return (j.select("driver_id", "driver_name", "city", "vehicle_type", "fail_rate_pct",
                     "city_avg_fail",
                     F.round(fail - mu, 2).alias("above_avg_pp"),
                     F.round(M.zscore(fail, mu, sd), 2).alias("z_score"),
                     status.alias("alert_status"))
            .orderBy(F.desc_nulls_first("z_score"), "driver_id"))


# KC4 [A4 A5]
def vehicle_fail_stats(m) -> DataFrame:
    return (_active(m).groupBy("vehicle_type").agg(
        F.count(F.lit(1)).alias("drivers"),
        M.round_mean(F.col("fail_rate_pct"), 2).alias("avg_fail_rate"),
        F.round(F.min("fail_rate_pct"), 2).alias("min_fail_rate"),
        F.round(F.max("fail_rate_pct"), 2).alias("max_fail_rate"),
        _round_std("fail_rate_pct").alias("stddev_fail_rate"),
        M.round_mean(F.col("on_time_rate_pct"), 2).alias("avg_otd_rate"))
        .orderBy("avg_fail_rate", "vehicle_type"))
