"""S13 — the calendar dimension.

The calendar covers the whole years in which the data's dates fall
(``calendar_spanning``), or a range the caller names (``build_dim_date``).
Holidays and peak events are rules by month and day (literal maps looked up
per row), or the caller's own tables of dates and periods (``mark_days``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture calendar: fixed-date public holidays
# (month, day, name) and the months that count as peak season.
DEFAULT_HOLIDAYS = [
    (1, 1, "New Year's Day"),
    (4, 27, "King's Day"),
    (12, 25, "Christmas Day"),
    (12, 26, "Second Christmas Day"),
]
DEFAULT_PEAK_MONTHS = {11: "Q4 peak", 12: "Q4 peak"}


def holiday_of(d, holidays=DEFAULT_HOLIDAYS):
    """Holiday name of date column ``d`` (NULL on ordinary days)."""
    if not holidays:
        return F.lit(None).cast("string")
    m = F.create_map(*[x for (mo, day, name) in holidays
                       for x in (F.lit(mo * 100 + day), F.lit(name))])
    return F.element_at(m, F.month(d) * 100 + F.dayofmonth(d))


def peak_of(d, peak_months=DEFAULT_PEAK_MONTHS):
    """Peak-event name of date column ``d`` (NULL outside peak months)."""
    if not peak_months:
        return F.lit(None).cast("string")
    m = F.create_map(*[x for mo, name in sorted(peak_months.items())
                       for x in (F.lit(mo), F.lit(name))])
    return F.element_at(m, F.month(d))


def calendar_columns(days: DataFrame, holidays=DEFAULT_HOLIDAYS,
                     peak_months=DEFAULT_PEAK_MONTHS) -> DataFrame:
    """The dim_date columns for a DataFrame holding one ``full_date`` per row."""
    d = F.col("full_date")
    holiday = holiday_of(d, holidays)
    peak = peak_of(d, peak_months)
    iso_dow = F.weekday(d) + 1  # weekday(): Monday = 0
    return days.select(
        (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int").alias("date_key"),
        d,
        F.year(d).cast("short").alias("year"),
        F.quarter(d).cast("short").alias("quarter"),
        F.month(d).cast("short").alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.weekofyear(d).cast("short").alias("week_number"),
        iso_dow.cast("short").alias("day_of_week_number"),
        F.date_format(d, "EEEE").alias("day_of_week_name"),
        F.dayofmonth(d).cast("short").alias("day_of_month"),
        (iso_dow >= 6).alias("is_weekend"),
        holiday.isNotNull().alias("is_public_holiday"),
        holiday.alias("holiday_name"),
        peak.isNotNull().alias("is_peak_period"),
        peak.alias("peak_event_name"),
        F.date_format(d, "yyyy-MM").alias("year_month"),
        F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))
        .alias("year_quarter"),
    )


BIN_DAYS = 64


def period_of(days: DataFrame, periods: DataFrame, name: str, bin_days: int = BIN_DAYS) -> DataFrame:
    """``(full_date, name)`` of the ``days`` that lie in a period
    (``start_date``, ``end_date``, both included, ``name`` and, optional, a
    ``priority``).  An interval join by bins of days: a period is there once
    per bin that it touches, not once per day, a day looks only at the periods
    of its bin.  Where periods overlap the smallest priority wins (none is
    last), then the shorter one, the earlier one, the name.  Periods with a
    null or reversed bound or no name are ignored."""
    epoch = F.lit("1970-01-01").cast("date")

    def bin_of(d):
        return F.floor(F.datediff(d, epoch) / bin_days)

    given = periods if "priority" in periods.columns else periods.withColumn("priority", F.lit(None).cast("int"))
    bins = (given.where("start_date <= end_date").where(F.col(name).isNotNull())
            .select(F.col("start_date").alias("s"), F.col("end_date").alias("e"), F.col(name).alias("name"),
                    F.col("priority").cast("bigint").alias("priority"))
            .withColumn("bin", F.explode(F.sequence(bin_of("s"), bin_of("e")))))
    own = days.select("full_date").where("full_date is not null").distinct().withColumn("bin", bin_of("full_date"))
    order = F.struct(F.col("priority").isNull(), F.col("priority"), F.datediff("e", "s"), F.col("s"), F.col("name"))
    return (own.join(bins, "bin").where(F.col("full_date").between(F.col("s"), F.col("e")))
            .groupBy("full_date").agg(F.min_by("name", order).alias(name)))


def mark_days(dim_date: DataFrame, holidays: DataFrame | None = None,
              peaks: DataFrame | None = None) -> DataFrame:
    """Holidays and peak periods from the caller's tables in place of the
    rules: ``holidays`` with ``full_date``, ``holiday_name`` (movable feasts
    too) and ``peaks`` with ``start_date``, ``end_date``, ``peak_event_name``
    (see ``period_of`` for overlaps).  A holiday named twice takes the name
    that comes first in the alphabet; rows with a null date are ignored."""
    out, columns = dim_date, dim_date.columns
    if holidays is not None:
        named = holidays.groupBy("full_date").agg(F.min("holiday_name").alias("holiday_name"))
        out = (out.drop("holiday_name").join(named, "full_date", "left")
               .withColumn("is_public_holiday", F.col("holiday_name").isNotNull()))
    if peaks is not None:
        out = (out.drop("peak_event_name").join(period_of(dim_date, peaks, "peak_event_name"), "full_date", "left")
               .withColumn("is_peak_period", F.col("peak_event_name").isNotNull()))
    return out.select(*columns)


def build_dim_date(spark: SparkSession, start: str, end: str,
                   holidays=DEFAULT_HOLIDAYS, peak_months=DEFAULT_PEAK_MONTHS) -> DataFrame:
    """Calendar for a named range: rows from ``spark.range`` (split over tasks)."""
    d0 = dt.date.fromisoformat(start)
    n_days = (dt.date.fromisoformat(end) - d0).days + 1
    days = spark.range(n_days).select(F.date_add(F.lit(d0), F.col("id").cast("int")).alias("full_date"))
    return calendar_columns(days, holidays, peak_months)


def calendar_spanning(df: DataFrame, date_col, holidays=DEFAULT_HOLIDAYS,
                      peak_months=DEFAULT_PEAK_MONTHS) -> DataFrame:
    """Calendar covering the whole years in which ``date_col`` of ``df`` falls.

    The span comes from one min/max aggregate of the data; the days are
    generated from that single row (size bounded by the calendar span, a few
    thousand rows per decade), so nothing passes through the driver.
    """
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    span = df.agg(F.min(F.to_date(c)).alias("lo"), F.max(F.to_date(c)).alias("hi"))
    days = span.select(F.explode(F.sequence(F.trunc("lo", "year"),
                                            F.add_months(F.trunc("hi", "year"), 12) - F.expr("INTERVAL 1 DAY")))
                       .alias("full_date"))
    return calendar_columns(days, holidays, peak_months)
