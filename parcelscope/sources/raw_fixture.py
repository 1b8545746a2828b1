"""The raw sheets of the mapped data: the model's rows as their authors would
have typed them.

Texts under the sheets' raw names, with labels in several spellings, flags as
yes/no, TRUE/FALSE, 1/0 or blank, and some values that no contract can read.
Every choice follows from a number in the row (FIXTURES.md, part D), so
another engine can say what has to come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope import schemas as S
from parcelscope.sources.sheets import DELIVERIES, DRIVERS, FORECAST, INVENTORY, Sheet


def _typed(label: Column, n: Column) -> Column:
    """A label in one of three spellings."""
    return (F.when(n % 3 == 0, F.upper(label)).when(n % 3 == 1, F.regexp_replace(F.lower(label), "[ -]", "_"))
            .otherwise(F.concat(F.lit("  "), label)))


def _flag(c: Column, n: Column) -> Column:
    return (F.when(n % 3 == 0, F.when(c, "Yes").otherwise("no")).when(n % 3 == 1, F.when(c, "TRUE").otherwise("FALSE"))
            .otherwise(F.when(c, "1").otherwise("0")))


def _back(df: DataFrame, renames: dict) -> DataFrame:
    """The load's renames undone: the sheets have the raw names."""
    return df.withColumnsRenamed({new: old for old, new in renames.items()})


def drivers(m) -> DataFrame:
    k = F.regexp_extract("driver_id", r"\d+", 0).cast("bigint")
    van = F.when(k % 50 == 49, "Hovercraft").when((F.col("vehicle_type") == "Electric Van") & (k % 8 == 1), "e-van")
    return _back(m.flat_drivers, S.RENAME_DRIVERS).withColumns({
        "vehicle_type": F.coalesce(van, _typed(F.col("vehicle_type"), k)),
        "contract_type": F.when(k % 2 == 0, F.regexp_replace("contract_type", "time", "-Time")).otherwise(F.col("contract_type")),
        "avg_rating": F.when(k % 40 == 39, "n/a").otherwise(F.col("avg_rating").cast("string")),
        "active": F.when(k % 7 == 0, "").otherwise(_flag(F.col("active"), k))})


def deliveries(m) -> DataFrame:
    n = F.col("postcode_pc4").cast("int")
    last = F.col("temp_celsius") == 21      # seventh lines
    return _back(m.flat_rows, S.RENAME_DELIVERIES).withColumns({
        "vehicle_type": _typed(F.col("vehicle_type"), n),
        "attempt_1_status": F.when(last & (n % 10 == 3), "unknown").otherwise(_typed(F.col("attempt_1_status"), n + 1)),
        "attempt_2_status": F.when((n % 2 == 0) & (F.col("attempt_2_status") == "N/A"), "n.a.")
        .otherwise(F.col("attempt_2_status")),
        "final_status": _typed(F.col("final_status"), n + 2),
        "weight_kg": F.when(last & (n % 10 == 7), " ").otherwise(F.col("weight_kg").cast("string")),
        "is_peak_period": F.when(F.col("is_peak_period"), _flag(F.col("is_peak_period"), n)).otherwise("")})


def inventory(m) -> DataFrame:
    n = F.dayofmonth("snapshot_date") + F.col("stockout_days_ytd")
    status = F.col("status")
    return _back(m.flat_inventory, S.RENAME_INVENTORY).withColumns({
        "status": F.when((status == "Critical") & (n % 2 == 0), "crit").otherwise(_typed(status, n)),
        "stockout_days_ytd": F.when(F.col("stockout_days_ytd") == 0, "").otherwise(F.col("stockout_days_ytd").cast("string")),
        "current_stock_units": F.when((F.col("stockout_days_ytd") == 3) & (F.month("snapshot_date") == 2), "many")
        .otherwise(F.col("current_stock_units").cast("string"))})


def forecast(m) -> DataFrame:
    n = F.dayofmonth("date")        # the raw names from here on
    return _back(m.flat_forecast, S.RENAME_FORECAST).withColumns({
        "is_public_holiday": F.when(F.col("is_public_holiday"), "y").otherwise(""),
        "is_peak_period": _flag(F.col("is_peak_period"), n), "peak_event": F.coalesce("peak_event", F.lit("")),
        "data_type": _typed(F.col("data_type"), n),
        "forecast_volume": F.when(n == 31, "").otherwise(F.col("forecast_volume").cast("string"))})


RAW = {DRIVERS.name: drivers, DELIVERIES.name: deliveries, INVENTORY.name: inventory, FORECAST.name: forecast}


def write_raw(m, sheet: Sheet, path: str) -> None:
    """The sheet as packed CSV files under its raw names."""
    texts = RAW[sheet.name](m).select(*[F.col(f.raw).cast("string") for f in sheet.fields])
    texts.write.csv(path, header=True, compression="gzip", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
