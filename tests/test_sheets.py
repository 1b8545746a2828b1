"""Raw sheets: contracts, spellings, defaults, refused rows, files."""

import datetime as dt
import glob
import time
from decimal import Decimal

import pytest

from parcelscope.sources import raw_fixture, sheets
from parcelscope.sources.load import BOTH_WRITERS, Load, load_log
from parcelscope.sources.manifest import Catalog

GOOD = {"driver_id": "D1", "name": "Ann", "city": "Utrecht", "years_experience": "4", "vehicle_type": "CARGO  bike",
        "contract_type": "part-time", "avg_rating": "4.25", "on_time_rate_pct": "91.5", "active": "no",
        "join_date": "2020-02-29"}


def drivers(spark, *changes, drop=()):
    names = [c for c in GOOD if c not in drop]
    return spark.createDataFrame([tuple((GOOD | c)[n] for n in names) for c in changes],
                                 ", ".join(f"{n} string" for n in names))


def conformed(spark, *changes, **kw):
    return sheets.conform(drivers(spark, *changes, **kw), sheets.DRIVERS).collect()


def test_names_types_and_spellings(spark):
    (r,) = conformed(spark, {})
    assert r.asDict() == {"driver_id": "D1", "driver_name": "Ann", "city": "Utrecht", "years_experience": 4,
                          "vehicle_type": "Cargo Bike", "contract_type": "Parttime", "avg_rating": Decimal("4.25"),
                          "on_time_rate_pct": Decimal("91.50"), "is_active": False, "join_date": dt.date(2020, 2, 29),
                          "problems": []}
    got = conformed(spark, *[{"vehicle_type": v} for v in ("electric_van", "ELECTRIC-VAN", " e-van ", "Van, electric")])
    assert [r.vehicle_type for r in got] == ["Electric Van"] * 3 + [None] and got[3].problems == ["domain:vehicle_type"]


@pytest.mark.parametrize("text,value,problems", [
    ("Yes", True, []), ("TRUE", True, []), ("1", True, []), ("n", False, []), ("0", False, []),
    ("", True, []), ("   ", True, []), (None, True, []), ("perhaps", None, ["type:is_active"])])
def test_flags_and_their_default(spark, text, value, problems):
    (r,) = conformed(spark, {"active": text})
    assert (r.is_active, r.problems) == (value, problems)


def test_every_problem_of_a_row_is_named(spark):
    (r,) = conformed(spark, {"name": " ", "years_experience": "four", "vehicle_type": None, "contract_type": "Zzp",
                             "avg_rating": "", "join_date": "2021-02-30"})
    assert r.problems == ["not_null:driver_name", "type:years_experience", "not_null:vehicle_type",
                          "domain:contract_type", "type:join_date"]
    assert r.avg_rating is None
    (long,) = conformed(spark, {"name": "x" * 200_000})
    assert len(long.driver_name) == 200_000 and long.problems == []


def test_absent_and_other_columns(spark):
    (r,) = conformed(spark, {}, drop=("active", "avg_rating", "contract_type"))
    assert r.is_active is True and r.avg_rating is None and r.problems == ["not_null:contract_type"]
    raw = drivers(spark, {}).selectExpr("*", "'x' AS driver_name", "'y' AS problems", "1 AS `a.b`")
    assert sheets.conform(raw, sheets.DRIVERS).first().driver_name == "Ann"


def test_load_from_files(spark, tmp_path):
    rows = [{}, {}, {"driver_id": "D2", "vehicle_type": "Boat"}, {"driver_id": "D3", "city": "", "avg_rating": "good"}]
    (drivers(spark, *rows).selectExpr("join_date", "'note' AS remark", "*").drop("join_date").selectExpr("*", "'2020-01-01' AS join_date")
     .write.csv(f"{tmp_path}/raw", header=True))
    catalog = Catalog(spark, f"{tmp_path}/tables")
    raw = sheets.read_sheet(spark, f"{tmp_path}/raw", sheets.DRIVERS)
    loaded = sheets.load_sheets(catalog, {"dim_drivers": raw}, sheets.SHEETS)
    assert list(loaded) == ["dim_drivers"] and loaded["dim_drivers"].schema == sheets.DRIVERS.schema
    assert sorted(r.driver_id for r in loaded["dim_drivers"].collect()) == ["D1", "D1"]       # repeated rows stay
    left = {r.driver_id: r.reject_reasons for r in sheets.rejects(catalog, sheets.DRIVERS).collect()}
    assert {k: set(v) for k, v in left.items()} == {"D2": {"domain:vehicle_type"}, "D3": {"not_null:city", "type:avg_rating"}}
    (log,) = load_log(catalog).filter("status = 'SUCCESS'").collect()
    assert (log.rows_inserted, log.rows_rejected) == (2, 2)


def test_empty_sheet(spark, tmp_path):
    drivers(spark, {}).limit(0).write.csv(f"{tmp_path}/raw", header=True)
    raw = sheets.read_sheet(spark, f"{tmp_path}/raw", sheets.DRIVERS)
    catalog = Catalog(spark, f"{tmp_path}/tables")
    assert sheets.load_sheets(catalog, {"dim_drivers": raw}, [sheets.DRIVERS])["dim_drivers"].count() == 0


def test_raw_sheets_are_packed(spark, smoke_model, tmp_path):
    raw_fixture.write_raw(smoke_model, sheets.DRIVERS, f"{tmp_path}/raw")
    files = glob.glob(f"{tmp_path}/raw/part-*")
    assert files and all(f.endswith(".csv.gz") for f in files)
    texts = sheets.read_sheet(spark, f"{tmp_path}/raw", sheets.DRIVERS)
    assert texts.columns == [f.raw for f in sheets.DRIVERS.fields]
    assert texts.count() == smoke_model.dim_driver.count()


def test_rows_are_written_by_the_tasks_that_read_them(spark, tmp_path):
    own = GOOD | {"driver_id": None, "city": None}
    raw = spark.range(0, 30, 1, 3).selectExpr("concat('D', id) AS driver_id", "if(id % 10 = 0, '', 'Utrecht') AS city",
                                              *[f"'{v}' AS {c}" for c, v in own.items() if v])
    catalog = Catalog(spark, f"{tmp_path}/tables")
    loaded = sheets.load_sheets(catalog, {"dim_drivers": raw}, [sheets.DRIVERS])["dim_drivers"]
    assert loaded.count() == 27 and sheets.rejects(catalog, sheets.DRIVERS).count() == 3
    assert int(*BOTH_WRITERS.values()) > 2      # once as many are open, Spark sorts the rest of a task's rows
    for kind in ("true", "false"):      # one file for each of the three tasks: nothing was moved
        assert len(glob.glob(f"{tmp_path}/tables/dim_drivers/*/rejected={kind}/*.parquet")) == 3


def test_a_load_leaves_no_shuffled_files(spark, tmp_path):
    def shuffled():
        env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
        files = env.blockManager().diskBlockManager().getAllFiles().mkString(",").split(",")
        return {f for f in files if "/shuffle_" in f}

    catalog = Catalog(spark, f"{tmp_path}/tables")
    rows = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    with Load(catalog, "FULL", ["t"]) as load:
        before = shuffled()
        load.write("t", rows, rows.schema)
        until = time.time() + 10
        while shuffled() - before and time.time() < until:
            time.sleep(0.2)
        assert not shuffled() - before
    assert catalog.read(catalog.newest()["t"], rows.schema).count() == 7
