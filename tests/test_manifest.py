"""Committed loads: versions, reuse, increments, corrections, refreshed mart."""

import datetime as dt
import glob
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from parcelscope import schemas as S
from parcelscope.plans import loading, marts
from parcelscope.sources import ingest
from parcelscope.sources import model as M
from parcelscope.sources.load import Load, _log, load_log, recover
from parcelscope.sources.manifest import Catalog, fingerprint
from tests import micro


def ships(*days, first=0, **kw):
    return [micro.shipment(first + i, d, 1001 if i % 2 else 3001, **kw) for i, d in enumerate(days)]


def committed(spark, root, rows) -> M.Model:
    """A micro model whose fact, sums and mart are committed."""
    m, catalog = micro.model(spark, rows), Catalog(spark, root)
    with Load(catalog, "FULL", ["fact_deliveries", *marts.MART_TABLES]) as load:
        M.write_table(load, m, "fact_deliveries")
        marts.store_state(load, reopened(m, catalog, load.by_table()))
    return reopened(m, catalog, catalog.newest())


def reopened(m, catalog, commits) -> M.Model:
    tables = {**m.tables, "fact_deliveries": catalog.read(commits["fact_deliveries"], S.FACT_DELIVERIES)}
    day = commits["fact_deliveries"].marks.get("dispatch_date")
    return M.Model(m.spark, tables, marks={("fact_deliveries", "dispatch_date"): dt.date.fromisoformat(day)},
                   catalog=catalog, commits=commits)


def rows_of(df, *drop):
    return sorted((tuple(r) for r in df.drop("refreshed_at", *drop).collect()), key=str)


def files(root, table):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{root}/{table}/load_id=*/**/*.parquet", recursive=True)}


def jobs(spark, name, call):
    spark.sparkContext.setJobGroup(name, name)
    out = call()
    ran = list(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("", "")
    return out, ran


@pytest.fixture(scope="module")
def loaded(spark, smoke_dir):
    return M.loaded_model_for(spark, smoke_dir)


def test_counts_and_marks_are_the_tables_own(loaded):
    counted = {r.table_name: r.row_count for r in ingest.verify_counts(loading.flat_tables(loaded)).collect()}
    assert {r.table_name: r.row_count for r in loading.verify_counts(loaded).collect()} == counted
    checked = loading.verify_counts(loaded, {**counted, "dim_drivers": -1}).collect()
    assert {r.table_name for r in checked if r.status == "MISMATCH"} == {"dim_drivers"}
    assert loaded.marks[("fact_deliveries", "dispatch_date")] == loaded.fact_deliveries.agg(
        F.max(F.to_date("dispatch_datetime"))).first()[0]
    assert loaded.marks[("mart_inventory_snapshot", "snapshot_date")] == loaded.mart_inventory_snapshot.agg(
        F.max("snapshot_date")).first()[0]
    months = {p.value: p.row_count for p in loaded.commits["fact_deliveries"].parts}
    assert months == {r.year_month: r["count"] for r in loaded.fact_deliveries.groupBy("year_month").count().collect()}


def test_a_second_session_derives_nothing(spark, smoke_dir, loaded):
    before = files(loaded.catalog.root, "*")
    kept = dict(M._LOADED)
    M._LOADED.clear()
    try:
        again = M.loaded_model_for(spark, smoke_dir)
    finally:
        M._LOADED.update(kept)
    assert {t: c.load_id for t, c in again.commits.items()} == {t: c.load_id for t, c in loaded.commits.items()}
    assert files(loaded.catalog.root, "*") == before and again.marks == loaded.marks
    _, ran = jobs(spark, "lookups", lambda: (again.marks, loading.verify_counts(again)))
    assert ran == []


def test_changed_sources_are_loaded_again(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "a.parquet"))
    first = fingerprint(spark, {"a": str(tmp_path / "a.parquet")})
    assert first == fingerprint(spark, {"a": str(tmp_path / "a.parquet")})
    spark.range(3).write.mode("append").parquet(str(tmp_path / "a.parquet"))
    assert first != fingerprint(spark, {"a": str(tmp_path / "a.parquet")})


def test_a_load_that_fails_commits_nothing_and_changes_nothing(spark, tmp_path):
    m = committed(spark, str(tmp_path), ships("2024-01-10", "2024-02-10"))
    want = rows_of(m.fact_deliveries)
    with pytest.raises(ValueError), Load(m.catalog, "FULL", ["fact_deliveries"]) as load:
        M.write_table(load, micro.model(spark, ships("2025-01-01")), "fact_deliveries")
        raise ValueError("killed half way")
    newest = m.catalog.newest()
    assert newest["fact_deliveries"].load_id == m.commits["fact_deliveries"].load_id
    assert rows_of(m.catalog.read(newest["fact_deliveries"], S.FACT_DELIVERIES)) == want


def test_a_killed_run_is_closed_by_a_later_one(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    old = dt.datetime.now(dt.timezone.utc) - dt.timedelta(days=3)
    _log(catalog, [("fact_deliveries", "FULL", 0, 0, 0, old, old, "RUNNING", None, "killed")])
    now = dt.datetime.now(dt.timezone.utc)
    _log(catalog, [("dim_date", "FULL", 0, 0, 0, now, now, "RUNNING", None, "still-on")])
    assert recover(catalog) == 1 and recover(catalog) == 0
    last = {(r.load_id, r.status) for r in load_log(catalog).collect()}
    assert ("killed", "FAILED") in last and ("still-on", "FAILED") not in last


def test_new_days_are_added_by_the_mark(spark, tmp_path):
    m = committed(spark, str(tmp_path), ships("2024-01-10", "2024-01-20", "2024-02-10"))
    old = files(tmp_path, "fact_deliveries")
    everything = micro.model(spark, ships("2024-01-10", "2024-01-20", "2024-02-10")
                             + ships("2024-02-11", "2024-03-01", first=50))
    grown = M.load_new_days(everything, m)
    assert rows_of(grown.fact_deliveries) == rows_of(everything.fact_deliveries)
    commit = grown.commits["fact_deliveries"]
    assert commit.load_type == "INCREMENTAL" and commit.parent_id == m.commits["fact_deliveries"].load_id
    assert [p.value for p in commit.parts] == ["2024-01", "2024-02", "2024-02", "2024-03"]
    assert commit.marks["dispatch_date"] == "2024-03-01" and commit.row_count == 5
    assert {p: t for p, t in files(tmp_path, "fact_deliveries").items() if p in old} == old
    log = {(r.table_name, r.load_type, r.rows_inserted) for r in load_log(m.catalog).filter("status = 'SUCCESS'").collect()}
    assert ("fact_deliveries", "INCREMENTAL", 2) in log
    # nothing new: an empty increment
    again = M.load_new_days(everything, grown)
    assert again.fact_deliveries.count() == 5
    assert marts.refresh_stored(again) == ["2024-02", "2024-03"]
    fresh = marts.build_monthly_kpi(everything)
    assert rows_of(m.catalog.read(m.catalog.newest()["kpi_state"], S.KPI_STATE)) == rows_of(
        marts._as_state(marts._partials(everything)))
    listed = [*S.MART_KEYS, *S.MART_UPDATE_COLUMNS]
    assert rows_of(marts.stored_mart(again).select(listed)) == rows_of(fresh.select(listed))


def test_late_and_corrected_shipments(spark, tmp_path):
    first = ships("2024-01-10", "2024-01-20", "2024-02-10", "2024-03-05")
    m = committed(spark, str(tmp_path), first)
    old = {t: files(tmp_path, t) for t in ("fact_deliveries", "kpi_state", "mart_monthly_kpi")}
    right = dict(first[0], delivery_cost_eur=Decimal("9.00"), category="Fashion")
    late = micro.shipment(90, "2024-02-01", 1001, cost="7.00", failed=True, reason="Not home")
    batch = micro.model(spark, [right, late]).fact_deliveries
    withdrawn = spark.createDataFrame([("S0", "2024-01"), ("S9999", "2024-01")], "shipment_id string, year_month string")
    now = M.correct_shipments(m, batch, withdrawn)
    truth = micro.model(spark, [right, *first[1:], late])
    assert rows_of(now.fact_deliveries) == rows_of(truth.fact_deliveries)
    added, gone = M.changed_rows(now, m.commits["fact_deliveries"].load_id)
    assert {r.shipment_id for r in added.collect()} == {"S0", "S90"} and [r.shipment_id for r in gone.collect()] == ["S0"]
    assert marts.refresh_stored(now) == ["2024-01", "2024-02"]
    newest = m.catalog.newest()
    assert rows_of(m.catalog.read(newest["kpi_state"], S.KPI_STATE)) == rows_of(marts._as_state(marts._partials(truth)))
    listed = [*S.MART_KEYS, *S.MART_UPDATE_COLUMNS]
    assert rows_of(marts.stored_mart(now).select(listed)) == rows_of(marts.build_monthly_kpi(truth).select(listed))
    # old files are as they were, and no untouched month was written
    for table, before in old.items():
        after = files(tmp_path, table)
        assert {p: t for p, t in after.items() if p in before} == before
        new = spark.read.option("basePath", f"{tmp_path}/{table}").parquet(*(set(after) - set(before)))
        assert {r[0] for r in new.select(F.col("year_month").cast("string")).distinct().collect()} == {"2024-01", "2024-02"}
    assert marts.refresh_stored(now) == []
    # a month that loses its last shipment is gone from the fact and the sums
    last = spark.createDataFrame([("S3", "2024-03")], "shipment_id string, year_month string")
    end = M.correct_shipments(now, batch.limit(0), last)
    assert "S3" not in {r.shipment_id for r in end.fact_deliveries.collect()} and end.fact_deliveries.count() == 4
    assert marts.refresh_stored(end) == ["2024-03"]
    state = m.catalog.read(m.catalog.newest()["kpi_state"], S.KPI_STATE)
    assert {r.year_month for r in state.collect()} == {"2024-01", "2024-02"}


def test_a_full_load_in_between_rebuilds_the_sums(spark, tmp_path):
    m = committed(spark, str(tmp_path), ships("2024-01-10", "2024-02-10"))
    other = micro.model(spark, ships("2024-05-01", "2024-06-01", first=70))
    with Load(m.catalog, "FULL", ["fact_deliveries"]) as load:
        M.write_table(load, other, "fact_deliveries")
    now = reopened(other, m.catalog, m.catalog.newest())
    assert marts.refresh_stored(now) is None
    assert {r.year_month for r in marts.stored_mart(now).collect()} == {"2024-05", "2024-06"}


def test_the_refresh_reads_the_batch_only(spark, tmp_path):
    m = committed(spark, str(tmp_path), ships("2024-01-10", "2024-02-10"))
    now = M.correct_shipments(m, micro.model(spark, ships("2024-01-15", first=30)).fact_deliveries)
    added, gone = M.changed_rows(now, m.commits["fact_deliveries"].load_id)
    read = added.inputFiles() + gone.inputFiles()
    assert read and all("/fact_changes/" in f for f in read)


def test_a_derived_load_sorts_smaller_partitions(spark):
    from parcelscope.sources.load import ADVISORY, DEALT_SIZE, smaller_partitions
    with pytest.raises(ValueError), smaller_partitions(spark):
        assert spark.conf.get(ADVISORY) == DEALT_SIZE
        raise ValueError
    assert spark.conf.get(ADVISORY, None) is None
    spark.conf.set(ADVISORY, "5m")
    try:
        with smaller_partitions(spark):
            assert spark.conf.get(ADVISORY) == "5m"
        assert spark.conf.get(ADVISORY) == "5m"
    finally:
        spark.conf.unset(ADVISORY)
