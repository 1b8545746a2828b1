"""What the given data does not show: later dates, large sums, unknown keys,
repeated update keys, rejected rows, order of results."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from parcelscope import schemas as S
from parcelscope.functions import derive
from parcelscope.operators import quality as Q
from parcelscope.operators.upsert import upsert
from parcelscope.plans import advanced, business, marts, overview, views
from parcelscope.sources import calendar, tpch_fixture
from parcelscope.sources.load import Load, load_log
from parcelscope.sources.manifest import Catalog
from parcelscope.sources.model import build_model, materialize, read_sources, write_table
from tests import micro


@pytest.fixture(scope="module")
def later(spark, smoke_dir, tmp_path_factory):
    """The smallest tables, a third of the line items moved by ten years."""
    root = tmp_path_factory.mktemp("later")
    for name, df in read_sources(spark, smoke_dir).items():
        if name == "lineitem":
            moved = F.col("l_shipdate") + F.make_ym_interval(F.lit(10), F.lit(0))
            df = df.withColumn("l_shipdate", F.when(F.col("l_linenumber") % 3 == 0, moved).otherwise(F.col("l_shipdate")))
        df.write.parquet(str(root / f"{name}.parquet"))
    return materialize(build_model(spark, str(root)))


def test_dates_of_any_year_are_in_every_query(later):
    n = later.fact_deliveries.count()
    assert overview.headline_kpis(later).agg(F.sum("total_shipments")).first()[0] == n
    assert views.deliveries_enriched(later).count() == n
    assert marts.build_monthly_kpi(later).agg(F.sum("total_shipments")).first()[0] == n
    last = later.fact_deliveries.agg(F.max(F.to_date("dispatch_datetime")).alias("d")).first().d
    rolling = advanced.rolling_fail_rate(later)
    assert rolling.agg(F.max("full_date")).first()[0] == last and last.year > 2005


def test_sums_that_grow_do_not_overflow(spark):
    stock = spark.createDataFrame([(6_000_000_000, 1000)], "current_stock_units bigint, max_capacity_units int")
    assert stock.select(derive.utilisation_pct()).first()[0] == Decimal("600000000.00")
    line = [(1, 1, 4, 5_000_000_000, 99_999_999.0, dt.datetime(2020, 1, 2))] * 60
    items = spark.createDataFrame(line, "l_partkey int, l_suppkey int, l_linenumber int, l_quantity bigint, "
                                        "l_extendedprice double, l_shipdate timestamp_ntz")
    row = tpch_fixture.build_inventory_snapshot(items, spark.createDataFrame([(1, "t")], "p_partkey int, p_type string")).first()
    assert row.current_stock_units == 60 * 4 * 5_000_000_000 and row.avg_daily_outbound == 300_000_000_000
    ships = [micro.shipment(i, "2024-01-10", 1001) for i in range(3)]
    m = micro.model(spark, ships)
    m.tables["fact_deliveries"] = m.fact_deliveries.withColumns({
        "order_value_eur": F.lit("99999999.99").cast("decimal(10,2)"),
        "co2_emission_kg": F.lit("9999.9999").cast("decimal(8,4)")}).withColumn(
            "n", F.explode(F.sequence(F.lit(1), F.lit(40_000)))).drop("n")
    row = marts.build_monthly_kpi(m).first()
    assert row.total_revenue_eur == 120_000 * Decimal("99999999.99")
    assert row.total_co2_kg == 120_000 * Decimal("9999.9999")


def test_unknown_categories_and_zones_are_counted(spark):
    ships = [micro.shipment(1, "2024-01-10", 1001, category="Books"), micro.shipment(2, "2024-01-11", 1001, category="Lost"),
             micro.shipment(3, "2024-01-12", 1001, category="Lost"), micro.shipment(4, "2024-01-12", 9999, failed=True)]
    m = micro.model(spark, ships)
    (row,) = marts.build_monthly_kpi(m).collect()
    assert (row.total_shipments, row.top_product_category) == (3, "Books")
    assert overview.headline_kpis(m).first().total_shipments == 3
    assert business.city_volume(m).agg(F.sum("total_shipments")).first()[0] == 4
    assert business.reason_counts(m).first().total_fails == 1


def test_null_keys_are_unique(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a")], "k int, v string")
    assert [(r.k, r.v) for r in Q.duplicate_keys(df, ["k", "v"]).collect()] == [(2, "a")]


def test_repeated_update_keys_are_an_error(spark):
    old = spark.createDataFrame([("2024-01", 1, 5)], "ym string, n int, other int")
    new = spark.createDataFrame([("2024-01", 2, 6), ("2024-02", 3, 7)], "ym string, n int, other int")
    got = sorted(tuple(r) for r in upsert(old, new, ["ym"], ["n"]).collect())
    assert got == [("2024-01", 2, 5), ("2024-02", 3, 7)]
    with pytest.raises(Exception, match="occurs more than once"):
        upsert(old, new.union(new), ["ym"], ["n"]).collect()


def test_the_load_leaves_rejected_rows_out_and_logs_them(spark, tmp_path):
    ships = [micro.shipment(i, "2024-01-10", 1001) for i in range(5)]
    ships[0]["weight_kg"] = Decimal("0.00")
    ships[1]["vehicle_type"] = "Balloon"
    catalog = Catalog(spark, str(tmp_path))
    with Load(catalog, "FULL", ["fact_deliveries"]) as load:
        write_table(load, micro.model(spark, ships), "fact_deliveries")
    commit = catalog.newest()["fact_deliveries"]
    assert catalog.read(commit, S.FACT_DELIVERIES).count() == commit.row_count == 3
    bad = {r.shipment_id: list(r.reject_reasons) for r in catalog.rejected("fact_deliveries", S.FACT_DELIVERIES).collect()}
    assert bad == {"S0": ["range:weight_kg"], "S1": ["domain:vehicle_type"]}
    log = load_log(catalog)
    assert sorted((r.status, r.rows_inserted, r.rows_rejected) for r in log.collect()) == [("RUNNING", 0, 0), ("SUCCESS", 3, 2)]
    newest = Q.latest_status(log).first()
    assert newest.status == "SUCCESS" and newest.duration_seconds >= 0 and newest.start_time <= newest.end_time


def test_a_failed_load_is_logged(spark, tmp_path):
    catalog, m = Catalog(spark, str(tmp_path)), micro.model(spark, [micro.shipment(1, "2024-01-10", 1001)])
    m.tables["fact_deliveries"] = m.fact_deliveries.withColumn(
        "carrier", F.raise_error(F.lit("source is gone")).cast("string"))
    with pytest.raises(Exception, match="source is gone"), Load(catalog, "FULL", ["fact_deliveries"]) as load:
        write_table(load, m, "fact_deliveries")
    newest = Q.latest_status(load_log(catalog)).first()
    assert newest.status == "FAILED" and newest.error_message and catalog.newest() == {}


def test_holidays_and_peaks_from_tables(spark):
    days = calendar.build_dim_date(spark, "2024-03-25", "2024-04-05")
    feasts = spark.createDataFrame([(dt.date(2024, 4, 1), "Easter Monday"), (None, "x")], "full_date date, holiday_name string")
    peaks = spark.createDataFrame([(dt.date(2024, 3, 30), dt.date(2024, 4, 2), "Sale")],
                                  "start_date date, end_date date, peak_event_name string")
    got = {r.full_date: r for r in calendar.mark_days(days, feasts, peaks).collect()}
    assert len(got) == 12 and [d.day for d, r in sorted(got.items()) if r.is_public_holiday] == [1]
    assert sorted(d for d, r in got.items() if r.peak_event_name == "Sale") == [
        dt.date(2024, 3, 30), dt.date(2024, 3, 31), dt.date(2024, 4, 1), dt.date(2024, 4, 2)]


def test_overlapping_periods_and_bins(spark):
    days = calendar.build_dim_date(spark, "2023-12-01", "2025-06-30")
    d = dt.date
    rows = [(d(2024, 1, 1), d(2024, 12, 31), "Year", 3), (d(2024, 2, 1), d(2024, 4, 30), "Spring", 2),
            (d(2024, 2, 10), d(2024, 2, 12), "Short", 2), (d(2024, 2, 11), d(2024, 2, 13), "Later", 2),
            (d(2024, 3, 1), d(2024, 3, 1), "First", 1), (d(2024, 5, 9), d(2024, 5, 1), "Reversed", 0),
            (None, d(2024, 5, 9), "Open", 0), (d(2024, 6, 1), d(2024, 6, 1), None, 0), (d(2024, 12, 31), d(2025, 1, 1), "Eve", None)]
    periods = spark.createDataFrame(rows, "start_date date, end_date date, peak_event_name string, priority int")
    want = {}
    for r in days.collect():
        own = [(p is None, p or 0, (e - s).days, s, n) for s, e, n, p in rows
               if s and e and n and s <= r.full_date <= e]
        if own:
            want[r.full_date] = min(own)[-1]
    for width in (1, 7, 64, 1000):
        got = calendar.period_of(days, periods, "peak_event_name", bin_days=width).collect()
        assert {r.full_date: r.peak_event_name for r in got} == want
    assert {"Year", "Spring", "Short", "Later", "First", "Eve"} == set(want.values())


def test_label_names_the_zones_that_are_summed(spark):
    m = micro.model(spark, [micro.shipment(1, "2024-01-10", 3025, failed=True, reason=S.NOT_HOME)])
    first = business.combined_impact(m).first()
    assert first.recommendation == "Parcel lockers — Rotterdam 3025, 3012, 3021" and first.impacted_deliveries == 1
    other = business.combined_impact(m, postcodes=(1001,), place="Amsterdam").first()
    assert other.recommendation == "Parcel lockers — Amsterdam 1001" and other.impacted_deliveries == 0


def test_newest_month_only(smoke_model):
    every = overview.headline_kpis(smoke_model).collect()
    newest = {c: max(r.year_month for r in every if r.city == c) for c in {r.city for r in every}}
    got = overview.headline_kpis(smoke_model, latest_only=True).collect()
    assert {r.city: r.year_month for r in got} == newest and len(got) == len(newest)


def test_results_come_in_their_order(smoke_model):
    def rows(df, *keys):
        return [tuple(r[k] for k in keys) for r in df.collect()]

    got = rows(business.city_volume(smoke_model), "total_shipments", "city")
    assert got == sorted(got, key=lambda r: (-r[0], r[1]))
    got = rows(business.reason_by_city(smoke_model), "city", "total_fails", "fail_reason")
    assert got == sorted(got, key=lambda r: (r[0], -r[1], r[2]))
    got = rows(business.city_fail_rate(smoke_model), "fail_rate_pct", "city")
    assert got == sorted(got, key=lambda r: (-r[0], r[1]))
    got = rows(overview.headline_kpis(smoke_model), "city", "year_month")
    assert got == sorted(sorted(got, key=lambda r: r[1], reverse=True), key=lambda r: r[0])
    got = rows(advanced.weekday_pattern(smoke_model), "day_of_week_number")
    assert got == sorted(got)
    got = rows(business.postcode_fail_top(smoke_model), "fail_rate_pct", "postcode_pc4")
    assert got == sorted(got, key=lambda r: (-r[0], r[1]))


def test_sorts_end_in_a_unique_key(smoke_model):
    """Any two runs give the same order: the last keys tell all rows apart."""
    from parcelscope.plans import drivers, inventory, routes
    none_first = lambda v: (v is not None, -v if v is not None else 0)       # noqa: E731
    down = lambda v: tuple(-ord(c) for c in v)                               # noqa: E731
    for query, key in [
        (routes.postcode_performance, lambda r: (-r.actual_fail_rate_pct, r.postcode_pc4)),
        (routes.fail_reason_by_city, lambda r: (r.city, -r.occurrences, r.fail_reason)),
        (routes.vehicle_mix_by_city, lambda r: (r.city, -r.shipments, r.vehicle_type)),
        (drivers.driver_scorecard, lambda r: (-r.composite_score, r.driver_id)),
        (drivers.driver_outliers, lambda r: (none_first(r.z_score), r.driver_id)),
        (drivers.vehicle_fail_stats, lambda r: (r.avg_fail_rate, r.vehicle_type)),
        (inventory.inventory_status, lambda r: (down(r.stock_status), r.days_of_supply, r.sku_code, r.warehouse_id)),
        (inventory.inventory_value, lambda r: (-r.total_inventory_value_eur, r.city, r.warehouse_id))]:
        keys = [key(r) for r in query(smoke_model).collect()]
        assert keys == sorted(keys) and len(set(keys)) == len(keys) > 1, query.__name__
