"""Query edge cases on hand-made models (FIXTURES part C)."""

import re
from decimal import Decimal

from parcelscope.plans import advanced, business, drivers, marts, overview
from tests import micro


def test_one_driver_city_has_null_z_and_sorts_first(spark):
    d = micro.drivers(spark, [
        ("D1", "Amsterdam", "5.00", True), ("D2", "Amsterdam", "7.00", True),
        ("D3", "Amsterdam", "30.00", True), ("D4", "Utrecht", "9.00", True),
        ("D5", "Amsterdam", "99.00", False),  # inactive: ignored
    ])
    m = micro.model(spark, [], drivers=d)
    rows = drivers.driver_outliers(m).collect()
    assert [r.driver_id for r in rows][0] == "D4"
    assert rows[0].z_score is None and rows[0].alert_status == "🟢 Normal"
    assert {r.driver_id for r in rows} == {"D1", "D2", "D3", "D4"}
    d3 = next(r for r in rows if r.driver_id == "D3")
    assert d3.city_avg_fail == Decimal("14.00") and d3.above_avg_pp == Decimal("16.00")
    # std of 5, 7, 30 = 13.8924...; rounded to 13.89 before the z-score
    assert d3.z_score == Decimal("1.15") and d3.alert_status == "🟡 Watch"


def test_top_category_tie_breaks_by_name(spark):
    ships = [micro.shipment(1, "2024-03-01", 1001, category="Fashion"),
             micro.shipment(2, "2024-03-02", 1001, category="Books"),
             micro.shipment(3, "2024-03-03", 1001, category="Electronics"),
             micro.shipment(4, "2024-03-04", 1001, category="Electronics"),
             micro.shipment(5, "2024-03-05", 1001, category="Books")]
    m = micro.model(spark, ships)
    r = marts.build_monthly_kpi(m).collect()
    assert len(r) == 1 and r[0].top_product_category == "Books"
    assert r[0].total_shipments == 5


def test_lag_uses_previous_row_over_a_missing_month(spark):
    ships = [micro.shipment(1, "2024-01-10", 1001, cost="4.00"),
             micro.shipment(2, "2024-03-10", 1001, cost="5.00", failed=True, reason="Not home"),
             micro.shipment(3, "2024-03-11", 1001, cost="5.00")]
    m = micro.model(spark, ships)
    rows = {r.year_month: r for r in overview.headline_kpis(m).collect()}
    assert set(rows) == {"2024-01", "2024-03"}
    first, mar = rows["2024-01"], rows["2024-03"]
    assert first.fail_mom_pp == Decimal("0.00") and first.otd_mom_pp == Decimal("0.00")
    assert first.cost_mom_pct is None
    assert mar.fail_mom_pp == Decimal("50.00")       # vs January, the previous row
    assert mar.cost_mom_pct == Decimal("25.00")


def test_upsert_refresh_updates_only_listed_columns(spark):
    ships = [micro.shipment(1, "2024-01-10", 1001), micro.shipment(2, "2024-02-10", 1001),
             micro.shipment(3, "2024-02-11", 1001, returned=True, failed=True, second="Failed")]
    m = micro.model(spark, ships)
    old = marts.build_monthly_kpi(m, until=micro.F.lit("2024-02-11").cast("timestamp_ntz"))
    fresh = {r.year_month: r for r in marts.refresh_monthly_kpi(m, old).collect()}
    feb = fresh["2024-02"]
    assert feb.total_shipments == 2              # listed column: updated
    assert feb.returned_shipments == 0           # not listed: stale, as published
    assert fresh["2024-01"].total_shipments == 1


def test_rain_null_goes_to_extreme_band(spark):
    ships = [micro.shipment(1, "2024-01-10", 1001), micro.shipment(2, "2024-01-11", 1001)]
    ships[1]["rain_mm"] = None
    m = micro.model(spark, ships)
    got = {r.rain_band: r.shipments for r in advanced.rain_impact(m).collect()}
    assert got == {"Light (0-2mm)": 1, "Extreme (8mm+)": 1}


def test_zone_without_shipments_drops_out_of_inner_join(spark):
    ships = [micro.shipment(1, "2024-01-10", 1001), micro.shipment(2, "2024-01-11", 3001)]
    m = micro.model(spark, ships)
    from parcelscope.operators.joins import star
    got = {r.postcode_pc4 for r in star(m, ["route_km"], dim_postcode=["city"]).collect()}
    assert got == {1001, 3001}
    assert {r.city for r in business.city_volume(m).collect()} == {"Amsterdam", "Rotterdam"}


def test_refresh_to_writes_new_version_and_audits(spark, tmp_path):
    ships = [micro.shipment(1, "2024-01-10", 1001), micro.shipment(2, "2024-02-10", 3001),
             micro.shipment(3, "2024-02-11", 3001, failed=True, reason="Not home")]
    m = micro.model(spark, ships)
    v1, v2, audit = str(tmp_path / "mart_v1"), str(tmp_path / "mart_v2"), str(tmp_path / "audit")
    first = marts.refresh_to(m, v1, current_path=str(tmp_path / "absent"), audit_path=audit)
    assert first.count() == 2
    second = marts.refresh_to(m, v2, current_path=v1, audit_path=audit)
    assert sorted((r.year_month, r.city, r.total_shipments, r.failed_first_attempt)
                  for r in second.collect()) == [("2024-01", "Amsterdam", 1, 0), ("2024-02", "Rotterdam", 2, 1)]
    log = sorted((r.status, r.rows_inserted, r.rows_updated, r.load_type)
                 for r in spark.read.parquet(audit).collect())
    assert log == [("RUNNING", 0, 0, "REFRESH")] * 2 + [("SUCCESS", 0, 2, "REFRESH"), ("SUCCESS", 2, 0, "REFRESH")]


def test_incremental_refresh_reads_touched_months_only(spark, tmp_path):
    ships = [micro.shipment(1, "2024-01-10", 1001), micro.shipment(2, "2024-02-10", 3001)]
    m = micro.model(spark, ships)
    v1, v2 = str(tmp_path / "v1"), str(tmp_path / "v2")
    marts.refresh_to(m, v1)
    ships2 = ships + [micro.shipment(3, "2024-02-12", 3001, failed=True, reason="Not home")]
    m2 = micro.model(spark, ships2)
    plan = marts.build_monthly_kpi(m2, from_month="2024-02")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"year_month#\d+ >= 2024-02", plan)
    out = {r.year_month: r for r in marts.refresh_to(m2, v2, current_path=v1, from_month="2024-02").collect()}
    assert out["2024-01"].total_shipments == 1 and out["2024-02"].total_shipments == 2
    assert out["2024-02"].failed_first_attempt == 1


def test_refresh_to_refuses_to_overwrite_its_input(spark, tmp_path):
    import pytest
    m = micro.model(spark, [micro.shipment(1, "2024-01-10", 1001)])
    with pytest.raises(ValueError):
        marts.refresh_to(m, str(tmp_path / "v1"), current_path=str(tmp_path / "v1"))


def test_locker_label_uses_rounded_rate_strictly_greater(spark):
    # zone 1002: 276/2500 = 11.04 % → 11.0, not > 11; zone 3001: 221/2000 = 11.05 % → 11.1
    ships, i = [], 0
    for pc, n, fails in [(1002, 2500, 276), (3001, 2000, 221), (1001, 10, 5)]:
        for j in range(n):
            i += 1
            ships.append(micro.shipment(i, "2024-05-01", pc, failed=j < fails, reason="Not home"))
    m = micro.model(spark, ships)
    got = {r.postcode_pc4: (r.fail_rate_pct, r.recommendation)
           for r in business.locker_roi(m).collect()}
    assert got[1002] == (Decimal("11.0"), "Review coverage")
    assert got[3001] == (Decimal("11.1"), "Install locker - High Priority")
    assert got[1001][1] == "Monitor"      # locker present
