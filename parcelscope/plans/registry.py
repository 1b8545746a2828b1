"""Name → query function over a :class:`Model` for every registered query."""

from __future__ import annotations

from parcelscope.plans import (advanced, business, drivers, inventory, loading, marts, order, overview,
                               routes, views)

# zones of the mapped data that stand for the locker scenario's (FIXTURES.md)
FIXTURE_ZONES = (1004, 1009, 1014)

QUERIES = {
    # business questions 1-5 (flat model)
    "scan_deliveries": business.scan_deliveries,
    "city_volume": business.city_volume,
    "city_fails": business.city_fails,
    "city_fail_rate": business.city_fail_rate,
    "city_fail_cost": business.city_fail_cost,
    "city_scorecard": business.city_scorecard,
    "reason_counts": business.reason_counts,
    "reason_cost": business.reason_cost,
    "reason_by_city": business.reason_by_city,
    "co2_total": business.co2_total,
    "co2_by_vehicle": business.co2_by_vehicle,
    "electrification_potential": business.electrification_potential,
    "postcode_fail_top": business.postcode_fail_top,
    "postcode_vs_history": business.postcode_vs_history,
    "locker_roi": business.locker_roi,
    "locker_impact": lambda m: business.locker_impact(m, FIXTURE_ZONES),
    "dispatch_impact": business.dispatch_impact,
    "combined_impact": lambda m: business.combined_impact(m, FIXTURE_ZONES, place="Zones"),
    # executive overview, routes, advanced analytics (star model)
    "headline_kpis": overview.headline_kpis,
    "otd_trend": overview.otd_trend,
    "carrier_ranking": overview.carrier_ranking,
    "postcode_performance": routes.postcode_performance,
    "fail_reason_by_city": routes.fail_reason_by_city,
    "vehicle_mix_by_city": routes.vehicle_mix_by_city,
    "peak_vs_normal": routes.peak_vs_normal,
    "rain_impact": advanced.rain_impact,
    "co2_savings": advanced.co2_savings,
    "worst_postcodes": advanced.worst_postcodes,
    "weekday_pattern": advanced.weekday_pattern,
    "rolling_fail_rate": advanced.rolling_fail_rate,
    "revenue_at_risk": advanced.revenue_at_risk,
    "deliveries_enriched": views.deliveries_enriched,
    # drivers and inventory (dimension and snapshot marts)
    "driver_scorecard": drivers.driver_scorecard,
    "band_distribution": drivers.band_distribution,
    "driver_outliers": drivers.driver_outliers,
    "vehicle_fail_stats": drivers.vehicle_fail_stats,
    "inventory_status": inventory.inventory_status,
    "inventory_value": inventory.inventory_value,
    "supply_trend": inventory.supply_trend,
    "inventory_health": views.inventory_health,
    # monthly KPI mart: build (M1), MoM columns (M3), refresh by upsert (KF1)
    "monthly_kpi": lambda m: marts.build_monthly_kpi(m).drop("refreshed_at"),
    "monthly_kpi_with_mom": lambda m: marts.with_mom_changes(marts.build_monthly_kpi(m))
    .drop("refreshed_at"),
    "refresh_monthly_kpi": marts.refresh_after_partial_load,
    "mart_after_late_batch": marts.mart_after_late_batch,
    # order of the sorted statements
    "statement_positions": order.statement_positions,
    # load, inspection, quality and audit jobs
    "verify_counts": loading.verify_counts,
    "verify_load": loading.verify_load,
    "calendar_span": loading.calendar_span,
    "calendar_from_tables": loading.calendar_from_tables,
    "peaks_from_tables": loading.peaks_from_tables,
    "profile_deliveries": loading.profile_deliveries,
    "dispatch_range": loading.dispatch_range,
    "city_list": loading.city_list,
    "fail_reason_counts": loading.fail_reason_counts,
    "peak_event_counts": loading.peak_event_counts,
    "seed_warehouses": loading.seed_warehouses,
    "seed_categories": loading.seed_categories,
    "fact_quality_report": loading.fact_quality_report,
    "dimension_quality_report": loading.dimension_quality_report,
    "key_uniqueness": loading.key_uniqueness,
    "reference_integrity": loading.reference_integrity,
    "lineitem_validation": loading.lineitem_validation,
    "load_audit": loading.load_audit,
    "load_manifest": loading.load_manifest,
    "daily_forecast": loading.daily_forecast,
    # raw sheets, loaded from files by their contracts
    "sheet_drivers": loading.sheet_drivers,
    "sheet_deliveries": loading.sheet_deliveries,
    "sheet_inventory": loading.sheet_inventory,
    "sheet_forecast": loading.sheet_forecast,
    "sheet_rejects": loading.sheet_rejects,
}
