"""Oracle SQL (DuckDB) for the monthly KPI mart, its MoM columns and refresh."""

from oracle.fixture_sql import CTES, STAR_DEPS
from oracle.sqlkit import big, cnt, rdiv, rint, units

STAR = ("fact f JOIN dim_date d ON f.date_key = d.date_key "
        "JOIN dim_postcode p ON f.postcode_pc4 = p.postcode_pc4")
DELIVERED = "f.final_status IN ('Delivered', 'Delivered (2nd attempt)')"

UPDATE_COLS = ["total_shipments", "successful_deliveries", "failed_first_attempt", "otd_rate_pct",
               "first_attempt_fail_pct", "avg_delivery_cost_eur", "total_revenue_eur", "total_co2_kg",
               "electric_vehicle_pct"]
OTHER_COLS = ["returned_shipments", "return_rate_pct", "avg_co2_per_shipment_kg", "total_route_km",
              "avg_weight_kg", "top_product_category", "otd_rate_mom_change_pp", "cost_mom_change_pct"]


def m1(src: str = "part_all") -> str:
    """City-month mart rows from the partial aggregate CTE ``src``."""
    return f"""
SELECT g.year_month, g.city, {big('g.n')} AS total_shipments, {big('g.ok')} AS successful_deliveries,
       {big('g.fails')} AS failed_first_attempt, {big('g.returns')} AS returned_shipments,
       {rint('g.ok * 100', 'g.n', 2)} AS otd_h,
       {rdiv('g.ok * 100', 'g.n', 2)} AS otd_rate_pct, {rdiv('g.fails * 100', 'g.n', 2)} AS first_attempt_fail_pct,
       {rdiv('g.returns * 100', 'g.n', 2)} AS return_rate_pct,
       {rint('g.cost_c', 'g.n * 100', 2)} AS cost_c,
       {rdiv('g.cost_c', 'g.n * 100', 2)} AS avg_delivery_cost_eur,
       CAST(ROUND(g.value, 2) AS DOUBLE) AS total_revenue_eur, CAST(ROUND(g.co2, 4) AS DOUBLE) AS total_co2_kg,
       {rdiv('g.co2_u', 'g.n * 10000', 6)} AS avg_co2_per_shipment_kg,
       CAST(ROUND(g.km, 2) AS DOUBLE) AS total_route_km, {rdiv('g.w_c', 'g.n * 100', 2)} AS avg_weight_kg,
       t.category_name AS top_product_category, {rdiv('g.zero * 100', 'g.n', 1)} AS electric_vehicle_pct,
       CAST(NULL AS DOUBLE) AS otd_rate_mom_change_pp, CAST(NULL AS DOUBLE) AS cost_mom_change_pct
FROM (SELECT year_month, city, SUM(n) AS n, SUM(ok) AS ok, SUM(fails) AS fails, SUM(returns) AS returns,
             SUM(cost_c) AS cost_c, SUM(value) AS value, SUM(co2) AS co2, SUM(co2_u) AS co2_u, SUM(km) AS km,
             SUM(w_c) AS w_c, SUM(zero) AS zero
      FROM {src} GROUP BY year_month, city) g
JOIN (SELECT year_month, city, category_name
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY year_month, city ORDER BY n DESC, category_name) AS rn
            FROM {src})
      WHERE rn = 1) t ON g.year_month = t.year_month AND g.city = t.city"""


def partials(where: str = "TRUE", name: str = "part_all") -> str:
    return f"""{name} AS (
SELECT d.year_month, p.city, f.category_name, COUNT(*) AS n, {cnt(DELIVERED)} AS ok,
       {cnt('f.is_first_attempt_fail')} AS fails, {cnt('f.is_returned')} AS returns,
       SUM({units('f.delivery_cost_eur', 2)}) AS cost_c, SUM(f.order_value_eur) AS value,
       SUM(f.co2_emission_kg) AS co2, SUM({units('f.co2_emission_kg', 4)}) AS co2_u, SUM(f.route_km) AS km,
       SUM({units('f.weight_kg', 2)}) AS w_c, {cnt('f.is_zero_emission')} AS zero
FROM {STAR} WHERE {where}
GROUP BY d.year_month, p.city, f.category_name)"""


def _with(extra: list[str], body: str) -> str:
    parts = [f"{n} AS (\n{CTES[n]}\n)" for n in STAR_DEPS] + extra
    return "WITH " + ",\n".join(parts) + "\n" + body


_M1_COLS = ("year_month, city, total_shipments, successful_deliveries, failed_first_attempt, returned_shipments, "
            "otd_rate_pct, first_attempt_fail_pct, return_rate_pct, avg_delivery_cost_eur, total_revenue_eur, "
            "total_co2_kg, avg_co2_per_shipment_kg, total_route_km, avg_weight_kg, top_product_category, "
            "electric_vehicle_pct")

SQL = {}

SQL["monthly_kpi"] = _with([partials()], f"SELECT {_M1_COLS}, otd_rate_mom_change_pp, cost_mom_change_pct "
                                         f"FROM ({m1()})")

SQL["monthly_kpi_with_mom"] = _with([partials()], f"""
SELECT {_M1_COLS},
       (otd_h - COALESCE(LAG(otd_h) OVER w, otd_h)) / 100.0 AS otd_rate_mom_change_pp,
       {rdiv('(cost_c - COALESCE(LAG(cost_c) OVER w, cost_c)) * 100', 'LAG(cost_c) OVER w', 2)} AS cost_mom_change_pct
FROM ({m1()})
WINDOW w AS (PARTITION BY city ORDER BY year_month)""")

# a late batch and a correction change nothing in what the sums come to
SQL["mart_after_late_batch"] = SQL["monthly_kpi"]

_CUT = ("f.dispatch_datetime < CAST((SELECT MAX(CAST(dispatch_datetime AS DATE)) FROM fact) "
        "- INTERVAL 30 DAY AS TIMESTAMP)")


def _refresh_body() -> str:
    sel = ["COALESCE(n.year_month, o.year_month) AS year_month", "COALESCE(n.city, o.city) AS city"]
    sel += [f"CASE WHEN n.city IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in UPDATE_COLS]
    sel += [f"CASE WHEN o.city IS NOT NULL THEN o.{c} ELSE n.{c} END AS {c}" for c in OTHER_COLS]
    return (f"SELECT {', '.join(sel)}\nFROM ({m1()}) n\nFULL OUTER JOIN ({m1('part_old')}) o "
            "ON n.year_month = o.year_month AND n.city = o.city")


SQL["refresh_monthly_kpi"] = _with([partials(), partials(_CUT, "part_old")], _refresh_body())
