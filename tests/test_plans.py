"""Plan shape: what each query must look like to hold at cluster scale.

Checked on the physical plan (``explain``).  The load's plan is checked with
automatic broadcast switched off, as for tables that are too large; the
queries' plans with the default threshold, which takes the dimensions only.
"""

import re

import pytest

from parcelscope.plans.registry import QUERIES
from parcelscope.sources.model import build_model, materialize


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module", autouse=True)
def full_scan_paths(spark):
    key = "spark.sql.maxMetadataStringLength"
    old = spark.conf.get(key)
    spark.conf.set(key, "100000")
    yield
    spark.conf.set(key, old)


@pytest.fixture(scope="module")
def raw(spark, smoke_dir):
    return build_model(spark, smoke_dir)


@pytest.fixture(scope="module")
def written(spark, raw):
    return materialize(raw)


def scans(p: str, table: str) -> list[str]:
    return [line for line in p.splitlines() if "FileScan" in line and f"/{table}" in line]


def test_fact_build_prunes_columns_and_shuffles_line_items_twice(raw, no_auto_broadcast):
    p = plan(QUERIES["city_fail_rate"](raw))
    (li,) = scans(p, "lineitem.parquet")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", li).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag"}
    # orders ⋈ customer first: line items are hashed by order key, then part key
    assert "hashpartitioning(o_orderkey" in p
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", p)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(l_partkey", p)) == 1
    assert "hashpartitioning(o_custkey" in p


def test_the_load_shuffles_source_columns_not_the_derived_rows(spark, raw, tmp_path, monkeypatch):
    from parcelscope.sources import ingest, model
    from parcelscope.sources.load import Load
    from parcelscope.sources.manifest import Catalog
    seen, write = [], ingest.write_table
    monkeypatch.setattr(ingest, "write_table", lambda df, *a, **k: (seen.append(df), write(df, *a, **k)))
    catalog = Catalog(spark, str(tmp_path))
    with Load(catalog, "FULL", ["fact_deliveries"]) as load:
        model.write_table(load, raw, "fact_deliveries")
    p = plan(seen[0])
    dealt = p.index("Exchange hashpartitioning(year_month")
    assert "concat_ws" in p[:dealt] and "concat_ws" not in p[dealt:]
    assert p.count("Sort [") == 1 and p.index("Sort [") < dealt, "sorted once, before the rows are derived"
    got = catalog.read(load.by_table()["fact_deliveries"], model.declared_schemas()["fact_deliveries"])
    want = raw.fact_deliveries.select(*got.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_a_replaced_table_is_not_loaded_from_the_stage(raw):
    from parcelscope.sources import model

    class Seen:
        def write(self, name, df, *a, **k):
            self.df, self.derive = df, k.get("derive")

    seen, few = Seen(), raw.fact_deliveries.limit(1)
    model.write_table(seen, model.Model(raw.spark, {**raw.tables, "fact_deliveries": few}, staged=raw.staged), "fact_deliveries")
    assert seen.df is few and seen.derive is None


def test_peaks_from_tables_do_not_shuffle_the_shipments(written, no_auto_broadcast):
    from parcelscope.plans import loading
    from parcelscope.sources.model import with_calendar
    p = plan(with_calendar(written, *loading.busy_periods(written)).fact_deliveries)
    assert re.search(r"\w+Join", p).group(0) == "BroadcastHashJoin"
    assert re.search(r"FileScan|Exchange", p).group(0) == "FileScan"


def test_star_queries_broadcast_dimensions_only(written):
    for name in ["headline_kpis", "otd_trend", "postcode_performance", "co2_savings",
                 "deliveries_enriched", "monthly_kpi", "city_scorecard", "worst_postcodes"]:
        p = plan(QUERIES[name](written))
        assert "SortMergeJoin" not in p and "ShuffledHashJoin" not in p, name
        assert "BroadcastHashJoin" in p, name
        assert len(scans(p, "fact_deliveries")) == 1, name


def test_monthly_mart_one_scan_no_join(written):
    p = plan(QUERIES["monthly_kpi"](written))
    assert len(scans(p, "fact_deliveries")) == 1
    # exchanges carry aggregated rows only: (month, city, category) then (month, city)
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 2
    assert "SortMergeJoin" not in p


def test_monthly_mart_ranks_categories_without_a_window(written):
    p = plan(QUERIES["monthly_kpi"](written))
    assert "Window" not in p and "min_by" in p


def test_line_validation_reads_the_lines_once_and_joins_nothing(raw, no_auto_broadcast):
    p = plan(QUERIES["lineitem_validation"](raw))
    assert len(scans(p, "lineitem.parquet")) == 1 and len(scans(p, "orders.parquet")) == 1
    assert "Join" not in p and "Window" not in p
    # lines are summed per key before they are shuffled
    exchange = p.index("Exchange hashpartitioning(l_orderkey#", p.index("Exchange hashpartitioning(l_orderkey#") + 1)
    assert "partial_count" in p[exchange:p.index("FileScan", exchange)]


def test_line_validation_keeps_two_sums_per_line(raw):
    p = plan(QUERIES["lineitem_validation"](raw))
    (line,) = [x for x in p.splitlines() if "HashAggregate(keys=[l_orderkey" in x and "partial_count" in x]
    assert line.count("partial_count") == 2
    assert "lambda" not in p


def test_failed_only_filter_reaches_parquet(written):
    p = plan(QUERIES["reason_counts"](written))
    (fact,) = scans(p, "fact_deliveries")
    assert "EqualTo(attempt_1_status,Failed)" in fact


def test_three_scenarios_from_one_scan(written):
    p = plan(QUERIES["combined_impact"](written))
    assert len(scans(p, "fact_deliveries")) == 1
    assert "Window" not in p and "Union" not in p


def test_windows_run_on_aggregated_rows(written):
    # each window's input is the output of a final aggregate, not raw rows
    for name in ["headline_kpis", "carrier_ranking", "co2_savings", "rolling_fail_rate", "fail_reason_by_city"]:
        p = plan(QUERIES[name](written))
        lines = p.splitlines()
        win = [i for i, line in enumerate(lines) if line.lstrip(" +-:").startswith("Window ")]
        assert win, name
        for i in win:
            below = "\n".join(lines[i + 1:])
            first_agg = below.find("HashAggregate(")
            first_scan = below.find("FileScan")
            assert 0 <= first_agg < first_scan, name
            assert "partial_" not in below[first_agg:below.find("\n", first_agg)], name


TOTALS = ["reason_cost", "co2_by_vehicle", "weekday_pattern", "carrier_ranking"]


def test_no_window_holds_all_rows(written):
    for name in TOTALS:
        for line in plan(QUERIES[name](written)).splitlines():
            if line.lstrip(" +-:").startswith("Window "):
                assert re.search(r"windowspecdefinition\(_range#", line), name


def test_totals_and_ranks_scan_the_fact_once(written):
    """The subqueries run on the exchange that the query itself makes."""
    for name in TOTALS:
        df = QUERIES[name](written)
        df.collect()
        lines = plan(df).splitlines()       # only what has run is compiled: *(n)
        ran = [below for line, below in zip(lines, lines[1:]) if re.search(r"\*\(\d+\) ColumnarToRow", line)]
        assert len(scans("\n".join(ran), "fact_deliveries")) == 1 and "ReusedExchange" in "\n".join(lines), name


def test_latest_snapshot_prunes_partitions(written):
    for name in ["inventory_status", "inventory_health"]:
        p = plan(QUERIES[name](written))
        (inv,) = scans(p, "mart_inventory_snapshot")     # no second scan for the maximum
        assert re.search(r"PartitionFilters: \[[^\]]*snapshot_date#\d+ = \d{4}-\d\d-\d\d", inv)


def test_last_dispatch_is_not_searched_for(written):
    p = plan(QUERIES["rolling_fail_rate"](written))
    assert len(scans(p, "fact_deliveries")) == 1 and "Subquery" not in p


def test_no_zone_join_where_no_city_is_asked_for(written):
    for name in ["co2_total", "reason_counts", "reason_cost", "co2_by_vehicle", "electrification_potential",
                 "combined_impact", "dispatch_range", "fail_reason_counts"]:
        p = plan(QUERIES[name](written))
        # a total's subqueries are planned on scans of their own, which are not run (see above)
        assert "Join" not in p and (len(scans(p, "fact_deliveries")) == 1 or name in TOTALS), name


def test_no_job_runs_while_a_plan_is_built(spark, written):
    # these run their loads and refreshes
    stores = {"refresh_monthly_kpi", "mart_after_late_batch", *[q for q in QUERIES if q.startswith("sheet_")]}
    for name in set(QUERIES) - stores:
        spark.sparkContext.setJobGroup(f"plan-{name}", name)
        QUERIES[name](written)
        ran = spark.sparkContext.statusTracker().getJobIdsForGroup(f"plan-{name}")
        assert list(ran) == [], name
    spark.sparkContext.setJobGroup("", "")


def test_rolling_window_prunes_months(written):
    p = plan(QUERIES["rolling_fail_rate"](written))
    main = [s for s in scans(p, "fact_deliveries") if "is_first_attempt_fail" in s]
    assert main and "year_month" in main[0].split("PartitionFilters: [")[1].split("]")[0]


def test_foreign_keys_of_the_fact_in_one_pass(written):
    p = plan(QUERIES["reference_integrity"](written))
    assert len(scans(p, "fact_deliveries")) == 1
    # the keys are counted before the parents are joined
    below = p[p.index("BroadcastHashJoin"):]
    assert below.index("HashAggregate(keys=[") < below.index("FileScan")


def test_sorted_months_let_failed_only_scans_skip_row_groups(spark, tmp_path):
    # sf0.01 with tiny row groups stands in for months of many row groups
    import glob
    import os

    import pyarrow.parquet as pq

    from parcelscope.sources import ingest
    from parcelscope.sources.model import PARTITION_COLUMNS, SORT_COLUMNS
    src = "/root/testdata/sf0.01"
    if not os.path.isdir(src):
        pytest.skip("sf0.01 not present")
    out = str(tmp_path / "fact")
    ingest.write_table(build_model(spark, src).fact_deliveries, out,
                       partition_by=PARTITION_COLUMNS["fact_deliveries"],
                       sort_within=SORT_COLUMNS["fact_deliveries"],
                       **{"parquet.block.size": 4096, "parquet.page.size.row.check.min": 10})
    groups = skippable = 0
    for f in glob.glob(out + "/*/*.parquet"):
        md = pq.ParquetFile(f).metadata
        col = [md.schema.column(i).name for i in range(md.num_columns)].index("attempt_1_status")
        for i in range(md.num_row_groups):
            st = md.row_group(i).column(col).statistics
            groups += 1
            skippable += not (st.min <= "Failed" <= st.max)
    assert groups > 83 and skippable >= groups // 2


def test_zone_queries_aggregate_before_joining_zone_attributes(written):
    for name in ["postcode_performance", "worst_postcodes", "postcode_fail_top",
                 "postcode_vs_history", "locker_roi", "locker_impact", "revenue_at_risk"]:
        p = plan(QUERIES[name](written))
        join = p.index("BroadcastHashJoin [postcode_pc4")
        below = p[join:]
        # the fact reaches the zone join only through an aggregate keyed by the zone
        assert below.index("HashAggregate(keys=[postcode_pc4") < below.index("FileScan"), name
        assert len(scans(p, "fact_deliveries")) == 1, name


def test_month_city_kpis_aggregate_by_day_and_zone_before_the_star_joins(written):
    for name in ["headline_kpis", "otd_trend", "co2_savings", "weekday_pattern", "peak_vs_normal"]:
        p = plan(QUERIES[name](written))
        below = p[p.index("BroadcastHashJoin [date_key"):]
        assert below.index("HashAggregate(keys=[date_key") < below.index("FileScan"), name
        # scans of totals: test_totals_and_ranks_scan_the_fact_once
        assert len(scans(p, "fact_deliveries")) == 1 or name in TOTALS, name
