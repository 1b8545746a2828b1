"""Upsert, quality checks and ingest helpers (M2, M4–M10, S7–S11)."""

from decimal import Decimal

from pyspark.sql import functions as F

from parcelscope.operators import quality as Q
from parcelscope.operators.joins import top1_per_group
from parcelscope.operators.upsert import upsert, upsert_counts
from parcelscope.sources import ingest


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_upsert_insert_update_untouched(spark):
    target = spark.createDataFrame([("a", 1, "x1"), ("b", 2, "x2")], "k string, v int, w string")
    updates = spark.createDataFrame([("b", 20, "y2"), ("c", 30, "y3")], "k string, v int, w string")
    out = upsert(target, updates, ["k"], ["v"])
    # a untouched; b: only the listed column changes; c inserted whole
    assert _rows(out, "k", "v", "w") == [("a", 1, "x1"), ("b", 20, "x2"), ("c", 30, "y3")]
    assert _rows(upsert_counts(target, updates, ["k"]), "rows_inserted", "rows_updated") == [(1, 1)]


def test_upsert_twice_equals_once(spark):
    target = spark.createDataFrame([("a", 1, "x1"), ("b", 2, "x2")], "k string, v int, w string")
    updates = spark.createDataFrame([("b", 20, "y2"), ("c", 30, "y3")], "k string, v int, w string")
    once = upsert(target, updates, ["k"], ["v"])
    twice = upsert(once, updates, ["k"], ["v"])
    assert _rows(once, "k", "v", "w") == _rows(twice, "k", "v", "w")


def test_split_valid_reasons_and_partition(spark):
    rows = [("k1", "Cargo Bike", Decimal("1.00"), "o1"),
            (None, "Cargo Bike", Decimal("1.00"), "o1"),     # NULL key
            ("k3", "Rocket", Decimal("1.00"), "o1"),          # bad enum
            ("k4", "Cargo Bike", Decimal("-1.00"), "o1"),     # negative cost
            ("k5", "Cargo Bike", Decimal("1.00"), "o9"),      # orphan
            ("k6", "Cargo Bike", Decimal("1.00"), "o1"),
            ("k6", "Cargo Bike", Decimal("1.00"), "o1"),      # duplicate key
            ("k8", None, Decimal("1.00"), "o1")]              # NULL passes a domain check
    df = spark.createDataFrame(rows, "id string, vehicle string, cost decimal(8,2), parent string")
    parent = spark.createDataFrame([("o1",)], "parent string")
    rules = [*Q.not_null("id"), Q.domain("vehicle", ["Cargo Bike"]), Q.in_range("cost", lo=0)]
    valid, rejected = Q.split_valid(df, rules, unique_keys=["id"], references=[(parent, "parent")])
    assert valid.count() + rejected.count() == df.count()
    assert _rows(valid, "id") == [("k1",), ("k8",)]
    summary = dict(_rows(Q.reject_summary(rejected), "reason", "rejected_rows"))
    assert summary == {"not_null:id": 1, "domain:vehicle": 1, "range:cost": 1,
                       "orphan:parent": 1, "duplicate:id": 2}
    counts = Q.validation_counts(Q.tag_rejects(df, rules, ["id"], [(parent, "parent")])).first()
    assert (counts.rows_inserted, counts.rows_rejected) == (2, 6)
    labels = Q.reason_labels(rules, ["id"], [(parent, "parent")])
    outcomes = dict(_rows(Q.outcome_counts(Q.tag_rejects(df, rules, ["id"], [(parent, "parent")]), labels),
                          "reason", "rows"))
    assert outcomes == {"valid": 2, "rejected": 6, **summary}


def test_rule_report_one_row_per_rule(spark):
    df = spark.createDataFrame([(None, 5), ("a", -1), ("b", 2)], "c string, n int")
    rep = _rows(Q.rule_report(df, [*Q.not_null("c"), Q.in_range("n", 0, 4)], "t"),
                "check_name", "column_name", "failed_rows")
    assert rep == [("not_null", "c", 1), ("range", "n", 2)]


def test_unique_and_reference_checks(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, None)], "k int, p string")
    parent = spark.createDataFrame([("x",)], "p string")
    u = Q.check_unique(df, ["k"], "t").first()
    assert (u.duplicate_keys, u.rows_with_duplicate_key) == (1, 2)
    r = Q.check_reference(df, parent, "p", "t", "parent").first()
    assert r.orphan_rows == 1   # NULL reference is not an orphan


def test_audit_rows_and_latest_status(spark, tmp_path):
    counts = spark.createDataFrame([(10, 2)], "rows_inserted long, rows_rejected long")
    start = Q.audit_rows(counts, "fact", "FULL", "RUNNING", start="2024-01-01 00:00:00",
                         end="2024-01-01 00:00:00")
    end = Q.audit_rows(counts, "fact", "FULL", "SUCCESS", start="2024-01-01 00:00:00",
                       end="2024-01-01 00:01:30")
    path = str(tmp_path / "audit")
    Q.log_load(start, path)
    Q.log_load(end, path)
    latest = Q.latest_status(spark.read.parquet(path)).collect()
    assert len(latest) == 1 and latest[0].status == "SUCCESS"
    assert latest[0].duration_seconds == Decimal("90.00") and latest[0].rows_updated == 0


def test_seed_if_absent_conflict_does_nothing(spark):
    target = spark.createDataFrame([(1, "Books")], "id int, name string")
    seed = spark.createDataFrame([(1, "Other"), (2, "Books"), (3, "Toys")], "id int, name string")
    out = ingest.seed_if_absent(target, seed, ["id", "name"])
    assert _rows(out, "id", "name") == [(1, "Books"), (3, "Toys")]


def test_value_counts_keeps_null_group(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",), ("b",), ("b",), ("c",)], "r string")
    got = [tuple(r) for r in ingest.value_counts(df, "r", 2).collect()]
    assert got == [(None, 2), ("b", 2)]   # count desc, NULL first on a tie


def test_verify_counts_status_and_summary(spark):
    t = {"a": spark.range(3), "b": spark.range(2)}
    v = ingest.verify_counts(t, {"a": 3, "b": 5})
    assert _rows(v, "table_name", "row_count", "status") == [("a", 3, "OK"), ("b", 2, "MISMATCH")]
    s = ingest.verify_summary(v).first()
    assert s.total_rows == 5 and s.all_ok is False


def test_profile_counts_nulls(spark):
    df = spark.createDataFrame([(None, 1), ("a", None), ("b", 2)], "c string, n int")
    got = _rows(ingest.profile(df), "row_count", "column_count", "column_name", "null_count")
    assert got == [(3, 2, "c", 1), (3, 2, "n", 1)]


def test_rename_ignores_absent_columns(spark):
    df = spark.createDataFrame([(1, 2)], "month int, other int")
    assert ingest.rename(df, {"month": "month_name", "year": "year_num"}).columns == ["month_name", "other"]


def test_top1_per_group(spark):
    df = spark.createDataFrame([("g", "b", 2), ("g", "a", 2), ("h", "c", 1)], "g string, n string, c int")
    got = _rows(top1_per_group(df, ["g"], [F.desc("c"), F.asc("n")]), "g", "n")
    assert got == [("g", "a"), ("h", "c")]


def test_load_tables_renames_writes_and_verifies(spark, smoke_model, tmp_path):
    sheet = smoke_model.dim_driver.withColumnsRenamed({"driver_name": "name", "is_active": "active"})
    csv_dir = str(tmp_path / "drivers_csv")
    sheet.select("driver_id", "name", "city", "active").write.option("header", True).csv(csv_dir)
    n = sheet.count()
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ["driver_id", "name", "city"]]
                          + [T.StructField("active", T.BooleanType())])
    out = str(tmp_path / "loaded")
    v = ingest.load_tables(spark, {"dim_drivers": csv_dir}, out, fmt="csv",
                           schemas={"dim_drivers": schema}, expected={"dim_drivers": n}, header=True)
    assert _rows(v, "table_name", "row_count", "status") == [("dim_drivers", n, "OK")]
    assert spark.read.parquet(f"{out}/dim_drivers").columns == ["driver_id", "driver_name", "city", "is_active"]


def test_read_model_round_trip(spark, smoke_model, tmp_path):
    from parcelscope.plans.registry import QUERIES
    from parcelscope.sources.model import declared_schemas, materialize, read_model
    root = str(tmp_path / "model")
    written = materialize(smoke_model, root)
    again = read_model(spark, root)
    for name, schema in declared_schemas().items():
        assert again.tables[name].columns == schema.fieldNames()
    a = _rows(QUERIES["headline_kpis"](smoke_model), "city", "year_month", "total_shipments", "fail_rate_pct")
    b = _rows(QUERIES["headline_kpis"](again), "city", "year_month", "total_shipments", "fail_rate_pct")
    assert a == b and written.materialized_at == root


def test_register_views_for_sql(spark, smoke_model):
    from parcelscope.plans.registry import QUERIES
    names = smoke_model.register_views("flat", prefix="t_flat_")
    assert "t_flat_fact_deliveries" in names and "t_flat_dim_postcodes" in names
    sql = _rows(spark.sql("SELECT city, COUNT(*) AS total_shipments FROM t_flat_fact_deliveries "
                          "GROUP BY city"), "city", "total_shipments")
    assert sql == _rows(QUERIES["city_volume"](smoke_model), "city", "total_shipments")
    star = smoke_model.register_views("star", prefix="t_star_")
    assert "t_star_dim_date" in star
    n = spark.sql("SELECT COUNT(*) AS n FROM t_star_fact_deliveries f "
                  "JOIN t_star_dim_postcode p ON f.postcode_pc4 = p.postcode_pc4").first().n
    assert n == sum(r[1] for r in sql)


def test_write_table_other_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = str(tmp_path / "json")
    ingest.write_table(df, out, fmt="json")
    assert _rows(spark.read.json(out), "k", "v") == [(1, "a"), (2, "b")]
