"""Derived columns and metric helpers on hand-made rows (FIXTURES part C)."""

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from parcelscope import schemas as S
from parcelscope.functions import derive
from parcelscope.functions import metrics as M


def _one(spark, col, schema, rows):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col).collect()]


def test_fail_risk_tier_bounds_and_null(spark):
    rows = [(Decimal("20.00"),), (Decimal("19.99"),), (Decimal("12.00"),), (Decimal("11.99"),), (None,)]
    got = _one(spark, derive.fail_risk_tier("h"), "h decimal(5,2)", rows)
    assert got == ["High", "Medium", "Medium", "Low", "Low"]  # NULL falls to ELSE


def test_performance_band_order(spark):
    rows = [(95, 8), (95, 9), (85, 15), (95, 16), (70, 50), (69, 0), (None, None)]
    got = _one(spark, derive.performance_band("o", "f"), "o int, f int", rows)
    # otd >= 95 with fail > 15 is Developing: the bands are checked in order
    assert got == ["Elite", "Standard", "Standard", "Developing", "Developing", "Under Review",
                   "Under Review"]


def test_multi_attempt_null_and_na(spark):
    got = _one(spark, derive.is_multi_attempt("a"), "a string", [("Success",), ("Failed",), ("N/A",), (None,)])
    assert got == [True, True, False, False]


def test_zero_emission_first_fail_returned(spark):
    df = spark.createDataFrame([("Cargo Bike", "Failed", "Returned"), ("Diesel Van", "Success", "Delivered")],
                               "v string, a string, f string")
    r = df.select(derive.is_zero_emission("v"), derive.is_first_attempt_fail("a"),
                  derive.is_returned("f")).collect()
    assert [tuple(x) for x in r] == [(True, True, True), (False, False, False)]


def test_utilisation_capacity_zero_and_null(spark):
    rows = [(50, 200), (1, 3), (10, 0), (10, None), (2500, 100)]
    got = _one(spark, derive.utilisation_pct("s", "c"), "s int, c int", rows)
    assert got == [Decimal("25.00"), Decimal("33.33"), None, None, Decimal("2500.00")]


def test_procurement_action_inclusive_bounds(spark):
    rows = [(Decimal("3.0"), 3), (Decimal("3.1"), 3), (Decimal("6.0"), 3), (Decimal("6.1"), 3), (None, 3)]
    got = _one(spark, derive.procurement_action("s", "l"), "s decimal(8,1), l short", rows)
    assert got == ["ORDER NOW", "ORDER SOON", "ORDER SOON", "OK", "OK"]  # NULL supply → OK


def test_rain_band_null_is_extreme(spark):
    rows = [(Decimal("0.0"),), (Decimal("1.9"),), (Decimal("2.0"),), (Decimal("7.9"),), (Decimal("8.0"),), (None,)]
    df = spark.createDataFrame(rows, "r decimal(6,1)")
    got = [tuple(x) for x in df.select(derive.rain_band("r"), derive.rain_band_rank("r")).collect()]
    assert got == [("No rain", 1), ("Light (0-2mm)", 2), ("Moderate (2-5mm)", 3), ("Heavy (5-8mm)", 4),
                   ("Extreme (8mm+)", 5), ("Extreme (8mm+)", 5)]


def test_day_name_and_period(spark):
    df = spark.createDataFrame([(1, True), (7, False), (8, None)], "d int, p boolean")
    got = [tuple(x) for x in df.select(derive.day_name("d"), derive.period_type("p")).collect()]
    assert got == [("Monday", "Peak"), ("Sunday", "Normal"), (None, "Normal")]


def test_transit_and_duration(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' AS a, TIMESTAMP'2024-01-01 01:30:00' AS b, "
                   "CAST(NULL AS TIMESTAMP) AS n")
    r = df.select(derive.transit_hours("a", "b"), derive.transit_hours("a", "n"),
                  derive.duration_seconds("a", "b")).first()
    assert r[0] == Decimal("1.5") and r[1] is None and r[2] == Decimal("5400.00")


def test_round_half_away_from_zero_on_decimal(spark):
    df = spark.createDataFrame([(Decimal("1.005"),), (Decimal("-1.005"),), (Decimal("2.5"),)], "x decimal(10,3)")
    got = [tuple(r) for r in df.select(F.round("x", 2), F.round("x", 0)).collect()]
    assert got == [(Decimal("1.01"), Decimal("1")), (Decimal("-1.01"), Decimal("-1")),
                   (Decimal("2.50"), Decimal("3"))]


def test_rate_exact_at_tie(spark):
    # 11.05 % exactly must round to 11.1 (a double would give 11.0 or 11.1 by luck)
    df = spark.range(2000).select((F.col("id") < 221).alias("p"))
    r = df.agg(M.rate(F.col("p"), 1).alias("r"), M.rate(F.col("p"), 2).alias("r2")).first()
    assert r.r == Decimal("11.1") and r.r2 == Decimal("11.05")


def test_mean_is_not_double_rounded(spark):
    rows = [(Decimal("0.01"),), (Decimal("0.01"),), (Decimal("0.02"),)]
    df = spark.createDataFrame(rows, "c decimal(8,2)")
    r = df.agg(M.round_mean(F.col("c"), 6).alias("m"), M.times_mean(F.lit(3), F.col("c")).alias("t")).first()
    assert r.m == Decimal("0.013333")
    assert round(r.t, 6) == Decimal("0.040000")


def test_share_of_total_sums_to_100(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n int")
    got = df.select(M.share_of_total(F.col("n"), Window.partitionBy(), 1).alias("s")).collect()
    assert sum(r.s for r in got) == Decimal("99.9")  # 33.3 three times: rounding, not error
    assert all(r.s == Decimal("33.3") for r in got)


def test_deltas_first_row(spark):
    df = spark.createDataFrame([(1, Decimal("10.00")), (2, Decimal("12.00"))], "t int, v decimal(6,2)")
    w = Window.orderBy("t")
    got = df.select(M.delta_pp(F.col("v"), F.lag("v").over(w), 2).alias("pp"),
                    M.delta_pct(F.col("v"), F.lag("v").over(w), 2).alias("pct")).orderBy("pp").collect()
    assert (got[0].pp, got[0].pct) == (Decimal("0.00"), None)
    assert (got[1].pp, got[1].pct) == (Decimal("2.00"), Decimal("20.00"))


def test_zscore_null_sigma(spark):
    df = spark.createDataFrame([(Decimal("5.0"), Decimal("4.0"), None), (Decimal("5.0"), Decimal("4.0"), Decimal("0.5"))],
                               "x decimal(5,2), mu decimal(5,2), sd decimal(5,2)")
    got = [r[0] for r in df.select(M.zscore(F.col("x"), F.col("mu"), F.col("sd"))).collect()]
    assert got[0] is None and got[1] == 2


def test_scenario_saving(spark):
    r = spark.range(1).select(M.scenario_saving(F.lit(Decimal("300.00")), S.LOCKER_EFFECT, S.DATA_YEARS).alias("s")).first()
    assert r.s == 60


def test_label_by_index_and_rank_of(spark):
    df = spark.createDataFrame([(0, "Standard"), (3, "Elite"), (2, "x")], "i int, b string")
    got = [tuple(r) for r in df.select(M.label_by_index(F.col("i"), S.VEHICLE_TYPES),
                                       M.rank_of(F.col("b"), S.PERFORMANCE_BANDS[:3])).collect()]
    assert got == [("Cargo Bike", 2), ("Cargo Van", 1), ("Diesel Van", 4)]
