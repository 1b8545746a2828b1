"""Totals, ranks and positions in ranges against plain windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parcelscope.operators.ranks import positions, total
from parcelscope.plans.order import ORDERS, statement_order

WAYS = {"asc": F.asc_nulls_first, "desc": F.desc_nulls_last, "desc_nulls_first": F.desc_nulls_first,
        "asc_nulls_last": F.asc_nulls_last}


@pytest.fixture(scope="module")
def rows(spark):
    texts = [None, "Bé", "Ber", "Amsterdam", "Amsterdam Zuid", "Amsterdam", "", "Zoo"]
    values = [None, 1.5, 2.0, -7.0, 3.25, 1.5, 1.5]
    return (spark.createDataFrame([(i, texts[i * 7 % 8], values[i * 5 % 7]) for i in range(2000)],
                                  "id int, t string, v double")
            .withColumns({"money": F.col("v").cast("decimal(10,2)"), "flag": F.col("v") > 2,
                          "day": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("v") * 3).cast("int"))})
            .groupBy("id", "t", "v", "money", "flag", "day").agg(F.count("*").alias("n")))


@pytest.mark.parametrize("key", ["t", "money", "day"])
def test_positions_equal_a_window(rows, key):
    for way in WAYS:
        for ties in (True, False):
            order = [(key, way)] + ([] if ties else [("id", "desc")])
            plain = Window.orderBy(*[WAYS[w](c) for c, w in order])
            want = rows.select("id", (F.rank() if ties else F.row_number()).over(plain).alias("p")).collect()
            got = positions(rows, "p", order, ties).select("id", "p").collect()
            assert sorted(got) == sorted(want), (key, way, ties)


def test_ranges_do_not_change_a_rank(rows):
    one, many = (positions(rows, "p", [("v", "desc"), ("flag", "asc"), ("id", "asc")], ranges=r).select("id", "p").collect()
                 for r in (2, 500))
    assert sorted(one) == sorted(many)


def test_a_hot_value_and_no_rows(spark, rows):
    same = rows.withColumn("v", F.lit(1.0))
    got = positions(same, "p", [("v", "asc"), ("id", "asc")]).collect()
    assert sorted((r.p, r.id) for r in got) == [(i + 1, i) for i in range(2000)]
    assert {r.p for r in positions(same, "p", [("v", "asc")], ties=True).collect()} == {1}
    none = rows.limit(0)
    put = positions(none, "p", [("t", "asc")])
    assert put.collect() == [] and put.columns == [*rows.columns, "p"]
    assert none.select(total(none, F.col("n"))).collect() == []
    assert {r[0] for r in rows.select(total(rows, F.col("n"))).collect()} == {2000}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_statements_come_in_their_positions(smoke_model, name):
    query, _, names = ORDERS[name]
    came = ["|".join(str(r[c]) for c in names) for r in query(smoke_model).collect()]
    put = [r.row_name for r in sorted(statement_order(smoke_model, name).collect(), key=lambda r: r.position)]
    assert came == put and len(set(came)) == len(came)
