"""Hot keys: when one order holds a third of all line items, the shuffle
join of the fact build is split by AQE instead of landing in one task, and
the result does not change."""

from pyspark.sql import functions as F

from parcelscope.sources import tpch_fixture
from parcelscope.sources.model import read_sources

FORCE_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1024",
}


def _fact_summary(spark, smoke_dir):
    src = read_sources(spark, smoke_dir)
    li = src["lineitem"]
    hot = li.agg(F.min("l_orderkey")).first()[0]
    third = F.pmod(F.xxhash64("l_partkey", "l_linenumber"), F.lit(3)) == 0
    # spread over 8 map tasks (a cluster reads many files): AQE splits a
    # skewed partition along map-output boundaries, so one mapper can't split
    skewed = (li.repartition(8)
              .withColumn("l_orderkey", F.when(third, F.lit(hot)).otherwise(F.col("l_orderkey"))))
    fact = tpch_fixture.build_fact(skewed, src["orders"], src["customer"], src["part"])
    return (fact.groupBy("postcode_pc4", "attempt_1_status", "final_status")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("delivery_cost_eur").alias("cost")))


def test_validation_of_a_hot_order_and_a_hot_line(spark):
    """A third of the lines on one order, another third on one (order, line):
    the same outcomes as by tagging every row."""
    from parcelscope.operators import quality as Q
    n = 3000
    i = F.col("id")
    lines = spark.range(0, n, 1, 8).select(
        F.when(i % 3 == 0, 7).when(i % 3 == 1, 8).when(i % 50 == 2, F.lit(None)).otherwise(i).cast("bigint").alias("k"),
        F.when(i % 3 == 1, 1).otherwise(i).cast("bigint").alias("line"), (i % 40).alias("quantity"))
    orders = spark.range(0, n).where("id % 5 <> 4").select(F.col("id").alias("k"))
    rules = [*Q.not_null("k"), Q.in_range("quantity", lo=0, lo_inclusive=False)]
    tagged = Q.tag_rejects(lines, rules, ["k", "line"], [(orders, "k")])
    want = {tuple(r) for r in Q.outcome_counts(tagged, Q.reason_labels(rules, ["k", "line"], [(orders, "k")])).collect()}
    got = Q.outcome_counts_by_key(lines, rules, ["k", "line"], orders, "k")
    assert {tuple(r) for r in got.collect()} == want and len(want) == 6
    empty = Q.outcome_counts_by_key(lines.limit(0), rules, ["k", "line"], orders, "k")
    assert empty.collect() == []


def test_hot_order_key_is_split_and_results_unchanged(spark, smoke_dir):
    expected = sorted(tuple(r) for r in _fact_summary(spark, smoke_dir).collect())
    old = {k: spark.conf.get(k, None) for k in FORCE_SKEW}
    try:
        for k, v in FORCE_SKEW.items():
            spark.conf.set(k, v)
        df = _fact_summary(spark, smoke_dir)
        got = sorted(tuple(r) for r in df.collect())
        final = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert got == expected
    assert "SortMergeJoin(skew=true)" in final
