"""Session defaults never override what a job submission sets."""

from pyspark import SparkConf

from parcelscope.session import defaults_to_apply, shared_dir


def test_cluster_master_gets_no_local_sizing():
    d = defaults_to_apply("yarn", SparkConf(loadDefaults=False))
    assert "spark.sql.shuffle.partitions" not in d and "spark.ui.enabled" not in d
    assert d["spark.sql.adaptive.enabled"] == "true"
    assert d["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_local_master_gets_local_defaults():
    d = defaults_to_apply("local[8]", SparkConf(loadDefaults=False))
    assert d["spark.sql.shuffle.partitions"] == "8" and d["spark.ui.enabled"] == "false"


def test_submitted_settings_win():
    conf = SparkConf(loadDefaults=False).set("spark.sql.shuffle.partitions", "4000") \
        .set("spark.sql.session.timeZone", "Europe/Amsterdam")
    d = defaults_to_apply("local[8]", conf)
    assert "spark.sql.shuffle.partitions" not in d and "spark.sql.session.timeZone" not in d


def test_shared_dir_is_under_the_checkpoint_folder(spark):
    base = spark.sparkContext.getCheckpointDir()
    assert shared_dir(spark, "model", "x").startswith(base.rstrip("/") + "/parcelscope/")


def test_a_missing_library_of_the_optional_package_leaves_the_other_queries():
    import subprocess
    import sys

    from parcelscope.plans.registry import QUERIES
    for name in ("zstandard", "numpy", "public_tokenizers"):
        code = (f"import sys; sys.modules[{name!r}] = None; import __spark_entry__ as e; "
                "print(len(e.queries()), len(e.oracle_sql()))")
        out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
        assert out.stdout.split() == [str(len(QUERIES))] * 2, out.stderr[-500:]
