"""Benchmark: load the delivery model once, then time every registered query.

Environment:
  BENCH_SF_DIR   source tables (default /root/testdata/sf0.1)
  BENCH_CPUS     local cores (default 8)
  BENCH_REPEAT   timed runs per query; the median is reported (default 3)
  BENCH_ONLY     comma-separated query names (default: all registered)

The load step builds the model from the source tables and writes it as
Parquet under ``spark.checkpoint.dir`` (the fact partitioned by
``year_month``), the way the reference loads its sheets into a database
before the KPI queries run.  Each query is then executed in full with the
``noop`` sink — every row is computed, nothing is collected to the driver.

Prints ONE JSON line: metric, value (sum of per-query medians, seconds),
unit, queries {name: sec}, sf, plus load_sec and settings.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from parcelscope.plans.registry import QUERIES  # noqa: E402
from parcelscope.session import get_session  # noqa: E402
from parcelscope.sources.model import build_model, materialize  # noqa: E402


def _sf_of(path: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1).rstrip(".")) if m else path


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    extra = {
        "spark.sql.shuffle.partitions": str(2 * cpus),
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
        "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    }
    spark = get_session(f"local[{cpus}]", "parcelscope-bench", extra)
    if not spark.conf.get("spark.checkpoint.dir", None):
        # local run only: a fresh scratch folder; a cluster names its own
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parcelscope-bench-"))

    t0 = time.perf_counter()
    model = materialize(build_model(spark, sf_dir))
    load_sec = time.perf_counter() - t0

    names = only or list(QUERIES)
    times: dict[str, float] = {}
    for name in names:
        fn = QUERIES[name]
        runs = []
        for _ in range(repeat):
            t = time.perf_counter()
            _run(fn(model))
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs), 4)

    print(json.dumps({
        "metric": "sum_of_query_median_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": _sf_of(sf_dir),
        "load_sec": round(load_sec, 3),
        "cpus": cpus,
        "repeat": repeat,
        "shuffle_partitions": extra["spark.sql.shuffle.partitions"],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
