"""Helpers shared by the operators of this package.

* ``table`` reads one of the given tables with Spark's reader only, so any
  path Spark can open works.
* ``stored`` cuts lineage: it writes a table under the folder that
  ``spark.checkpoint.dir`` names and reads it back.  A lost executor then
  costs a file re-read, and the optimizer sees real sizes (a small table is
  broadcast by Spark's own size threshold, a large one is shuffled and its
  skewed partitions split).
* ``slices`` walks Arrow batches in pieces of bounded text size, so a Python
  worker's memory does not depend on how long the texts are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelscope.session import shared_dir

SLICE_BYTES = 4 << 20
ROWS_PER_SLICE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, "llm", f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(rows: DataFrame, order, most: int) -> DataFrame:
    """At most ``most`` of ``rows`` (a stored table), those first in the order
    of the 64-bit hash ``order``; the same rows for any partitioning.  Where
    there are more, only rows under a bound of the hash that leaves about 1.2
    times as many are sorted, not ``most`` of every partition."""
    count = rows.count()
    if count > most:
        rows = rows.where(order <= F.lit(int(2 ** 64 * min(1.0, 1.2 * most / count)) - 2 ** 63 - 1))
    return rows.orderBy(order, *rows.columns[:1]).limit(most)


def slices(batches: Iterator[pa.RecordBatch], column: int,
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices whose text in ``column`` has at most about
    ``limit`` bytes (one longer text is a slice of its own)."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        while at < n:
            end, size = at + 1, sizes[at]
            while end < n and end - at < ROWS_PER_SLICE and size + sizes[end] <= limit:
                size += sizes[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end
