"""Ingest: reading, renaming, writing, seeding and inspecting tables (S1–S11).

The reference loads spreadsheet sheets into a database one process at a
time; here each step is a DataFrame operation the cluster runs in parallel.
Inspection helpers return DataFrames (one aggregation pass each) instead of
printing, so nothing is pulled whole to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# S1
def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet", **options) -> DataFrame:
    """Load one dataset with a declared schema (no inference pass)."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


# S2–S5
def rename(df: DataFrame, mapping: dict) -> DataFrame:
    """Apply a load-time rename map; absent source columns are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


# S6
def write_table(df: DataFrame, path: str | None, mode: str = "overwrite",
                partition_by: list | None = None, sort_within: list | None = None,
                fmt: str = "parquet", tasks: int | None = None, dealt: bool = False, **options) -> None:
    """Full replace (``mode='overwrite'``) of a table, Parquet by default.

    ``sort_within`` orders rows inside each written file so Parquet
    row-group min/max statistics can skip groups for filters on those
    columns (e.g. failed shipments only).  ``fmt`` is any Spark data source
    (``"jdbc"`` with ``url``/``dbtable`` options and ``path=None`` replaces a
    database table, as the published load does); ``options`` go to the
    writer.  A small table of many partitions is dealt to ``tasks`` tasks by
    partition, as its bytes alone would make one task of it.  ``dealt`` rows
    lie with their partition already, in the order they are written in."""
    w = df
    if partition_by and not dealt:
        # AQE splits a partition value that holds a large share of the rows
        w = df.hint("rebalance", *partition_by) if tasks is None else df.repartition(tasks, *partition_by)
    if sort_within and not dealt:
        w = w.sortWithinPartitions(*(partition_by or []), *sort_within)
    writer = w.write.mode(mode).format(fmt).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path) if path is not None else writer.save()


# S7
def seed_if_absent(target: DataFrame, seed: DataFrame, keys) -> DataFrame:
    """Insert seed rows whose key is absent (``ON CONFLICT DO NOTHING``).

    ``keys`` is a list of conflict keys; a seed row conflicting on any of
    them (e.g. id *or* unique name) is skipped.
    """
    fresh = seed
    for key in keys:
        cols = [key] if isinstance(key, str) else list(key)
        fresh = fresh.join(target.select(*cols), cols, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


# S8
def profile(df: DataFrame) -> DataFrame:
    """Row count, column count and NULL count per column, in one pass."""
    n_cols = len(df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("null_count"))
                     for i, c in enumerate(df.columns)])
    return agg.select(F.col("_rows").alias("row_count"), F.lit(n_cols).alias("column_count"),
                      F.inline(rows))


# S9
def value_range(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("min_value"), F.max(col).alias("max_value"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


# S10 — like pandas value_counts(dropna=False).head(k): NULL is a group
def value_counts(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_first(col)).limit(k))


# S11
def verify_counts(tables: dict, expected: dict | None = None) -> DataFrame:
    """Row count per table (UNION ALL of counts) with OK/MISMATCH status."""
    counts = [df.agg(F.count(F.lit(1)).alias("row_count"))
              .select(F.lit(name).alias("table_name"), "row_count")
              for name, df in tables.items()]
    out = reduce(DataFrame.unionByName, counts)
    return out if expected is None else with_expected(out, expected)


def with_expected(counts: DataFrame, expected: dict) -> DataFrame:
    """``(table_name, row_count)`` with the expected count and the status."""
    exp = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(int(v)))])
    e = F.element_at(exp, F.col("table_name"))
    return counts.withColumns({
        "expected_count": e,
        "status": F.when(F.col("row_count") == e, F.lit("OK")).otherwise(F.lit("MISMATCH")),
    })


def verify_against(tables: dict, expected: dict) -> DataFrame:
    """``verify_counts`` with the expected counts taken from other tables
    (the sources of a load) instead of known numbers, and the total and
    overall flag on every row.  ``expected`` maps a table name to the
    DataFrame whose rows it should have; one row per such table."""
    want = verify_counts(expected).withColumnRenamed("row_count", "expected_count")
    both = verify_counts({k: tables[k] for k in expected}).join(want, "table_name")
    status = F.when(F.col("row_count") == F.col("expected_count"), "OK").otherwise("MISMATCH")
    everything = Window.partitionBy()       # one row per verified table
    return (both.withColumn("status", status)
            .withColumns({"total_rows": F.sum("row_count").over(everything),
                          "all_ok": F.bool_and(F.col("status") == "OK").over(everything)})
            .orderBy("table_name"))


def verify_summary(verified: DataFrame) -> DataFrame:
    """Total rows and the overall flag of a ``verify_counts`` result."""
    return verified.agg(F.sum("row_count").alias("total_rows"),
                        F.bool_and(F.col("status") == "OK").alias("all_ok"))


# S1–S6 + S11 — the load job: every source table is read (declared schema
# when given), renamed, written as Parquet (full replace), and the written
# tables' row counts are verified.  Returns the verification DataFrame.
def load_tables(spark: SparkSession, sources: dict, out_root: str, fmt: str = "parquet",
                renames: dict | None = None, schemas: dict | None = None,
                partition_by: dict | None = None, expected: dict | None = None,
                **options) -> DataFrame:
    """``sources`` maps table name → input path.  ``renames`` maps table name
    → rename map (default: the flat model's maps); ``partition_by`` maps
    table name → partition columns.  Counts are taken from the written
    tables, as the published load reads its counts back from the store."""
    from parcelscope import schemas as S
    renames = S.FLAT_RENAMES if renames is None else renames
    written = {}
    for name, path in sources.items():
        df = read_table(spark, path, (schemas or {}).get(name), fmt, **options)
        target = f"{out_root.rstrip('/')}/{name}"
        write_table(rename(df, renames.get(name, {})), target,
                    partition_by=(partition_by or {}).get(name))
        written[name] = spark.read.parquet(target)
    return verify_counts(written, expected)
