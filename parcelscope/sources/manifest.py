"""Committed versions of stored tables.

A load writes each table to a folder of its own, ``<root>/<table>/load_id=...``,
and then commits one small row per table to ``<root>/manifest``: the folders
and partition values that make up the version, row counts, high-water marks
and the fingerprint of the sources.  Readers take the newest committed row, so
a load that fails or is killed leaves nothing that anyone reads, all tables
of a load appear at once (their rows are one file), and folders are never
changed after the commit.  A version may refer to folders of earlier loads:
an incremental load or a refresh writes the partitions it touches and keeps
the others where they are.

Only manifest rows pass through the driver: one per table, with one entry per
partition of the table.
"""

from __future__ import annotations

import datetime
import json
import uuid
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelscope.session import path_exists

MANIFEST = T.StructType([
    T.StructField("load_id", T.StringType()), T.StructField("parent_id", T.StringType()),
    T.StructField("table_name", T.StringType()), T.StructField("load_type", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("row_count", T.LongType()), T.StructField("partition_column", T.StringType()),
    T.StructField("parts", T.ArrayType(T.StructType([
        T.StructField("load_id", T.StringType()), T.StructField("value", T.StringType()),
        T.StructField("row_count", T.LongType())]))),
    T.StructField("marks", T.MapType(T.StringType(), T.StringType())),
    T.StructField("committed_at", T.TimestampType()),
])


def new_id() -> str:
    """Load ids sort by time, so equal commit times still have an order."""
    return f"{datetime.datetime.now(datetime.timezone.utc):%Y%m%dT%H%M%S%f}x{uuid.uuid4().hex[:8]}"


def literal_rows(spark: SparkSession, schema: T.StructType, rows: list) -> DataFrame:
    """A few rows (tuples in the order of ``schema``) as one literal of the
    plan, without a Python process."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

    def plain(v):
        return v.isoformat(timespec="microseconds") if isinstance(v, datetime.datetime) else v

    text = json.dumps([dict(zip(schema.fieldNames(), map(plain, r))) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), T.ArrayType(schema), {"timestampFormat": stamp})))


@dataclass
class Commit:
    """One row of the manifest, as a load fills it in."""
    load_id: str
    table_name: str
    load_type: str
    row_count: int
    parts: list                      # (load_id, partition value, rows)
    parent_id: str | None = None
    source: str = ""
    fingerprint: str = ""
    partition_column: str | None = None
    marks: dict = field(default_factory=dict)

    def row(self, at: datetime.datetime) -> tuple:
        return (self.load_id, self.parent_id, self.table_name, self.load_type, self.source, self.fingerprint,
                self.row_count, self.partition_column,
                [dict(zip(("load_id", "value", "row_count"), p)) for p in self.parts], self.marks, at)


class Catalog:
    """Committed tables under one root folder (any file system Spark writes)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def folder(self, table: str, load_id: str) -> str:
        return f"{self.root}/{table}/load_id={load_id}"

    @property
    def manifest_path(self) -> str:
        return f"{self.root}/manifest"

    # --- commits --------------------------------------------------------
    def commits(self) -> DataFrame:
        """Every committed row; no rows where nothing was committed yet."""
        if not path_exists(self.spark, self.manifest_path):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(self.manifest_path)

    def newest(self, where: Column | None = None) -> dict[str, Row]:
        """Newest commit per table."""
        if not path_exists(self.spark, self.manifest_path):
            return {}
        rows = self.commits() if where is None else self.commits().filter(where)
        best = rows.groupBy("table_name").agg(
            F.max_by(F.struct(*MANIFEST.fieldNames()), F.struct("committed_at", "load_id")).alias("c"))
        return {r.table_name: r.c for r in best.collect()}

    def commit(self, commits: list[Commit]) -> None:
        """Make a load visible: its rows go into one file."""
        at = datetime.datetime.now(datetime.timezone.utc)
        (literal_rows(self.spark, MANIFEST, [c.row(at) for c in commits])
         .write.mode("append").parquet(self.manifest_path))

    def since(self, table: str, base: str | None) -> list[str] | None:
        """Ids of the loads after ``base`` that lead to the newest commit of
        ``table``, oldest first; None where ``base`` is not among its
        ancestors or a full load lies between."""
        rows = {r.load_id: r for r in self.commits().filter(F.col("table_name") == table)
                .select("load_id", "parent_id", "load_type").collect()}
        newest = self.newest(F.col("table_name") == table).get(table)
        at, found = None if newest is None else newest.load_id, []
        while at is not None and at != base:
            found.append(at)
            at = None if rows[at].load_type == "FULL" else rows[at].parent_id
        return found[::-1] if at == base and at is not None else None

    # --- tables ---------------------------------------------------------
    def read(self, commit: Row | None, schema: T.StructType, values=None) -> DataFrame:
        """The rows of a committed version with the declared ``schema``: no
        inference, partition columns from the folders, filters pruned.
        ``values`` keeps these partition values only."""
        if commit is None or not commit.parts:
            return self.spark.createDataFrame([], schema)
        key = commit.partition_column
        parts = [p for p in commit.parts if values is None or p.value in values]
        if not parts:
            return self.spark.createDataFrame([], schema)
        loads: dict[str, list] = {}
        for p in parts:
            loads.setdefault(p.load_id, []).append(p.value)
        base = f"{self.root}/{commit.table_name}"
        checked = "rejected" in commit.marks
        extra = [T.StructField("load_id", T.StringType())] + [T.StructField("rejected", T.BooleanType())] * checked
        full = T.StructType([*schema.fields, *extra])
        df = (self.spark.read.schema(full).option("basePath", base)
              .parquet(*[self.folder(commit.table_name, x) for x in loads]))
        # a load's own version is all of its folder
        if key is not None and (set(loads) != {commit.load_id} or values is not None):
            def kept(load: str, own: list) -> Column:
                some = F.col(key).cast("string").isin([v for v in own if v is not None])
                return (F.col("load_id") == load) & (some | F.col(key).isNull() if None in own else some)
            df = df.filter(reduce(or_, [kept(load, own) for load, own in loads.items()]))
        if checked:
            df = df.filter(~F.col("rejected"))
        return df.select(*schema.fieldNames())

    def rejected(self, table: str, schema: T.StructType) -> DataFrame:
        """Rows that loads of ``table`` left out, with their reasons."""
        full = T.StructType([*schema.fields, T.StructField("reject_reasons", T.ArrayType(T.StringType())),
                             T.StructField("load_id", T.StringType()), T.StructField("rejected", T.BooleanType())])
        return (self.spark.read.schema(full).parquet(f"{self.root}/{table}").filter("rejected")
                .select(*schema.fieldNames(), "reject_reasons", "load_id"))

    def parts_of(self, table: str, load_id: str, partition_column: str, schema: T.StructType,
                 rejected: bool = False) -> list:
        """Partition values a load wrote for ``table`` and their rows: folder
        names and file footers, no column is read."""
        full = T.StructType([*schema.fields] + [T.StructField("rejected", T.BooleanType())] * rejected)
        df = self.spark.read.schema(full).parquet(self.folder(table, load_id))
        rows = ((df.filter(~F.col("rejected")) if rejected else df)
                .groupBy(F.col(partition_column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).collect())
        return sorted(((load_id, r.v, r.n) for r in rows), key=lambda p: p[1] or "")

    def replaced(self, commit: Row | None, new_parts: list, values) -> list:
        """Parts of the next version: ``new_parts`` in place of those with one
        of ``values``, the others as they are."""
        fresh = set(values) | {v for _, v, _ in new_parts}
        old = [] if commit is None else [(p.load_id, p.value, p.row_count) for p in commit.parts if p.value not in fresh]
        return sorted(old + new_parts, key=lambda p: p[1] or "")


def fingerprint(spark: SparkSession, paths: dict) -> str:
    """Names, sizes and times of the files under each path, as one text: what
    changes when a source does.  Files are listed, their content is not read."""
    files = [spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
             .load(path).select(F.lit(name).alias("t"), "path", "length", "modificationTime")
             for name, path in sorted(paths.items())]
    seen = reduce(DataFrame.unionByName, files).coalesce(spark.sparkContext.defaultParallelism)
    one = F.xxhash64("t", "path", "length", "modificationTime")
    r = seen.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.bit_xor(one).alias("x"),
                 F.sum(F.pmod(one, F.lit(1_000_003))).alias("s")).first()
    return f"{r.n}-{r['size']}-{r.x}-{r.s}"
