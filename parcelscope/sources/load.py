"""Load runs: validated writes of tables, their log and their commit.

``Load`` is one run (M10).  On entry it logs a RUNNING row for each of its
tables, on success it commits all of them at once and logs SUCCESS rows with
the counts, on an error it logs FAILED rows and commits nothing.  Rows a
killed run left RUNNING are closed as FAILED by a later run.

Row rules (M4-M6, M9) are checked while a table is written: rows that break
one go to the partition ``rejected=true`` of the same write, with their
reasons, so nothing is derived twice.  Counts and high-water marks are
observed in that pass too.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelscope import schemas as S
from parcelscope.functions import derive
from parcelscope.operators import quality as Q
from parcelscope.session import path_exists
from parcelscope.sources import ingest
from parcelscope.sources.manifest import Catalog, Commit, literal_rows, new_id

AUDIT_LOG = "audit_load_log"
Part = Row("load_id", "value", "row_count")
STALE_AFTER = datetime.timedelta(days=1)
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
DEALT_SIZE = "24m"
# A written table is read from its files: what its joins and sorts shuffled
# goes with the write, not when the driver next collects its garbage.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# Good and refused rows have a writer each, so no task sorts its rows by that;
# Spark sorts the rest of a task's rows once as many writers as this are open.
BOTH_WRITERS = {"spark.sql.maxConcurrentOutputFileWriters": "3"}


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc)


def load_log(catalog: Catalog) -> DataFrame:
    return ingest.read_table(catalog.spark, f"{catalog.root}/{AUDIT_LOG}", S.AUDIT_LOAD_LOG)


def _log(catalog: Catalog, rows: list) -> None:
    """Append log rows ``(table, type, inserted, updated, rejected, start,
    end, status, error, load_id)``."""
    names = [f for f in S.AUDIT_LOAD_LOG.fieldNames() if f not in ("duration_seconds", "loaded_by")]
    given = literal_rows(catalog.spark, T.StructType([S.AUDIT_LOAD_LOG[n] for n in names]), rows)
    (given.withColumns({"duration_seconds": derive.duration_seconds(), "loaded_by": F.lit("parcelscope")})
     .select(*S.AUDIT_LOAD_LOG.fieldNames()).write.mode("append").parquet(f"{catalog.root}/{AUDIT_LOG}"))


def recover(catalog: Catalog, stale_after: datetime.timedelta = STALE_AFTER) -> int:
    """Close the log of runs that were killed: their newest row of a table is
    RUNNING, began ``stale_after`` ago or earlier and was never committed.
    Returns how many rows were closed."""
    if not path_exists(catalog.spark, f"{catalog.root}/{AUDIT_LOG}"):
        return 0
    newest = load_log(catalog).groupBy("load_id", "table_name", "load_type").agg(
        F.max_by("status", F.struct("end_time", F.col("status") != "RUNNING")).alias("status"),
        F.min("start_time").alias("start_time"))
    open_ = (newest.filter((F.col("status") == "RUNNING") & (F.col("start_time") <= F.lit(_now() - stale_after)))
             .join(catalog.commits().select("load_id").distinct(), "load_id", "left_anti"))
    rows = [(r.table_name, r.load_type, 0, 0, 0, r.start_time, _now(), "FAILED", "run ended without a commit", r.load_id)
            for r in open_.collect()]           # tables of killed runs
    if rows:
        _log(catalog, rows)
    return len(rows)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings of one write; those that the job names stay."""
    wanted = {k: v for k, v in wanted.items() if spark.conf.get(k, None) is None}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in wanted:
            spark.conf.unset(k)


def smaller_partitions(spark: SparkSession, size: str = DEALT_SIZE):
    """Shuffled source columns are dense: at Spark's own size a task sorts
    more rows than its memory holds.  A size that the job names stays."""
    return settings(spark, {ADVISORY: size})


class Load:
    def __init__(self, catalog: Catalog, load_type: str, tables, source: str = "", fingerprint: str = "",
                 stale_after: datetime.timedelta = STALE_AFTER, parents: dict | None = None):
        self.parents = parents          # newest commits, if the caller has just read them
        self.catalog, self.load_type, self.tables = catalog, load_type, list(tables)
        self.source, self.fingerprint, self.stale_after = source, fingerprint, stale_after
        self.load_id, self.commits, self.rows = new_id(), [], {}

    def __enter__(self) -> Load:
        if self.parents is None:
            recover(self.catalog, self.stale_after)
            self.parents = self.catalog.newest()
        self.start = _now()
        _log(self.catalog, [(t, self.load_type, 0, 0, 0, self.start, self.start, "RUNNING", None, self.load_id)
                            for t in self.tables])
        return self

    def __exit__(self, kind, error, trace) -> bool:
        if error is not None:
            said = f"{type(error).__name__}: {error}"[:1000]
            _log(self.catalog, [(t, self.load_type, 0, 0, 0, self.start, _now(), "FAILED", said, self.load_id)
                                for t in self.tables])
            return False
        if self.commits:
            self.catalog.commit(self.commits)
        _log(self.catalog, [(t, self.load_type, *self.rows.get(t, (0, 0, 0)), *self.times.get(t, (self.start, _now())),
                             "SUCCESS", None, self.load_id) for t in self.tables])
        return False

    def _observed(self, seen: Observation, folder: str, schema: T.StructType, marks) -> dict:
        """The counts and marks of a write.  Where nothing is written Spark
        may drop the observation with the empty plan."""
        try:
            return seen.get
        except Py4JJavaError:
            if self.catalog.spark.read.schema(schema).parquet(folder).isEmpty():
                return {"rows": 0, "bad": 0, **{f"mark_{k}": None for k in marks or {}}}
            raise

    def by_table(self) -> dict[str, Row]:
        """The run's commits so far, in the form the catalog reads."""
        return {c.table_name: Row(**{k: [Part(*p) for p in v] if k == "parts" else v for k, v in vars(c).items()})
                for c in self.commits}

    @property
    def times(self) -> dict:
        return self.__dict__.setdefault("_times", {})

    def write(self, name: str, df: DataFrame, schema: T.StructType, partition: str | None = None,
              sort_within: list | None = None, rules: list | None = None, marks: dict[str, Column] | None = None,
              replaces: list | None = None, adds: bool = False, updated: int = 0, small: bool = False,
              folders: bool = True, derive: Callable | None = None, as_read: bool = False) -> Commit:
        """Write one table of the run and note its commit.

        ``marks`` maps names to aggregates over the valid rows.  The new rows
        replace the parent version, or only its partitions of the values
        ``replaces``, or are added to it (``adds``).  ``updated`` of the
        written rows are logged as updates.  ``small`` tables of many
        partitions are dealt to tasks by partition, large ones rebalanced by
        size.  Without ``folders`` a small table's partitions are not folders
        but sorted runs of its file; versions still refer to each of them.
        With ``derive`` (see ``Staged``) ``df`` has a partitioned table's
        source columns: these are shuffled and sorted, and the table's rows
        exist only where they are written.  Rows ``as_read`` are written by the
        tasks that read them, without a shuffle."""
        began, folder = _now(), self.catalog.folder(name, self.load_id)
        source = df.columns
        if derive:
            dealt = derive(df, source).select(*source, partition).hint("rebalance", partition)
            df = derive(dealt, dealt.columns)
        good = F.lit(True)
        if rules:
            df = Q.tag_rejects(df, rules).withColumn("rejected", F.size("reject_reasons") > 0)
            good = ~F.col("rejected")
        seen = Observation(f"{name}-{self.load_id}")
        df = df.observe(seen, F.count_if(good).alias("rows"), F.count_if(~good).alias("bad"),
                        *[F.max(F.when(good, c)).cast("string").alias(f"mark_{k}") for k, c in (marks or {}).items()])
        by = (["rejected"] if rules else []) + ([partition] if partition and folders else [])
        if partition and not folders:
            df = df.hint("rebalance").sortWithinPartitions(partition)
        if derive:
            kept = [*by, *(c for c in sort_within or [] if c not in by), *["reject_reasons"] * bool(rules)]
            run = df.select(*source, *kept).sortWithinPartitions(*by, *(sort_within or []))
            df = derive(run, kept).select(*schema.fieldNames(), *(c for c in kept if c not in schema.fieldNames()))
        wanted = FREED | ({ADVISORY: DEALT_SIZE} if derive else {}) | (BOTH_WRITERS if as_read else {})
        with settings(self.catalog.spark, wanted):
            ingest.write_table(df, folder, partition_by=by or None, sort_within=sort_within,
                               dealt=bool(derive) or as_read, tasks=self.catalog.spark.sparkContext.defaultParallelism if small else None)
        found = self._observed(seen, folder, schema, marks)
        parent = self.parents.get(name)
        if partition is None:
            parts = [(self.load_id, None, found["rows"])]
        else:
            parts = self.catalog.parts_of(name, self.load_id, partition, schema, rejected=bool(rules))
        kept = parent is not None and (adds or replaces is not None)
        if kept:
            parts = (sorted([tuple(p) for p in parent.parts] + parts, key=lambda p: p[1] or "") if adds else
                     self.catalog.replaced(parent, parts, replaces))
        noted = dict(parent.marks) if kept else {}
        for k in marks or {}:
            new = found[f"mark_{k}"]
            noted[k] = max(x for x in (noted.get(k), new) if x is not None) if new is not None else noted.get(k)
        if rules:
            noted["rejected"] = str(found["bad"])
        commit = Commit(self.load_id, name, self.load_type, sum(n for _, _, n in parts), parts,
                        None if parent is None else parent.load_id, self.source, self.fingerprint, partition,
                        {k: v for k, v in noted.items() if v is not None})
        self.commits.append(commit)
        self.rows[name] = (found["rows"] - updated, updated, found["bad"])
        self.times[name] = (began, _now())
        return commit
