"""Data quality and load audit (M4–M10).

Parquet tables enforce no PRIMARY KEY, CHECK or REFERENCES, so the
constraints of the published schema become checks that run as ordinary
Spark jobs:

* row rules (NOT NULL, domain, range) — all rules of a table are counted in
  ONE aggregation pass (``rule_report``); a rule whose predicate is NULL
  passes, as a SQL CHECK does;
* uniqueness — ``groupBy(keys).count()`` with map-side partial counts, so a
  hot key costs one partial row per task, never a whole group in one task;
* references — ``left_anti`` against the parent keys, or hit flags for all
  keys of a table at once; Spark broadcasts small parents by their bytes.
"""

from __future__ import annotations

import datetime
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelscope.functions import derive


@dataclass(frozen=True)
class Rule:
    name: str          # check kind: not_null / domain / range / custom
    column: str
    ok: Column         # predicate that holds for a valid row


# M4
def not_null(*cols) -> list[Rule]:
    return [Rule("not_null", c, F.col(c).isNotNull()) for c in cols]


# M5 — NULL passes (CHECK semantics); NOT NULL is a separate rule
def domain(col: str, values) -> Rule:
    return Rule("domain", col, F.col(col).isin(list(values)))


# M6 / F10 — BETWEEN-style bounds
def in_range(col: str, lo=None, hi=None, lo_inclusive=True) -> Rule:
    c = F.col(col)
    ok = F.lit(True)
    if lo is not None:
        ok = ok & ((c >= lo) if lo_inclusive else (c > lo))
    if hi is not None:
        ok = ok & (c <= hi)
    return Rule("range", col, ok)


def rule_report(df: DataFrame, rules: list[Rule], table: str = "") -> DataFrame:
    """One row per rule: table, check, column, rows failing it (one pass)."""
    agg = df.agg(*[F.count_if(~r.ok).alias(f"_r{i}") for i, r in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(r.name).alias("check_name"), F.lit(r.column).alias("column_name"),
                              F.col(f"_r{i}").alias("failed_rows")) for i, r in enumerate(rules)])
    return agg.select(F.lit(table).alias("table_name"), F.inline(rows))


# M7
def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys occurring more than once, with their multiplicity.  A key with a
    NULL in it is never a duplicate, as in a SQL UNIQUE constraint."""
    keys = list(keys)
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def check_unique(df: DataFrame, keys, table: str = "") -> DataFrame:
    """One row: number of duplicated keys and of rows carrying one."""
    keys = list(keys)
    d = duplicate_keys(df, keys)
    return d.agg(F.count(F.lit(1)).alias("duplicate_keys"),
                 F.coalesce(F.sum("occurrences"), F.lit(0)).cast("bigint").alias("rows_with_duplicate_key")
                 ).select(F.lit(table).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"),
                          "duplicate_keys", "rows_with_duplicate_key")


# M8
def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-NULL ``key`` has no parent row (FK violation)."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")


def check_reference(child: DataFrame, parent: DataFrame, key: str, child_name: str = "",
                    parent_name: str = "") -> DataFrame:
    return (orphans(child, parent, key).agg(F.count(F.lit(1)).alias("orphan_rows"))
            .select(F.lit(child_name).alias("child_table"), F.lit(parent_name).alias("parent_table"),
                    F.lit(key).alias("key_column"), "orphan_rows"))


def check_references(child: DataFrame, refs, child_name: str = "") -> DataFrame:
    """All foreign keys of one child table; one row per key, like
    ``check_reference``.  ``refs`` holds ``(parent, key, parent_name)``.  One
    pass over the child: its distinct key combinations with their counts (a
    map-side partial aggregate), each parent's keys joined as a hit flag,
    and one aggregate of the misses."""
    keys = list(dict.fromkeys(k for _, k, _ in refs))
    tagged = child.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    for i, (parent, key, _) in enumerate(refs):
        hit = parent.select(key).distinct().withColumn(f"_hit{i}", F.lit(True))
        tagged = tagged.join(hit, key, "left")
    agg = tagged.agg(*[F.coalesce(F.sum(F.when(F.col(k).isNotNull() & F.col(f"_hit{i}").isNull(), F.col("_n"))),
                                  F.lit(0)).cast("bigint").alias(f"_o{i}") for i, (_, k, _) in enumerate(refs)])
    rows = F.array(*[F.struct(F.lit(child_name).alias("child_table"), F.lit(n).alias("parent_table"),
                              F.lit(k).alias("key_column"), F.col(f"_o{i}").alias("orphan_rows"))
                     for i, (_, k, n) in enumerate(refs)])
    return agg.select(F.inline(rows))


# M9
def tag_rejects(df: DataFrame, rules: list[Rule], unique_keys=None,
                references: list[tuple[DataFrame, str]] | None = None) -> DataFrame:
    """``df`` plus ``reject_reasons`` (array, empty for a valid row).

    Uniqueness is judged from the duplicated-key aggregate joined back (no
    window over a key); references from a flag joined from the parent keys.
    """
    tagged = df
    fine = F.lit("")        # not null: rows are checked in generated code, without a lambda over the reasons
    reasons = [F.when(~r.ok, F.lit(f"{r.name}:{r.column}")).otherwise(fine) for r in rules]
    if unique_keys:
        keys = list(unique_keys)
        dup = duplicate_keys(df, keys).select(*keys, F.lit(True).alias("_dup"))
        tagged = tagged.join(dup, keys, "left")
        reasons.append(F.when(F.col("_dup"), F.lit("duplicate:" + ",".join(keys))).otherwise(fine))
    for i, (parent, key) in enumerate(references or []):
        flag = f"_ref{i}"
        pk = parent.select(key).distinct().withColumn(flag, F.lit(True))
        tagged = tagged.join(pk, key, "left")
        reasons.append(F.when(F.col(key).isNotNull() & F.col(flag).isNull(), F.lit("orphan:" + key)).otherwise(fine))
    tagged = tagged.withColumn("reject_reasons", F.array_remove(F.array(*reasons), ""))
    helper = [c for c in tagged.columns if c.startswith("_dup") or c.startswith("_ref")]
    return tagged.drop(*helper)


def reason_labels(rules: list[Rule], unique_keys=None,
                  references: list[tuple[DataFrame, str]] | None = None) -> list[str]:
    """Every label ``tag_rejects`` can put in ``reject_reasons``, in order."""
    labels = [f"{r.name}:{r.column}" for r in rules]
    if unique_keys:
        labels.append("duplicate:" + ",".join(unique_keys))
    labels += ["orphan:" + key for _, key in references or []]
    return list(dict.fromkeys(labels))


def outcome_counts(tagged: DataFrame, labels: list[str]) -> DataFrame:
    """Rows per outcome — 'valid', 'rejected' and each reason that occurs —
    as ONE global aggregate of conditional counts (no per-row explode, no
    keyed shuffle), turned into rows with ``inline``."""
    r = F.col("reject_reasons")
    counts = [("valid", F.count_if(F.size(r) == 0)), ("rejected", F.count_if(F.size(r) > 0))]
    counts += [(label, F.count_if(F.array_contains(r, label))) for label in labels]
    agg = tagged.agg(*[c.alias(f"_c{i}") for i, (_, c) in enumerate(counts)])
    rows = F.array(*[F.struct(F.lit(label).alias("reason"), F.col(f"_c{i}").alias("rows"))
                     for i, (label, _) in enumerate(counts)])
    return agg.select(F.inline(rows)).filter(F.col("rows") > 0)


def outcome_counts_by_key(df: DataFrame, rules: list[Rule], unique_keys, parent: DataFrame,
                          parent_key: str) -> DataFrame:
    """``outcome_counts`` of ``tag_rejects(df, rules, unique_keys, [(parent,
    parent_key)])`` without tagging a row: ``df`` is read once and
    aggregated to its unique keys (a repeated key is a count over one), these
    sums together with the parent's keys to ``parent_key`` (no parent row: an
    orphan), and those to the one result.  A broken rule does not depend on
    the keys: it is a row without keys, by the rule's number, beside the row's
    own, so that a key has two sums to keep and not one per rule.  Every step
    sums map-side first, so a hot order, or a line that is there a million
    times, is one row per task; there is no join and no window.
    ``parent_key`` is one of ``unique_keys``."""
    keys = list(unique_keys)
    own = -1        # the number of a row that stands for itself
    label = {i: f"{r.name}:{r.column}" for i, r in enumerate(rules)}
    numbers = F.array(*[F.when(~r.ok, i).otherwise(own) for i, r in enumerate(rules)])      # a NULL check passes
    checked = df.select(*keys, F.array_remove(numbers, own).alias("broken"))
    each = checked.select(*keys, (F.size("broken") == 0).alias("ok"),
                          F.explode_outer(F.concat(F.array(F.lit(own)), "broken")).alias("rule"))
    per_key = (each.select(*[F.when(F.col("rule") == own, F.col(k)).alias(k) for k in keys], "rule", "ok")
               .groupBy(*keys, "rule").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("fine")))
    repeated = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], (F.col("rule") == own) & (F.col("n") > 1))
    sums = ["n", "fine", "again"]
    lines = per_key.select(parent_key, "rule", "n", F.when(repeated, 0).otherwise(F.col("fine")).cast("bigint").alias("fine"),
                           F.when(repeated, F.col("n")).otherwise(0).cast("bigint").alias("again"), F.lit(0).alias("known"))
    marks = parent.select(F.col(parent_key), F.lit(own).alias("rule"), *[F.lit(0).cast("bigint").alias(c) for c in sums],
                          F.lit(1).alias("known"))
    per_parent = lines.unionByName(marks).groupBy(parent_key, "rule").agg(
        *[F.sum(c).alias(c) for c in sums], F.max("known").alias("known"))
    row = F.col("rule") == own
    orphan = row & F.col(parent_key).isNotNull() & (F.col("known") == 0)

    def total(where: Column, c: str) -> Column:
        return F.sum(F.when(where, F.col(c)).otherwise(0))

    totals = per_parent.agg(total(row & ~orphan, "fine").alias("valid"), total(orphan, "n").alias("orphan"),
                            total(row, "n").alias("n"), F.sum("again").alias("again"),
                            *[total(F.col("rule") == i, "n").alias(f"r{i}") for i in label])
    outcomes = [("valid", F.col("valid")), ("rejected", F.col("n") - F.col("valid")),
                *[(label[i], F.col(f"r{i}")) for i in label],
                ("duplicate:" + ",".join(keys), F.col("again")), ("orphan:" + parent_key, F.col("orphan"))]
    rows = F.array(*[F.struct(F.lit(k).alias("reason"), c.cast("bigint").alias("rows")) for k, c in outcomes])
    return totals.select(F.inline(rows)).filter(F.col("rows") > 0)


def split_valid(df: DataFrame, rules: list[Rule], unique_keys=None,
                references: list[tuple[DataFrame, str]] | None = None):
    """(valid, rejected); every input row lands in exactly one of them and
    ``rejected`` carries ``reject_reasons``."""
    tagged = tag_rejects(df, rules, unique_keys, references)
    bad = F.size("reject_reasons") > 0
    return tagged.filter(~bad).drop("reject_reasons"), tagged.filter(bad)


def validation_counts(tagged: DataFrame) -> DataFrame:
    """One row: ``rows_inserted`` (valid) and ``rows_rejected``, one pass."""
    bad = F.size("reject_reasons") > 0
    return tagged.agg(F.count_if(~bad).alias("rows_inserted"), F.count_if(bad).alias("rows_rejected"))


def reject_summary(rejected: DataFrame) -> DataFrame:
    """Rejected rows per reason (a row with two reasons counts in both)."""
    return (rejected.select(F.explode("reject_reasons").alias("reason"))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("rejected_rows")))


# M10 — audit rows; Parquet rows are not updated in place, so a load
# appends a RUNNING row at start and a final row at the end
def audit_rows(counts: DataFrame, table_name: str, load_type: str = "FULL",
               status: str = "SUCCESS", start=None, end=None, error: str | None = None,
               loaded_by: str = "parcelscope", load_id: str | None = None) -> DataFrame:
    """Audit row(s) built from a DataFrame of counts (columns
    ``rows_inserted``, optional ``rows_updated``, ``rows_rejected``) — the
    counts stay in Spark, nothing is collected."""
    start_c = F.current_timestamp() if start is None else F.lit(start).cast("timestamp")
    end_c = F.current_timestamp() if end is None else F.lit(end).cast("timestamp")

    def opt(c):
        return F.col(c).cast("bigint") if c in counts.columns else F.lit(0).cast("bigint")

    return counts.select(
        F.lit(table_name).alias("table_name"), F.lit(load_type).alias("load_type"),
        opt("rows_inserted").alias("rows_inserted"), opt("rows_updated").alias("rows_updated"),
        opt("rows_rejected").alias("rows_rejected"),
        start_c.alias("start_time"), end_c.alias("end_time"),
        derive.duration_seconds(start_c, end_c).alias("duration_seconds"),
        F.lit(status).alias("status"), F.lit(error).cast("string").alias("error_message"),
        F.lit(loaded_by).alias("loaded_by"), F.lit(load_id).cast("string").alias("load_id"))


def log_load(audit: DataFrame, path: str) -> None:
    """Append audit rows to the audit table at ``path``."""
    audit.write.mode("append").parquet(path)


class Audit:
    """Counts of a running load, set by the load itself."""
    counts: DataFrame | None = None


@contextmanager
def audited(spark: SparkSession, path: str | None, table_name: str, load_type: str):
    """Status life cycle of a load (M10): a RUNNING row when it starts, then
    a SUCCESS row with ``Audit.counts`` or a FAILED row with the error.
    Without a path nothing is logged."""
    audit, start = Audit(), datetime.datetime.now(datetime.timezone.utc)
    none = spark.range(1).select(F.lit(0).cast("bigint").alias("rows_inserted")) if path else None
    if path:
        log_load(audit_rows(none, table_name, load_type, "RUNNING", start=start, end=start), path)
    try:
        yield audit
    except Exception as error:
        if path:
            log_load(audit_rows(none, table_name, load_type, "FAILED", start=start,
                                error=f"{type(error).__name__}: {error}"[:1000]), path)
        raise
    if path:
        log_load(audit_rows(none if audit.counts is None else audit.counts, table_name, load_type, "SUCCESS",
                            start=start), path)


def latest_status(log: DataFrame) -> DataFrame:
    """Newest audit row per table (RUNNING rows are superseded by the end row)."""
    from pyspark.sql import Window
    w = Window.partitionBy("table_name").orderBy(F.desc("start_time"), F.desc("end_time"))
    return log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def union_all(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
