"""M2 / J7 — insert-or-update by key without MERGE (Parquet tables).

``ON CONFLICT (keys) DO UPDATE SET c = EXCLUDED.c`` becomes one full outer
join on the keys: listed columns take the new value when the key arrives in
``updates``; every other column keeps the stored value when the key already
existed (so they can go stale, as in the published refresh).  The result is
a new DataFrame; write it to a new path or to the touched partitions —
never over a path it is still reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, updates: DataFrame, keys, update_cols,
           touch: dict | None = None) -> DataFrame:
    """Rows of ``target`` with ``updates`` applied.

    ``touch`` maps extra columns to a Column set on updated *and* inserted
    rows (e.g. ``{"refreshed_at": F.current_timestamp()}``).  A key that
    occurs twice in ``updates`` is an error, as in the published form.
    """
    keys = list(keys)
    update_cols = set(update_cols)
    touch = touch or {}
    t = target.withColumn("_in_t", F.lit(True))
    rest = [c for c in updates.columns if c not in keys]
    once = F.when(F.count(F.lit(1)) == 1, F.first(F.struct(F.lit(True).alias("_in_u"), *rest))).otherwise(
        F.raise_error(F.lit(f"upsert: a key ({', '.join(keys)}) occurs more than once in the updates")))
    u = updates.groupBy(*keys).agg(once.alias("_u")).select(*keys, "_u.*")
    j = t.alias("t").join(u.alias("u"), keys, "full_outer")
    in_t, in_u = F.col("t._in_t").isNotNull(), F.col("u._in_u").isNotNull()

    def pick(c: str) -> Column:
        if c in touch:
            return F.when(in_u, touch[c]).otherwise(F.col(f"t.{c}"))
        new = F.col(f"u.{c}") if c in updates.columns else F.lit(None)
        if c in update_cols:
            return F.when(in_u, new).otherwise(F.col(f"t.{c}"))
        return F.when(in_t, F.col(f"t.{c}")).otherwise(new)

    cols = [F.col(k) for k in keys] + [pick(c).cast(target.schema[c].dataType).alias(c)
                                       for c in target.columns if c not in keys]
    return j.select(*cols)


def upsert_counts(target: DataFrame, updates: DataFrame, keys) -> DataFrame:
    """Rows the upsert would insert and update (for the audit log)."""
    keys = list(keys)
    t = target.select(*keys).withColumn("_in_t", F.lit(1))
    u = updates.select(*keys)
    j = u.join(t, keys, "left")
    return j.agg(F.count_if(F.col("_in_t").isNull()).alias("rows_inserted"),
                 F.count_if(F.col("_in_t").isNotNull()).alias("rows_updated"))
