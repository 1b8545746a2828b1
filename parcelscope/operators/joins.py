"""Join patterns of the KPI queries.

* ``star`` — fact joined to the dimensions a query needs (inner equi-joins,
  unmatched facts drop out; ``keep`` names dimensions whose unmatched facts
  stay).  No hint: Spark broadcasts a dimension whose bytes fit
  ``spark.sql.autoBroadcastJoinThreshold`` and AQE re-plans or splits the
  join of a larger one.
* ``top1_per_group`` — the rewrite of a correlated ``ORDER BY … LIMIT 1``
  subquery: rank pre-aggregated rows inside each group.
* ``latest_only`` — ``WHERE d = (SELECT MAX(d) FROM t)``; the maximum is the
  one the load noted, or a scalar subquery (no cross join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# columns each dimension contributes and its join key
DIM_KEYS = {
    "dim_date": "date_key",
    "dim_postcode": "postcode_pc4",
    "dim_warehouse": "warehouse_id",
    "dim_product_category": "category_id",
}


def star(model, fact_cols=None, where: Column | None = None, keep=(), **dim_cols) -> DataFrame:
    """J1 / J2 / J3 — fact ⋈ selected dimensions.

    ``star(m, ["route_km"], dim_date=["year_month"], dim_postcode=["city"])``
    joins on each dimension's key; a dimension column replaces a fact
    column of the same name (the query reads the dimension's value).  A
    ``(column, alias)`` pair renames a dimension column.  ``where`` filters
    the fact before the joins (e.g. on its partition column).  Dimensions in
    ``keep`` are left-joined: a fact without a match stays, with NULLs.
    """
    fact = model.fact_deliveries
    if where is not None:
        fact = fact.filter(where)
    wanted_from_dims = {c if isinstance(c, str) else c[1] for cols in dim_cols.values() for c in cols}
    keys = [DIM_KEYS[d] for d in dim_cols]
    if fact_cols is None:
        fact_cols = [c for c in fact.columns if c not in wanted_from_dims]
    cols = list(dict.fromkeys([*keys, *[c for c in fact_cols if c not in wanted_from_dims]]))
    out = fact.select(*cols)
    for dim, dcols in dim_cols.items():
        key = DIM_KEYS[dim]
        d = model.tables[dim].select(key, *[F.col(c) if isinstance(c, str) else F.col(c[0]).alias(c[1])
                                         for c in dcols if c != key])
        out = out.join(d, key, "left" if dim in keep else "inner")
    return out


def day_zone_rollup(model, partials, group_by, dim_date=(), dim_postcode=(), by=()) -> DataFrame:
    """Eager aggregation below the star joins: the fact is aggregated to
    additive ``partials`` per (``date_key``, ``postcode_pc4``) — at most
    calendar days × zones rows, however many shipments — then those rows are
    joined to the date and zone attributes and summed again per
    ``group_by``.  Equal to joining every shipment first (the attributes
    are functions of the keys, sums and counts are additive); each re-summed
    column is cast back to the type a single ``sum`` gives, so divisions and
    roundings downstream see the same decimals.  ``by`` names flags of the
    shipment itself that are grouped as well."""
    keys = ["date_key", "postcode_pc4", *by]
    g = model.fact_deliveries.groupBy(*keys).agg(*partials)
    names = [c for c in g.columns if c not in keys]
    fields = {f.name: f for f in g.schema.fields}
    if dim_date:
        g = g.join(model.tables["dim_date"].select("date_key", *dim_date), "date_key")
    if dim_postcode:
        g = g.join(model.tables["dim_postcode"].select("postcode_pc4", *dim_postcode), "postcode_pc4")

    def resum(c):   # a non-nullable partial (a row count) stays non-nullable
        total = F.sum(c) if fields[c].nullable else F.coalesce(F.sum(c), F.lit(0))
        return total.cast(fields[c].dataType).alias(c)

    return g.groupBy(*group_by).agg(*[resum(c) for c in names])


def per_zone(model, aggs, where: Column | None = None, attrs=None,
             flat: bool = False) -> DataFrame:
    """Eager aggregation for zone-grain queries: aggregate the fact by its
    zone key (a short integer) first, then join the few aggregated rows to
    the zone attributes ``attrs``.  Equal to joining every shipment to the
    zone and grouping by the zone's columns (they are functions of the key),
    but the per-row work is one integer-keyed partial aggregate — no
    per-row join probe, no string grouping keys.  ``flat`` takes the
    attributes from the flat model (locker flag 'Yes'/'No')."""
    fact = model.fact_deliveries if where is None else model.fact_deliveries.filter(where)
    g = fact.groupBy("postcode_pc4").agg(*aggs)
    zones = model.flat_postcodes if flat else model.tables["dim_postcode"]
    return g.join(zones.select("postcode_pc4", *(attrs or [])), "postcode_pc4")


def top1_per_group(df: DataFrame, group_cols, order_cols) -> DataFrame:
    """J6 / O4 — first row of each group under ``order_cols`` (deterministic when the
    order ends in a unique tie-break).  Apply to aggregated rows only."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest_only(model, table: str, col: str) -> DataFrame:
    """P14 — rows of a model table whose ``col`` equals its maximum."""
    return model.tables[table].filter(F.col(col) == newest(model, table, col, F.col(col)))


def newest(model, table: str, col: str, value) -> Column:
    """``max(value)`` over a model table: the mark the load noted for
    (table, col) — see ``Model.marks`` — else a scalar subquery over the
    table, which reads that one column of every row."""
    mark = model.marks.get((table, col))
    if mark is not None:
        return F.lit(mark)
    return model.tables[table].select(F.max(value)).scalar()
