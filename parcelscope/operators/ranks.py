"""Totals, ranks and positions over all rows of a result, without one task
that holds them all (W1, W5, O1).

A window without a partition key sends every row to one task.  Here a total is
a scalar subquery, and a rank is counted in ranges: cut points of the leading
sort key (approximate quantiles, a scalar subquery) put each row into one of
``RANGES`` ranges, a window ranks the rows inside their range, and the rows in
the ranges before it (a second scalar subquery, one number per range) are added.
Equal leading keys share a range, so ties are ranked as SQL ranks them, and
the cut points decide only how even the ranges are, never a rank.

The rows are an aggregate's result.  The subqueries keep all its columns alive
(``_all``), so below its exchange they are the same plan as the query itself
and Spark runs that once (``ReusedExchange``): the fact is scanned once.

Edge cases.  No rows: no rows, a total of NULL.  NULL sort keys stand where the
order puts them.  One value of the leading key on all rows is one range: give
an order whose leading key tells rows apart where results are large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 64
CUT_ACCURACY = 1000
KEY_BYTES = 7           # leading bytes of a text key that pick its range: 56 bits


def _all(rows: DataFrame) -> Column:
    """An aggregate that needs every column of ``rows``."""
    return F.max(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))


def total(rows: DataFrame, value: Column) -> Column:
    """``SUM(value)`` over all of ``rows``, for a column beside them (W1)."""
    return rows.agg(F.sum(value).alias("v"), _all(rows).alias("a")).select(F.struct("v", "a")).scalar()["v"]


def _number(c: Column, kind: T.DataType) -> Column:
    """``c`` as a number in the same order (equal for texts that share
    ``KEY_BYTES`` bytes)."""
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, KEY_BYTES)), 2 * KEY_BYTES, "0")
        return F.conv(head, 16, 10).cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("int") if isinstance(kind, T.BooleanType) else c


def positions(rows: DataFrame, name: str, order, ties: bool = False, ranges: int = RANGES) -> DataFrame:
    """``rows`` with ``name``: their position 1, 2, ... in ``order``, a list of
    ``(column, "asc" | "desc" | "desc_nulls_first" | "asc_nulls_last")``.  With
    ``ties``, equal rows share their rank as ``RANK()`` gives it; else the
    order should end in a unique key."""
    lead, way = order[0]
    down, nulls_first = way.startswith("desc"), way in ("asc", "desc_nulls_first")
    key = _number(F.col(lead), rows.schema[lead].dataType)
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cut = rows.agg(F.percentile_approx(key, shares, CUT_ACCURACY).alias("v"), _all(rows).alias("a"))
    cuts = F.coalesce(cut.select(F.struct("v", "a")).scalar()["v"], F.array())
    below = F.size(F.filter("_cuts", lambda x: x < key))
    # ranges in the order's direction; null keys before or after all others
    place = F.when(key.isNull(), -ranges - 1 if nulls_first else ranges + 1).otherwise(-below if down else below)
    cut_up = rows.withColumn("_cuts", cuts).withColumn("_range", place).drop("_cuts")
    sizes = (cut_up.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), _all(rows).alias("a"))
             .agg(F.collect_list(F.struct("_range", "n", "a"))))      # at most ranges + 2 of them
    before = F.aggregate(F.filter("_sizes", lambda s: s["_range"] < F.col("_range")), F.lit(0).cast("bigint"),
                         lambda n, s: n + s["n"])
    ways = {"asc": F.asc_nulls_first, "desc": F.desc_nulls_last, "desc_nulls_first": F.desc_nulls_first,
            "asc_nulls_last": F.asc_nulls_last}
    inside = Window.partitionBy("_range").orderBy(*[ways[w](c) for c, w in order])
    rank = F.rank().over(inside) if ties else F.row_number().over(inside)
    ranked = cut_up.withColumn("_in", rank).withColumn("_sizes", sizes.scalar())
    return ranked.withColumn(name, before + F.col("_in")).drop("_range", "_in", "_sizes")
