"""Reusable Column helpers for the KPI arithmetic.

All money and rate arithmetic stays in DECIMAL so that ``round`` (HALF_UP,
i.e. half away from zero) sees the exact value.  Averages that are later
rounded or multiplied are written ``sum(x) / count(x)``: Spark's ``avg`` of a
``decimal(p,s)`` already rounds to ``s+4`` digits, which would round twice.
Integer counts are cast to decimal before dividing because ``/`` on
integers yields DOUBLE in Spark.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Counts and small integers enter decimal arithmetic with this type; its 20
# digits cover any row count while leaving the division result >= 14 scale.
COUNT_T = "decimal(20,0)"
# Products of a count and a money sum are narrowed to this type before a
# division so the quotient keeps 9+ fractional digits (ANSI raises rather
# than wraps if a value ever exceeds it).
PRODUCT_T = "decimal(30,4)"


def dec(value) -> Column:
    """F6 — a decimal literal with the scale written in ``value`` (e.g. '0.60')."""
    return F.lit(Decimal(str(value)))


def as_count(c) -> Column:
    return F.col(c).cast(COUNT_T) if isinstance(c, str) else c.cast(COUNT_T)


def nz(c: Column) -> Column:
    """F2 — NULL instead of zero, to guard a divisor (``NULLIF(x, 0)``)."""
    return F.nullif(c, F.lit(0))


def count_if(pred: Column) -> Column:
    """A2 — ``SUM(CASE WHEN pred THEN 1 ELSE 0 END)``; a NULL predicate counts 0."""
    return F.sum(F.when(pred, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def sum_if(pred: Column, value: Column) -> Column:
    """A3 / A10 / A11 — ``SUM(CASE WHEN pred THEN value ELSE 0 END)``."""
    return F.sum(F.when(pred, value).otherwise(F.lit(0)))


def pct(num: Column, den: Column, digits: int) -> Column:
    """A7 / F1 — ``ROUND(num / den * 100, digits)`` for integer counts, exact."""
    return F.round(num.cast(COUNT_T) * 100 / nz(den).cast(COUNT_T), digits)


def rate(pred: Column, digits: int) -> Column:
    """Share of rows matching ``pred`` in percent (aggregate expression)."""
    return pct(count_if(pred), F.count(F.lit(1)), digits)


def mean(col: Column) -> Column:
    """A4 — exact mean ``sum(x) / count(x)`` of a decimal column (aggregate)."""
    return F.sum(col) / nz(F.count(col)).cast(COUNT_T)


def ratio(total: Column, n: Column) -> Column:
    """A4 on pre-aggregated columns: exact ``total / n`` (a sum and its
    count), the mean ``mean`` computes from raw rows."""
    return total / nz(n).cast(COUNT_T)


def round_mean(col: Column, digits: int, scale: int = 1) -> Column:
    """``ROUND(AVG(col) * scale, digits)`` computed without double rounding."""
    m = mean(col)
    return F.round(m * scale if scale != 1 else m, digits)


def times_mean(factor: Column, col: Column) -> Column:
    """A9 — ``factor * AVG(col)`` as ``factor * sum / count`` (wasted-cost basis)."""
    prod = (factor.cast(COUNT_T) * F.sum(col)).cast(PRODUCT_T)
    return prod / nz(F.count(col)).cast(COUNT_T)


def share_of_total(n: Column, over, digits: int) -> Column:
    """W1 / W2 — ``ROUND(n * 100 / SUM(n) OVER w, digits)``; use on aggregated rows."""
    return F.round(n.cast(COUNT_T) * 100 / nz(F.sum(n).over(over)).cast(COUNT_T), digits)


def share_of(n: Column, total: Column, digits: int) -> Column:
    """W1 — ``ROUND(n * 100 / total, digits)`` with the total as a column (``ranks.total``)."""
    return F.round(n.cast(COUNT_T) * 100 / nz(total).cast(COUNT_T), digits)


def delta_pp(cur: Column, prev: Column, digits: int) -> Column:
    """W3 / A8 — change in percentage points; 0 for the first row of a series."""
    return F.round(cur - F.coalesce(prev, cur), digits)


def delta_pct(cur: Column, prev: Column, digits: int) -> Column:
    """W3 — relative change in percent; NULL for the first row of a series."""
    return F.round((cur - F.coalesce(prev, cur)) / nz(prev) * 100, digits)


def scenario_saving(base: Column, effect, years=None) -> Column:
    """A15 — ``base × effect / years``, the what-if saving of one action."""
    out = base * dec(effect)
    return out / F.lit(years) if years is not None else out


def zscore(x: Column, mu: Column, sigma: Column) -> Column:
    """F13 — ``(x - mu) / NULLIF(sigma, 0)``."""
    return (x - mu) / nz(sigma)


def band(col: Column, cuts, labels, zero_label=None) -> Column:
    """F4 / P15 — map a number to a label: optional ``= 0`` band, then ``< cut`` bands.

    A NULL input falls through to the last label, as a SQL CASE does.
    """
    expr = None
    branches = []
    if zero_label is not None:
        branches.append((col == 0, zero_label))
        labels = list(labels)
    for cut, label in zip(cuts, labels):
        branches.append((col < cut, label))
    for pred, label in branches:
        expr = F.when(pred, F.lit(label)) if expr is None else expr.when(pred, F.lit(label))
    return expr.otherwise(F.lit(labels[len(cuts)]))


def rank_of(col: Column, ordered_labels) -> Column:
    """F5 / O2 — position of ``col`` in ``ordered_labels`` (1-based), last+1
    otherwise: the sort key of a custom CASE order."""
    expr = None
    for i, label in enumerate(ordered_labels, start=1):
        expr = F.when(col == label, F.lit(i)) if expr is None else expr.when(col == label, F.lit(i))
    return expr.otherwise(F.lit(len(ordered_labels) + 1))


def label_by_index(idx: Column, labels) -> Column:
    """``labels[idx]`` (0-based) via a literal array lookup."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), idx.cast("int") + 1)
