"""Helpers that write DuckDB SQL text for the oracle.

DuckDB turns DECIMAL division into DOUBLE, so every rounded ratio is
computed with integers: for num/den to ``s`` places, half away from zero,
``sign * ((2*|num|*10^s + |den|) // (2*|den|)) / 10^s``.  Callers pass
integer-valued expressions (money scaled to cents etc.).
"""

from __future__ import annotations


def rdiv(num: str, den: str, s: int) -> str:
    m = 10 ** s
    n = f"CAST(({num}) AS HUGEINT)"
    d = f"CAST(NULLIF(({den}), 0) AS HUGEINT)"
    return (f"(CAST(SIGN({n}) * SIGN({d}) * ((2 * ABS({n}) * {m} + ABS({d})) // (2 * ABS({d})))"
            f" AS DOUBLE) / {m})")


def units(col: str, scale: int) -> str:
    """A decimal column with ``scale`` places as an integer count of units."""
    return f"CAST(({col}) * {10 ** scale} AS BIGINT)"


def cnt(pred: str) -> str:
    return f"SUM(CASE WHEN {pred} THEN 1 ELSE 0 END)"


def dbl(expr: str) -> str:
    return f"CAST(({expr}) AS DOUBLE)"


def big(expr: str) -> str:
    return f"CAST(({expr}) AS BIGINT)"


def with_ctes(ctes: dict, names, body: str) -> str:
    """``WITH`` the fixture CTEs ``names`` (in dependency order) then ``body``."""
    parts = [f"{n} AS (\n{ctes[n]}\n)" for n in names]
    return "WITH " + ",\n".join(parts) + "\n" + body


def rint(num: str, den: str, s: int) -> str:
    """round(num/den, s) * 10^s as an exact integer (non-negative operands)."""
    m = 10 ** s
    return f"((2 * CAST(({num}) AS HUGEINT) * {m} + ({den})) // (2 * NULLIF(({den}), 0)))"


def ymd(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d')"


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"
