"""Expressions with explicit rules for nulls: a missing or meaningless number is null, never NaN or infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null unless b > 0."""
    return F.when(b > 0, a / b)


def gap_percent(a: Column, b: Column) -> Column:
    """100 * (a / b - 1), null unless b > 0."""
    return F.when(b > 0, (a / b - 1) * 100)


def fill_ratio(a: Column, b: Column, fill: float | None = None) -> Column:
    """a / b, and ``fill`` where b is 0."""
    return F.when(b != 0, a / b).when(b == 0, F.lit(fill))


def pct_change(now: Column, base: Column) -> Column:
    """Change in percent, null unless the base is over 0."""
    return F.when(base > 0, (now / base - 1) * 100)


def symmetric_change(a: Column, b: Column) -> Column:
    """(a - b) / (|a| + |b|) * 100, between -100 and 100; null if both are 0."""
    return F.when(F.abs(a) + F.abs(b) > 0, (a - b) / (F.abs(a) + F.abs(b)) * 100)


def clip_to_null(x: Column, low: float, high: float) -> Column:
    return F.when(x.between(low, high), x)


def at_least(x: Column, t: Column | float, tolerance: float = 1e-12) -> Column:
    """x >= t, with a tolerance for what computing left over."""
    t = t if isinstance(t, Column) else F.lit(t)
    return (x >= t) | (F.abs(x - t) <= tolerance)


def band(x: Column, edges: list[float]) -> Column:
    """The number of edges that x reaches."""
    out = F.lit(0)
    for e in edges:
        out = out + (x >= e).cast("int")
    return F.when(x.isNotNull(), out)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def piecewise(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear interpolation through the knots (x, y), constant beyond the ends."""
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots[:-1], knots[1:], strict=True):
        out = out.when(x <= x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0))
    return out.when(x > knots[-1][0], F.lit(float(knots[-1][1])))


def number_or_null(text: Column) -> Column:
    """A number from text, null for the usual marks of a missing one."""
    return F.expr("try_cast(NULL AS double)") if text is None else F.when(~F.trim(text).isin("", "-", "N/A", "NaN", "null"), F.regexp_replace(F.trim(text), ",", "").try_cast("double"))
