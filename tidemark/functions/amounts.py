"""Sums and means of money that come out the same whatever order rows arrive in.

Binary floating-point sums change with partitioning; these add decimals and convert once at the end.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_text(expression: str, scale: int = 2) -> str:
    """SQL text of :func:`exact`."""
    unit = format(Decimal(1).scaleb(-scale), "f")
    units = f"cast(floor(({expression}) * {10**scale}D + 0.5D) as decimal(18,0))"
    return f"cast({units} * {unit}BD as decimal(18,{scale}))"


def exact(expression: str, scale: int = 2) -> Column:
    """A double that stands for a number with ``scale`` decimals, as that number.

    It is rounded to whole units and then scaled; a plain cast of a double to decimal goes through its
    text and costs several times as much.
    """
    return F.expr(exact_text(expression, scale))


def total(c: str | Column, digits: int = 2) -> Column:
    """Exact sum of a decimal column, rounded, as double."""
    return F.round(F.sum(_col(c)), digits).cast("double")


def mean(c: str | Column) -> Column:
    """Exact sum over non-null count; NULL when there is nothing to average."""
    c = _col(c)
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """Quotient of two aggregates; NULL when the denominator is zero."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out * scale if scale != 1.0 else out


def mean_ratio(each: Column) -> Column:
    """Mean of a per-row ratio, in double; callers round where they show it."""
    return F.avg(each.cast("double"))
