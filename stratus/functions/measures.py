"""Column functions over measures: event flags, unit conversion, row means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def event_flag(c: str | Column) -> Column:
    """1 when the value is above zero, else 0 (missing counts as 0)."""
    return F.when(_c(c) > 0, F.lit(1)).otherwise(F.lit(0))


def any_positive(cols: list[str]) -> Column:
    """True when any of the columns is above zero; NULLs count as False."""
    return reduce(lambda a, b: a | b, [F.coalesce(_c(c) > 0, F.lit(False)) for c in cols],
                  F.lit(False))


def row_mean(a: str | Column, b: str | Column) -> Column:
    """NULL-skipping mean of two values."""
    a, b = _c(a), _c(b)
    return F.coalesce((a + b) / 2, a, b)


def prcp_inches(c: str | Column = "PRCP") -> Column:
    """Tenths of millimetres to inches."""
    return _c(c) / 10 * S.INCH_PER_MM


def row_total(cols: list[str]) -> Column:
    """Sum across columns, missing values counted as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(_c(c), F.lit(0)) for c in cols], F.lit(0))
