"""Calendar buckets of a date column (year, quarter, month, week, day)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TRUNC_UNIT = {"Y": "year", "Q": "quarter", "M": "month", "W": "week", "D": "day"}


def _unit(freq: str) -> str:
    try:
        return _TRUNC_UNIT[freq.upper()[0]]
    except (KeyError, IndexError, AttributeError):
        raise ValueError(f"unsupported period frequency: {freq!r}") from None


def year_of(date_col: str | Column = "DATE") -> Column:
    """Calendar year as bigint."""
    return F.year(date_col).cast("bigint")


def period_start(date_col: str | Column = "DATE", freq: str = "Y") -> Column:
    """First day of the period that holds the date (weeks start on Monday)."""
    return F.to_date(F.date_trunc(_unit(freq), F.col(date_col) if isinstance(date_col, str)
                                  else date_col))


def period_label(date_col: str | Column = "DATE", freq: str = "Y") -> Column:
    """Text of the period: ``2020``, ``2020Q1``, ``2020-01``,
    ``2019-12-30/2020-01-05`` or ``2020-01-01``."""
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    unit = _unit(freq)
    if unit == "year":
        return F.year(d).cast("string")
    if unit == "quarter":
        return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
    if unit == "month":
        return F.date_format(d, "yyyy-MM")
    if unit == "week":
        start = F.to_date(F.date_trunc("week", d))
        return F.concat(start.cast("string"), F.lit("/"), F.date_add(start, 6).cast("string"))
    return d.cast("date").cast("string")
