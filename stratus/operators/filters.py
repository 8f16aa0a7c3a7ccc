"""Row filters and column selections over observations.

Every predicate is a native expression, so Catalyst pushes the comparable
parts (station, date, year) into the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.measures import any_positive
from ..functions.periods import period_start


def _as_date(value) -> _dt.date | None:
    if value is None or value == "":
        return None
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    return _dt.date.fromisoformat(str(value)[:10])


def drop_incomplete_keys(df: DataFrame) -> DataFrame:
    """Rows need a date and a station name."""
    return df.na.drop(subset=["DATE", "NAME"])


def date_range(df: DataFrame, start=None, end=None, date_col: str = "DATE") -> DataFrame:
    """Inclusive date range; either bound may be absent."""
    start, end = _as_date(start), _as_date(end)
    out = df
    if start is not None:
        out = out.filter(F.col(date_col) >= F.lit(start))
    if end is not None:
        out = out.filter(F.col(date_col) <= F.lit(end))
    return out


def clamp_start(start, floor) -> _dt.date | None:
    """The later of ``start`` and ``floor``; a missing start becomes the floor."""
    start, floor = _as_date(start), _as_date(floor)
    if floor is None:
        return start
    if start is None or start < floor:
        return floor
    return start


def date_range_with_floor(df: DataFrame, start, end, floor) -> DataFrame:
    """Date range whose start is clamped up to the floor date."""
    return date_range(df, clamp_start(start, floor), end)


def period_start_range(df: DataFrame, start, end, freq: str = "Y") -> DataFrame:
    """Rows whose period start lies in ``[start, end]``.

    The period is derived here, so the filter needs no earlier aggregation.
    """
    start, end = _as_date(start), _as_date(end)
    ps = period_start("DATE", freq)
    out = df
    if start is not None:
        out = out.filter(ps >= F.lit(start))
    if end is not None:
        out = out.filter(ps <= F.lit(end))
    return out


def station(df: DataFrame, name: str) -> DataFrame:
    """Exact station-name match (P5)."""
    return df.filter(F.col("NAME") == name)


def suspect_temperature_condition() -> Column:
    """Audit predicate for implausible temperatures (P6/P7); NULL-safe."""
    def out_of(c, upper):
        return F.coalesce((F.col(c) < S.TEMP_LOWER) | (F.col(c) > upper), F.lit(False))
    return (out_of("TAVG", S.AUDIT_UPPER_AVG_MIN) | out_of("TMIN", S.AUDIT_UPPER_AVG_MIN)
            | out_of("TMAX", S.AUDIT_UPPER_MAX))


def suspect_temperatures(df: DataFrame) -> DataFrame:
    """Rows with an implausible temperature, by station and date."""
    return (df.filter(suspect_temperature_condition())
              .select("STATION", "DATE", "TAVG", "TMIN", "TMAX")
              .orderBy("STATION", "DATE"))


def extreme_cold(df: DataFrame, limit: float = S.EXTREME_COLD) -> DataFrame:
    """Rows where any temperature is below ``limit``."""
    cond = (F.col("TAVG") < limit) | (F.col("TMIN") < limit) | (F.col("TMAX") < limit)
    return (df.filter(F.coalesce(cond, F.lit(False)))
              .select("STATION", "DATE", "TAVG", "TMIN", "TMAX")
              .orderBy("DATE", "STATION"))


def positive(df: DataFrame, column: str) -> DataFrame:
    """Rows with ``column > 0`` (P10)."""
    return df.filter(F.col(column) > 0)


def capped(df: DataFrame, column: str, max_value: float | None) -> DataFrame:
    """Non-missing values, at most ``max_value`` when given."""
    out = df.filter(F.col(column).isNotNull())
    return out if max_value is None else out.filter(F.col(column) <= max_value)


def any_event(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows where any listed column is above zero."""
    present = [c for c in cols if c in df.columns]
    return df.filter(any_positive(present))


def usable_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: for each listed column present, whether it has a value."""
    present = [c for c in cols if c in df.columns]
    return df.agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in present])


def fill_missing_columns(df: DataFrame, cols: list[str], fill=None,
                         dtype: str = "double") -> DataFrame:
    """Add absent columns with a constant (P16): NULL for storage, 0 for screens."""
    missing = [c for c in cols if c not in df.columns]
    return df.withColumns({c: F.lit(fill).cast(dtype) for c in missing}) if missing else df


def missing_columns(df: DataFrame, required) -> set[str]:
    """Required column names absent from ``df``."""
    return set(required) - set(df.columns)


def columns_for(data_type: str) -> list[str]:
    """Measure columns behind a data-type code (P21); unknown code -> itself."""
    return list(S.DATA_TYPE_COLUMNS.get(data_type, ([data_type], "line"))[0])


def string_columns(df: DataFrame) -> list[str]:
    """Names of text columns."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]


def resolve_date_column(df: DataFrame) -> DataFrame:
    """Rename a lower-case ``date`` column to ``DATE``."""
    if "DATE" in df.columns:
        return df
    for c in df.columns:
        if c.lower() == "date":
            return df.withColumnRenamed(c, "DATE")
    raise ValueError("no DATE column")


def iso_date(c: str | Column = "DATE") -> Column:
    """Date as ``yyyy-MM-dd`` text."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def validate_dates(start, end) -> bool:
    """Both dates parse and start is not after end."""
    try:
        s, e = _as_date(start), _as_date(end)
    except (TypeError, ValueError):
        return False
    return s is not None and e is not None and s <= e


def validate_inputs(city: str, data_type: str) -> bool:
    """A non-empty city and a known data-type code."""
    known = {code for code, _ in S.DATA_TYPE_LABELS}
    return isinstance(city, str) and bool(city) and data_type in known


def data_type_label(code: str) -> str:
    """Form label of a data-type code, ``Unknown (<code>)`` if unknown."""
    return dict(S.DATA_TYPE_LABELS).get(code, f"Unknown ({code})")
