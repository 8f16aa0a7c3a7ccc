"""Audit and profiling operators over the observation table.

Each audit is one aggregate or one distinct over the table; several counts
that the original ran as separate statements are folded into single passes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import year_of
from .filters import _as_date


def list_tables(spark: SparkSession) -> list[str]:
    """Names of the tables in the current catalog database."""
    return [t.name for t in spark.catalog.listTables()]


def column_names(df: DataFrame) -> list[str]:
    """Column names."""
    return list(df.columns)


def row_count(df: DataFrame) -> DataFrame:
    """Row count as a one-row frame (A5)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Non-null and null count per column, long form (A7), one pass."""
    cols = [c for c in (cols or df.columns) if c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in cols])
    return profile_rows(wide, cols)


def profile_rows(wide: DataFrame, cols: list[str]) -> DataFrame:
    """One row of counts (``__rows`` and one per column) in long form."""
    long = wide.unpivot(["__rows"], cols, "COLUMN_NAME", "NON_NULL")
    return long.select("COLUMN_NAME", "NON_NULL", F.col("__rows").alias("ROWS"),
                       (F.col("__rows") - F.col("NON_NULL")).alias("NULLS"))


def date_bounds(df: DataFrame) -> DataFrame:
    """First and last date and year."""
    return df.agg(F.min("DATE").alias("min_date"), F.max("DATE").alias("max_date"),
                  F.min(year_of("DATE")).alias("min_year"),
                  F.max(year_of("DATE")).alias("max_year"))


def audit_counts(df: DataFrame, floor=None) -> DataFrame:
    """The audit's filtered counts in one pass."""
    floor = _as_date(floor)
    before = (F.count_if(F.col("DATE") < F.lit(floor)) if floor is not None
              else F.lit(0).cast("bigint"))
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  before.alias("before_floor"),
                  F.count("TSUN").alias("tsun_non_null"),
                  F.count_if(F.col("TSUN") > 0).alias("tsun_positive"),
                  F.count("WT01").alias("wt01_non_null"),
                  F.count("WT08").alias("wt08_non_null"),
                  F.count("WT16").alias("wt16_non_null"))


def distinct_stations(df: DataFrame) -> DataFrame:
    """Distinct station names, alphabetical."""
    return df.select("NAME").distinct().orderBy(F.asc_nulls_first("NAME"))


def station_count(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct stations and rows (A10). ``approximate`` uses a HyperLogLog
    sketch, which needs no shuffle of the names."""
    distinct = (F.approx_count_distinct("NAME") if approximate else F.countDistinct("NAME"))
    return df.agg(distinct.alias("n_stations"), F.count(F.lit(1)).alias("n_rows"))


def distinct_station_profile(df: DataFrame) -> DataFrame:
    """Distinct station/location/temperature combinations."""
    return df.select("STATION", "LATITUDE", "LONGITUDE", "ELEVATION", "NAME",
                     "TAVG", "TMIN", "TMAX").distinct()


def station_text(df: DataFrame) -> DataFrame:
    """Distinct "STATION NAME" strings (D3); missing parts read ``None``."""
    pairs = df.select("STATION", "NAME").distinct()
    return pairs.select(F.concat_ws(" ", F.coalesce("STATION", F.lit("None")),
                                    F.coalesce("NAME", F.lit("None"))).alias("STATION_TEXT")
                        ).distinct()


def years_present(df: DataFrame) -> DataFrame:
    """Distinct calendar years."""
    return df.filter(F.col("DATE").isNotNull()).select(year_of("DATE").alias("YEAR")).distinct()


def sample_rows(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows under a total order."""
    return df.orderBy(*order_by).limit(n)


def page(df: DataFrame, order_by: list[str], page_no: int, size: int = 10) -> DataFrame:
    """Page ``page_no`` (0-based) of a totally ordered result."""
    return df.orderBy(*order_by).offset(page_no * size).limit(size)


@dataclass(frozen=True)
class Place:
    """Where a page ended: the key of its last row, and how many rows with that key were shown."""
    key: tuple
    shown: int


def _at_or_after(order_by: list[str], key: tuple) -> Column:
    """Rows whose key is not less than ``key`` in the order of ``orderBy`` (NULL first)."""
    out = F.lit(True)
    for c, v in reversed(list(zip(order_by, key))):
        after = F.col(c).isNotNull() if v is None else F.coalesce(F.col(c) > F.lit(v), F.lit(False))
        out = after | (F.col(c).eqNullSafe(F.lit(v)) & out)
    return out


def page_after(df: DataFrame, order_by: list[str], place: Place | None, size: int = 10) -> DataFrame:
    """The page behind ``place`` (None: the first).

    The rows before the place are filtered out, so any page is one top-``size``
    of the rest; only rows equal to the last one shown are skipped by count.
    """
    rest = df if place is None else df.filter(_at_or_after(order_by, place.key))
    return rest.orderBy(*order_by).offset(place.shown if place else 0).limit(size)


def place_after(rows: list[Row], order_by: list[str], place: Place | None) -> Place | None:
    """The place behind a collected page (``place``: the one it was read from)."""
    if not rows:
        return place
    key = tuple(rows[-1][c] for c in order_by)
    shown = sum(tuple(r[c] for c in order_by) == key for r in rows)
    return Place(key, shown + (place.shown if place and place.key == key else 0))
