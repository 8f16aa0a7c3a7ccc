"""Cleaning of raw station rows (all text) into typed observations.

The steps follow the original order, except that numbers are parsed before
the average-temperature fill and the plausibility limits (so text in a
temperature column no longer aborts the whole file). Every step is a column
expression or a filter over one pass of the data; the report is a single
aggregate over the same annotated rows.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.measures import row_mean
from ..functions.text import clean_text, parse_date, parse_number
from .filters import _as_date


def missing_required(df: DataFrame) -> set[str]:
    """Base columns a raw frame lacks."""
    return set(S.BASE_COLS) - set(df.columns)


def check_required(df: DataFrame) -> tuple[bool, str]:
    """(ok, reason) for the required-column check."""
    missing = missing_required(df)
    if missing:
        return False, f"Missing required columns: {', '.join(sorted(missing))}"
    return True, "ok"


def clean_schema(measures: list[str]) -> T.StructType:
    fields = [T.StructField("STATION", T.StringType()), T.StructField("DATE", T.DateType()),
              T.StructField("LATITUDE", T.DoubleType()), T.StructField("LONGITUDE", T.DoubleType()),
              T.StructField("ELEVATION", T.DoubleType()), T.StructField("NAME", T.StringType())]
    return T.StructType(fields + [T.StructField(m, T.DoubleType()) for m in measures])


def _any_not_null(cols: list[str]) -> Column:
    if not cols:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols])


def _annotate(df: DataFrame, floor, na_tokens: bool):
    """Typed columns plus one boolean per drop reason; returns (frame, measures).

    Three projections, each expression evaluated once: (1) blank/missing
    cells to NULL and whitespace stripped, (2) dates and numbers parsed,
    (3) the average-temperature fill and the drop flags.
    """
    cols = [c for c in df.columns if not c.endswith(S.ATTRIBUTE_SUFFIX)]          # C3
    data_cols = [c for c in cols if c not in S.BASE_COLS]
    measures = [m for m in S.KEEP_MEASURES if m in cols]
    floor = _as_date(floor)
    is_text = {c: isinstance(df.schema[c].dataType, T.StringType) for c in cols}

    # (1) C2 blanks and missing tokens -> NULL (every column), C0/C7 strip.
    text = df.select(*[
        (clean_text(c, na_tokens) if is_text[c] else F.col(c)).alias(c) for c in cols])

    def num(c):
        return parse_number(c, stripped=True) if is_text[c] else F.col(c).cast("double")

    # (2) C8 date, C9 numbers; raw measure cells kept to count failed parses.
    typed = text.select(
        F.col("STATION").cast("string").alias("STATION"),
        (parse_date("DATE", stripped=True) if is_text["DATE"] else F.col("DATE").cast("date")).alias("DATE"),
        num("LATITUDE").alias("LATITUDE"), num("LONGITUDE").alias("LONGITUDE"),
        num("ELEVATION").alias("ELEVATION"), F.col("NAME").cast("string").alias("NAME"),
        *[num(m).alias(m) for m in measures],
        (~_any_not_null(cols)).alias("_empty"),                                  # C4
        (~_any_not_null(data_cols)).alias("_no_data"),                           # C5
        *[F.col(m).isNotNull().alias(f"_had_{m}") for m in measures],
    )
    # (3) C10 fill, then flags. The non-deterministic column is an optimizer
    # barrier: without it the row filter would be pushed below these
    # projections with every parse expression inlined into the predicate.
    typed = typed.withColumns({f"_bad_{m}": F.col(f"_had_{m}") & F.col(m).isNull()
                               for m in measures})
    fills = {}
    if "TMAX" in measures and "TMIN" in measures:                                # C10
        fill = row_mean("TMAX", "TMIN")
        fills["TAVG"] = F.coalesce(F.col("TAVG"), fill) if "TAVG" in measures else fill
        if "TAVG" not in measures:
            measures = measures + ["TAVG"]
    typed = typed.withColumns(fills) if fills else typed
    temps = [c for c in S.TEMP_COLS if c in measures]
    out_of_limits = reduce(lambda a, b: a | b,
                           [F.coalesce(~F.col(c).between(S.TEMP_LOWER, S.TEMP_UPPER),
                                       F.lit(False)) for c in temps], F.lit(False))
    typed = typed.withColumns({
        "_barrier": F.spark_partition_id(),
        "_bad_date": F.col("DATE").isNull(),                                     # C8
        "_before_floor": (F.col("DATE") < F.lit(floor)) if floor is not None
                         else F.lit(False),                                      # C8b
        "_out_of_limits": out_of_limits,                                         # C11
    })
    return typed, measures


def _kept(typed: DataFrame) -> Column:
    # Referencing the barrier column keeps it (and so the barrier) in the plan.
    return (~(F.col("_empty") | F.col("_no_data") | F.col("_bad_date")
              | F.coalesce(F.col("_before_floor"), F.lit(False)) | F.col("_out_of_limits"))
            & (F.col("_barrier") >= 0))


def clean_observations(df: DataFrame, floor=None, na_tokens: bool = True,
                       metrics: Observation | None = None) -> DataFrame:
    """Typed, validated observations from raw rows.

    ``floor`` is the earliest date kept (None keeps all). A frame without
    the six base columns yields an empty frame with the clean schema.
    ``metrics`` (a ``pyspark.sql.Observation``) collects the cleaning report
    counts while the result is computed by whatever action consumes it
    (e.g. the append), with no extra pass over the data.
    """
    if missing_required(df):
        return df.sparkSession.createDataFrame([], clean_schema([]))
    typed, measures = _annotate(df, floor, na_tokens)
    if metrics is not None:
        typed = typed.observe(metrics, *_report_columns(typed, measures))
    return typed.filter(_kept(typed)).select(*S.BASE_COLS, *measures)


def clean_report(df: DataFrame, floor=None, na_tokens: bool = True) -> DataFrame:
    """One row of step counts (C12): rows in, rows removed by each step in
    order, rows out, values turned to NULL by number parsing per measure,
    and missing values per measure in the rows kept."""
    typed, measures = _annotate(df, floor, na_tokens)
    return typed.agg(*_report_columns(typed, measures))


def _report_columns(typed: DataFrame, measures: list[str]) -> list[Column]:
    e, nd, bd = F.col("_empty"), F.col("_no_data"), F.col("_bad_date")
    bf, ol = F.coalesce(F.col("_before_floor"), F.lit(False)), F.col("_out_of_limits")
    reach_c9 = ~(e | nd | bd | bf)
    return [
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(e).alias("dropped_empty"),
        F.count_if(~e & nd).alias("dropped_no_data"),
        F.count_if(~e & ~nd & bd).alias("dropped_bad_date"),
        F.count_if(~e & ~nd & ~bd & bf).alias("dropped_before_floor"),
        F.count_if(reach_c9 & ol).alias("dropped_out_of_limits"),
        F.count_if(_kept(typed)).alias("rows_out"),
        *[F.count_if(reach_c9 & F.col(f"_bad_{m}")).alias(f"unparsed_{m}")
          for m in measures if f"_bad_{m}" in typed.columns],
        *[F.count_if(_kept(typed) & F.col(m).isNull()).alias(f"null_{m}") for m in measures],
    ]


def plausible_temperatures(df: DataFrame) -> DataFrame:
    """Keep rows whose temperatures are missing or within [-500, 512] (C11)."""
    cond = reduce(lambda a, b: a & b,
                  [F.col(c).isNull() | F.col(c).between(S.TEMP_LOWER, S.TEMP_UPPER)
                   for c in S.TEMP_COLS if c in df.columns], F.lit(True))
    return df.filter(cond)


def fill_average_temperature(df: DataFrame) -> DataFrame:
    """TAVG filled with the NULL-skipping mean of TMAX and TMIN."""
    if not {"TMAX", "TMIN"} <= set(df.columns):
        return df
    fill = row_mean("TMAX", "TMIN")
    return df.withColumn("TAVG", F.coalesce(F.col("TAVG"), fill) if "TAVG" in df.columns
                         else fill)
