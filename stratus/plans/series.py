"""The result set behind each chart (G1–G17), as lazy DataFrames.

Series of one station come ordered by date (they are small: one station's
days); all-station tables are left unordered, as a global sort would add a
range shuffle that no consumer needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.measures import event_flag, prcp_inches
from ..operators import aggregates as A
from ..operators import filters as P
from ..session import materialize


def first_stations(df_grouped: DataFrame, n: int = S.TOP_STATIONS) -> DataFrame:
    """The first ``n`` station names in alphabetical order (T5); at most n rows."""
    return (df_grouped.select("NAME").filter(F.col("NAME").isNotNull()).distinct()
            .orderBy("NAME").limit(n))


def _restrict_to(df: DataFrame, stations: DataFrame) -> DataFrame:
    # ``stations`` holds at most TOP_STATIONS rows: a bounded broadcast.
    return df.join(F.broadcast(stations), on="NAME", how="left_semi")


def trend_of_first_stations(yearly: DataFrame, column: str,
                            n: int = S.TOP_STATIONS) -> DataFrame:
    """One yearly column of the first ``n`` stations, from a station-year
    aggregate already computed (A1/A3 output)."""
    return _restrict_to(yearly, first_stations(yearly, n)).select(
        "NAME", "PERIOD_START", "PERIOD_LABEL", column)


def max_temperature_trend(df: DataFrame, n: int = S.TOP_STATIONS) -> DataFrame:
    """Yearly mean TMAX of the first ``n`` stations (G1).

    The station-year table is written once (it is read for the station list
    and for the series), so the observations are scanned once.
    """
    yearly = materialize(A.station_period_means(df, "Y", ["TMAX"]), "yearly")
    return trend_of_first_stations(yearly, "TMAX", n)


def snowfall_trend(df: DataFrame, n: int = S.TOP_STATIONS, metric: str = "mean") -> DataFrame:
    """Yearly SNOW of the first ``n`` stations (G2). The chart is titled a
    total but plots the mean; ``metric="total"`` gives the sum (A2)."""
    yearly = materialize(A.station_period_snow_totals(df, "Y") if metric == "total"
                         else A.station_period_means(df, "Y", ["SNOW"]), "yearly")
    return trend_of_first_stations(yearly, "SNOW", n)


def station_window(df: DataFrame, station: str, start, end, floor=None) -> DataFrame:
    """One station's rows inside the (floor-clamped) date range (P5 + P3)."""
    return P.date_range_with_floor(P.station(df, station), start, end, floor)


def temperature_lines(df: DataFrame, station: str, start, end, floor=None) -> DataFrame:
    """Long form (DATE, METRIC, VALUE) of TMIN/TAVG/TMAX for one station."""
    rows = station_window(df, station, start, end, floor)
    cols = [c for c in ["TMIN", "TAVG", "TMAX"] if c in rows.columns]
    return (rows.select("DATE", *cols).unpivot(["DATE"], cols, "METRIC", "VALUE")
            .orderBy("DATE", "METRIC"))


def _event_days(df: DataFrame, station: str, start, end, floor, column: str,
                out: str) -> DataFrame:
    rows = station_window(df, station, start, end, floor)
    return (rows.select("DATE", event_flag(column).alias(out))
                .filter(F.col(out) > 0).orderBy("DATE"))


def rain_days(df, station, start, end, floor=None) -> DataFrame:
    """Days with rain (WT16 > 0) at one station."""
    return _event_days(df, station, start, end, floor, "WT16", "Rain")


def snow_days(df, station, start, end, floor=None) -> DataFrame:
    """Days with snowfall (SNOW > 0) at one station."""
    return _event_days(df, station, start, end, floor, "SNOW", "Snow")


def smoke_days(df, station, start, end, floor=None) -> DataFrame:
    """Days with smoke or haze (WT08 > 0) at one station."""
    return _event_days(df, station, start, end, floor, "WT08", "Smoke")


def fog_days(df, station, start, end, floor=None) -> DataFrame:
    """Days with fog or heavy fog at one station."""
    rows = station_window(df, station, start, end, floor)
    cols = [c for c in ["WT01", "WT02"] if c in rows.columns]
    return P.any_event(rows, cols).select("DATE", *cols).orderBy("DATE")


def measure_series(df, station, start, end, data_type: str, floor=None) -> DataFrame:
    """(DATE, first usable measure column) of a data type at one station.

    Which column is "usable" (present with a value) is decided per column
    over the selected rows. They are one station's days, so with several
    columns to choose from they are staged first: the input is read once.
    """
    rows = station_window(df, station, start, end, floor)
    cols = [c for c in P.columns_for(data_type) if c in rows.columns]
    if not cols:
        return rows.select("DATE").limit(0)
    rows = materialize(rows.select("DATE", *cols), "station-window")
    usable = P.usable_columns(rows, cols).first()
    chosen = next((c for c in cols if usable[c]), None)
    if chosen is None:
        return rows.select("DATE").limit(0)
    return rows.select("DATE", chosen).orderBy("DATE")


def occurrences(df, station, start, end, column: str, floor=None) -> DataFrame:
    """Dates with ``column > 0``."""
    return P.positive(station_window(df, station, start, end, floor), column).select(
        "DATE", column).orderBy("DATE")


def precipitation_inches(df, station=None, start=None, end=None, floor=None) -> DataFrame:
    """Precipitation converted to inches."""
    rows = df if station is None else station_window(df, station, start, end, floor)
    return rows.select("NAME", "DATE", prcp_inches("PRCP").alias("PRCP_IN"))


def filtered_observations(df: DataFrame, start=None, end=None) -> DataFrame:
    """Observation set behind the results page (G17): keyed rows in range,
    required measures added as 0 when absent."""
    rows = P.date_range(P.drop_incomplete_keys(df), start, end)
    return P.fill_missing_columns(rows, ["TMIN", "TAVG", "TMAX", "PRCP"], fill=0.0)


def filtered_summary(df: DataFrame, start=None, end=None) -> DataFrame:
    """Counts behind the results page."""
    return A.result_summary(filtered_observations(df, start, end))


_STATION_METRICS = {
    "temperature": ["TMIN", "TAVG", "TMAX"],
    "precipitation": ["PRCP", "SNOW"],
    "events": ["WT16", "WT08", "WT01"],
}


def station_metrics(df_grouped: DataFrame, station, kind: str = "temperature") -> DataFrame:
    """One station's period series of a metric group (P20): temperature,
    precipitation and snow, or event counts; ordered by period."""
    cols = [c for c in _STATION_METRICS[kind] if c in df_grouped.columns]
    return (P.station(df_grouped, station).select("PERIOD_START", *cols)
            .orderBy("PERIOD_START"))


def control_summary(df: DataFrame) -> DataFrame:
    """Date bounds, station count and the city text of the first station
    (A21): what the station picker and date range are filled from."""
    from ..functions.names import city_part
    return df.agg(F.min("DATE").alias("min_date"), F.max("DATE").alias("max_date"),
                  F.countDistinct("NAME").alias("n_stations"),
                  city_part(F.min("NAME")).alias("first_city"))
