"""Station × period aggregates, event counts and snowfall rankings.

All are plain ``groupBy().agg()`` plans: algebraic aggregates with map-side
partial aggregation, so a station or year holding a large share of the rows
is combined on every executor before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.measures import event_flag, row_total
from ..functions.periods import period_label, period_start, year_of
from .audit import profile_rows
from .filters import capped


def _present(df: DataFrame, cols) -> list[str]:
    return [c for c in cols if c in df.columns]


def _label_from_start(freq: str) -> Column:
    return period_label(F.col("PERIOD_START"), freq)


def _grouped_by_station_period(df: DataFrame, freq: str, aggs: list[Column]) -> DataFrame:
    # Rows without a station name or date form no group (pandas drops NaN keys).
    keyed = (df.filter(F.col("NAME").isNotNull() & F.col("DATE").isNotNull())
               .withColumn("PERIOD_START", period_start("DATE", freq)))
    out = keyed.groupBy("NAME", "PERIOD_START").agg(*aggs)
    return out.select("NAME", "PERIOD_START", _label_from_start(freq).alias("PERIOD_LABEL"),
                      *[c for c in out.columns if c not in ("NAME", "PERIOD_START")])


def station_period_means(df: DataFrame, freq: str = "Y",
                         agg_cols: list[str] | None = None) -> DataFrame:
    """Mean of every listed measure per station and period (A1)."""
    cols = _present(df, agg_cols or S.AGG_MEASURES)
    return _grouped_by_station_period(df, freq, [F.avg(c).alias(c) for c in cols])


def station_period_snow_totals(df: DataFrame, freq: str = "Y") -> DataFrame:
    """Snowfall sum per station and period; all-missing sums are 0 (A2)."""
    return _grouped_by_station_period(
        df, freq, [F.coalesce(F.sum("SNOW"), F.lit(0.0)).alias("SNOW")])


def station_period_conditions(df: DataFrame, freq: str = "Y") -> DataFrame:
    """Mean of each measure, except rain/haze/fog flags which are summed (A3)."""
    return _grouped_by_station_period(df, freq, _condition_aggregates(df))


def _condition_aggregates(df: DataFrame) -> list[Column]:
    return [(F.coalesce(F.sum(c), F.lit(0.0)) if c in S.SUMMED_EVENTS else F.avg(c)).alias(c)
            for c in _present(df, S.AGG_MEASURES)]


def station_year_facts(df: DataFrame, event_cols: list[str]) -> DataFrame:
    """One row per station and year (missing ones too) with all that the report
    needs of the daily rows: conditions (A3), event days (A11) and counts (A5,
    A7). Event days and counts add up over stations and years, so the yearly
    events and the whole table's profile need no further pass over the days."""
    return df.groupBy("NAME", period_start("DATE", "Y").alias("PERIOD_START")).agg(
        *_condition_aggregates(df),
        *[F.sum(event_flag(c)).cast("bigint").alias(f"days_{c}") for c in _present(df, event_cols)],
        F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in df.columns])


def conditions_of_facts(facts: DataFrame) -> DataFrame:
    """The conditions (A3) in ``station_year_facts``."""
    kept = facts.filter(F.col("NAME").isNotNull() & F.col("PERIOD_START").isNotNull())
    return kept.select("NAME", "PERIOD_START", _label_from_start("Y").alias("PERIOD_LABEL"), *_present(facts, S.AGG_MEASURES))


def events_of_facts(facts: DataFrame, event_cols: list[str], min_total: int = S.MIN_EVENT_TOTAL) -> DataFrame:
    """The yearly event frequencies (A12) in ``station_year_facts``."""
    cols = [c for c in event_cols if f"days_{c}" in facts.columns]
    yearly = (facts.filter(F.col("PERIOD_START").isNotNull()).groupBy(year_of("PERIOD_START").alias("YEAR"))
              .agg(*[F.sum(f"days_{c}").alias(c) for c in cols]))
    return _valid_years(yearly, cols, min_total)


def profile_of_facts(facts: DataFrame) -> DataFrame:
    """The null profile (A7) in ``station_year_facts``."""
    names = [c[2:] for c in facts.columns if c.startswith("n_") and c != "n_rows"]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    wide = facts.agg(total("n_rows").alias("__rows"), *[total(f"n_{c}").alias(c) for c in names])
    return profile_rows(wide, names)


def heavy_precipitation_years(df: DataFrame, limit: float = S.HEAVY_PRCP_LIMIT) -> DataFrame:
    """Station-years whose precipitation sum exceeds ``limit``, largest first (A4)."""
    return (df.filter(F.col("PRCP").isNotNull())
              .groupBy("STATION", year_of("DATE").alias("YEAR"))
              .agg(F.sum("PRCP").alias("total_precipitation"))
              .filter(F.col("total_precipitation") > limit)
              .orderBy(F.desc("total_precipitation"), "STATION", "YEAR"))


def top_positive_stations(df: DataFrame, column: str = "TSUN",
                          n: int = S.TOP_STATIONS) -> DataFrame:
    """Stations with the most days of ``column > 0`` (A9); a distributed top-k."""
    return (df.filter(F.col(column) > 0)
              .groupBy("NAME").agg(F.count(F.lit(1)).alias("records"))
              .orderBy(F.desc("records"), F.asc_nulls_last("NAME"))
              .limit(n))


def station_trend_capped(df: DataFrame, variable: str, max_value: float | None = None) -> DataFrame:
    """Mean of one measure by station and year, values above a cap left out."""
    kept = capped(df.filter(F.col("NAME").isNotNull()), variable, max_value)
    return (kept.groupBy("NAME", year_of("DATE").alias("YEAR"))
                .agg(F.avg(variable).alias(variable)))


def yearly_event_counts(df: DataFrame, event_cols: list[str]) -> DataFrame:
    """Days with each event per year, long form ``(EVENT, YEAR, COUNT)``."""
    cols = _present(df, event_cols)
    wide = (df.filter(F.col("DATE").isNotNull())
              .groupBy(year_of("DATE").alias("YEAR"))
              .agg(*[F.sum(event_flag(c)).cast("bigint").alias(c) for c in cols]))
    return wide.unpivot(["YEAR"], cols, "EVENT", "COUNT").select("EVENT", "YEAR", "COUNT")


def chart_label(code: str) -> str:
    return dict(S.CHART_LABELS).get(code, f"Unknown ({code})")


def yearly_event_frequencies(df: DataFrame, event_cols: list[str] | None = None,
                             min_total: int = S.MIN_EVENT_TOTAL,
                             year_from: int | None = None,
                             year_to: int | None = None) -> DataFrame:
    """Per-year event-day counts for years with enough events.

    Years whose summed counts stay under ``min_total`` are dropped; a bound
    is applied only when it is itself one of the kept years. Columns are the
    chart labels of the events. The data is aggregated once; the bound
    checks are window maxima over the aggregated rows, one per calendar
    year (a bounded set), so the input is not scanned again.
    """
    cols = _present(df, event_cols or S.EVENT_CHART_COLS)
    yearly = (df.filter(F.col("DATE").isNotNull())
                .groupBy(year_of("DATE").alias("YEAR"))
                .agg(*[F.sum(event_flag(c)).cast("bigint").alias(c) for c in cols]))
    return _valid_years(yearly, cols, min_total, year_from, year_to)


def _valid_years(yearly: DataFrame, cols: list[str], min_total: int, year_from: int | None = None,
                 year_to: int | None = None) -> DataFrame:
    total = row_total(cols)
    out = yearly.filter(total >= min_total)
    every_year = Window.partitionBy()  # over one row per calendar year
    if year_from is not None:
        is_valid = F.max((F.col("YEAR") == year_from).cast("int")).over(every_year)
        out = out.withColumn("_from_ok", is_valid).filter(
            (F.col("_from_ok") == 0) | (F.col("YEAR") >= year_from))
    if year_to is not None:
        is_valid = F.max((F.col("YEAR") == year_to).cast("int")).over(every_year)
        out = out.withColumn("_to_ok", is_valid).filter(
            (F.col("_to_ok") == 0) | (F.col("YEAR") <= year_to))
    return out.select("YEAR", *[F.col(c).alias(chart_label(c)) for c in cols])


def station_year_snow(df: DataFrame, year: int | None = None) -> DataFrame:
    """Mean SNOW per station and year, of one year only when it is given: the
    input of the snowfall charts. The year is a date range on the rows, so it
    reaches the scan, and no other measure is read."""
    if year is not None:
        df = df.filter((F.col("DATE") >= F.lit(dt.date(year, 1, 1))) & (F.col("DATE") <= F.lit(dt.date(year, 12, 31))))
    return station_period_means(df.select("NAME", "DATE", "SNOW"), "Y", ["SNOW"])


def _year_slice(df_grouped: DataFrame, year: int) -> DataFrame:
    """The yearly periods of one year (P14); other frequencies have other labels."""
    return df_grouped.filter((F.col("PERIOD_START") == F.lit(dt.date(year, 1, 1)))
                             & (F.col("PERIOD_LABEL") == str(year)))


def snowfall_share(df_grouped: DataFrame, year: int,
                   min_threshold: float = S.SNOW_SHARE_MIN) -> DataFrame:
    """Each station's share of a year's snowfall; small shares fold into
    one ``Others`` row (A16). Input: station-year aggregate (A1/A3)."""
    sums = (_year_slice(df_grouped, year).groupBy("NAME").agg(F.sum("SNOW").alias("SNOW"))
            .filter(F.col("SNOW") > 0))
    total = sums.select(F.sum("SNOW")).scalar()
    slices = (sums.withColumn("NAME", F.when(F.col("SNOW") / total < min_threshold,
                                             F.lit("Others")).otherwise(F.col("NAME")))
                  .groupBy("NAME").agg(F.sum("SNOW").alias("SNOW")))
    return slices.withColumn("SHARE", F.col("SNOW") / total)


def snowfall_shares_all_years(df_grouped: DataFrame) -> DataFrame:
    """Each station's share of its year's snowfall, every year at once.

    Year totals are one row per year; they join back to the station sums on
    YEAR (broadcast, bounded by the number of years) instead of a window
    that would put each year's stations in one task.
    """
    sums = (df_grouped.filter(F.col("NAME").isNotNull())
            .groupBy(F.year("PERIOD_START").cast("bigint").alias("YEAR"), "NAME")
            .agg(F.sum("SNOW").alias("SNOW")).filter(F.col("SNOW") > 0))
    totals = sums.groupBy("YEAR").agg(F.sum("SNOW").alias("_total"))
    return (sums.join(F.broadcast(totals), on="YEAR")
            .select("YEAR", "NAME", "SNOW", (F.col("SNOW") / F.col("_total")).alias("SHARE")))


def snowfall_ranking(df_grouped: DataFrame, year: int,
                     min_total: float = S.SNOW_RANK_MIN) -> DataFrame:
    """Stations whose snowfall in a year reaches ``min_total``, largest first."""
    return (_year_slice(df_grouped, year).groupBy("NAME").agg(F.sum("SNOW").alias("SNOW"))
            .filter(F.col("SNOW") >= min_total)
            .orderBy(F.desc("SNOW"), "NAME"))


def result_summary(df: DataFrame) -> DataFrame:
    """Row count, first and last date, distinct stations."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.min("DATE").alias("min_date"),
                  F.max("DATE").alias("max_date"),
                  F.countDistinct("NAME").alias("n_stations"))
