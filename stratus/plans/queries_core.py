"""Registered queries: period aggregates and audits (build steps 1–3)."""

from __future__ import annotations

from .. import schema as S
from ..operators import aggregates as A
from ..operators import audit as AU
from ..operators import filters as P
from ..sources.adapter import with_views
from .catalog import _obs, register


def _label_sql(freq: str) -> str:
    return {
        "Y": "cast(year(DATE) as varchar)",
        "Q": "concat(cast(year(DATE) as varchar), 'Q', cast(quarter(DATE) as varchar))",
        "M": "strftime(DATE, '%Y-%m')",
        "W": "strftime(date_trunc('week', DATE), '%Y-%m-%d') || '/' || "
             "strftime(cast(date_trunc('week', DATE) as date) + 6, '%Y-%m-%d')",
    }[freq]


def _trunc_sql(freq: str) -> str:
    unit = {"Y": "year", "Q": "quarter", "M": "month", "W": "week"}[freq]
    return f"cast(date_trunc('{unit}', DATE) as date)"


def _period_sql(freq: str, aggs: list[str]) -> str:
    return with_views(
        f"select NAME, {_trunc_sql(freq)} as PERIOD_START, {_label_sql(freq)} as PERIOD_LABEL, "
        + ", ".join(aggs)
        + " from obs where NAME is not null and DATE is not null group by all")


_MEANS = [f"avg({c}) as {c}" for c in S.AGG_MEASURES]
_CONDITIONS = [f"coalesce(sum({c}), 0.0) as {c}" if c in S.SUMMED_EVENTS else f"avg({c}) as {c}"
               for c in S.AGG_MEASURES]


# --- step 1: station x period means (A1) -----------------------------------

@register("station_year_mean", _period_sql("Y", _MEANS))
def station_year_mean(spark, sf_dir):
    return A.station_period_means(_obs(spark, sf_dir), "Y")


@register("station_month_mean", _period_sql("M", _MEANS))
def station_month_mean(spark, sf_dir):
    return A.station_period_means(_obs(spark, sf_dir), "M")


@register("station_quarter_mean", _period_sql("Q", _MEANS))
def station_quarter_mean(spark, sf_dir):
    return A.station_period_means(_obs(spark, sf_dir), "Q")


@register("station_week_mean", _period_sql("W", [f"avg({c}) as {c}" for c in
                                                ["TMIN", "TAVG", "TMAX", "PRCP"]]))
def station_week_mean(spark, sf_dir):
    return A.station_period_means(_obs(spark, sf_dir), "W", ["TMIN", "TAVG", "TMAX", "PRCP"])


# --- step 2: other aggregates (A2, A3, A4, A9, A13) -------------------------

@register("station_year_conditions", _period_sql("Y", _CONDITIONS))
def station_year_conditions(spark, sf_dir):
    return A.station_period_conditions(_obs(spark, sf_dir), "Y")


@register("snow_totals", _period_sql("Y", ["coalesce(sum(SNOW), 0.0) as SNOW"]))
def snow_totals(spark, sf_dir):
    return A.station_period_snow_totals(_obs(spark, sf_dir), "Y")


@register("station_year_heavy_prcp", with_views(
    "select STATION, cast(year(DATE) as bigint) as YEAR, sum(PRCP) as total_precipitation "
    "from obs where PRCP is not null group by all "
    f"having sum(PRCP) > {S.HEAVY_PRCP_LIMIT} order by total_precipitation desc"))
def station_year_heavy_prcp(spark, sf_dir):
    return A.heavy_precipitation_years(_obs(spark, sf_dir))


@register("top_sun_stations", with_views(
    "select NAME, count(*) as records from obs where TSUN > 0 group by NAME "
    "order by records desc, NAME limit 20"))
def top_sun_stations(spark, sf_dir):
    return A.top_positive_stations(_obs(spark, sf_dir), "TSUN", 20)


TREND_CAP = 300.0


@register("station_trend_capped", with_views(
    "select NAME, cast(year(DATE) as bigint) as YEAR, avg(TMAX) as TMAX from obs "
    f"where TMAX is not null and NAME is not null and TMAX <= {TREND_CAP} group by all"))
def station_trend_capped(spark, sf_dir):
    return A.station_trend_capped(_obs(spark, sf_dir), "TMAX", TREND_CAP)


# --- step 3: audits (P6, P9, A5-A8, A10, D1-D4) ----------------------------

@register("suspect_temps", with_views(
    "select STATION, DATE, TAVG, TMIN, TMAX from obs "
    "where TAVG < -500 or TAVG > 500 or TMIN < -500 or TMIN > 500 "
    "or TMAX < -500 or TMAX > 512 order by STATION, DATE"))
def suspect_temps(spark, sf_dir):
    return P.suspect_temperatures(_obs(spark, sf_dir))


@register("extreme_cold", with_views(
    "select STATION, DATE, TAVG, TMIN, TMAX from obs "
    "where TAVG < -100 or TMIN < -100 or TMAX < -100 order by DATE, STATION"))
def extreme_cold(spark, sf_dir):
    return P.extreme_cold(_obs(spark, sf_dir))


_PROFILE_COLS = S.BASE_COLS + S.KEEP_MEASURES


@register("null_profile", with_views(
    "select COLUMN_NAME, NON_NULL, (select count(*) from obs) as ROWS from (select "
    + ", ".join([f"count({c}) as {c}" for c in _PROFILE_COLS]) + " from obs) "
    f"unpivot (NON_NULL for COLUMN_NAME in ({', '.join(_PROFILE_COLS)}))"))
def null_profile(spark, sf_dir):
    return AU.null_profile(_obs(spark, sf_dir), _PROFILE_COLS).select(
        "COLUMN_NAME", "NON_NULL", "ROWS")


@register("date_range", with_views(
    "select min(DATE) as min_date, max(DATE) as max_date, "
    "cast(min(year(DATE)) as bigint) as min_year, cast(max(year(DATE)) as bigint) as max_year "
    "from obs"))
def date_range(spark, sf_dir):
    return AU.date_bounds(_obs(spark, sf_dir))


@register("audit_counts", with_views(
    "select count(*) as total_rows, cast(count_if(DATE < DATE '1996-01-01') as bigint) as before_floor, "
    "count(TSUN) as tsun_non_null, cast(count_if(TSUN > 0) as bigint) as tsun_positive, "
    "count(WT01) as wt01_non_null, count(WT08) as wt08_non_null, count(WT16) as wt16_non_null "
    "from obs"))
def audit_counts(spark, sf_dir):
    return AU.audit_counts(_obs(spark, sf_dir), floor="1996-01-01")


@register("distinct_stations", with_views(
    "select distinct NAME from obs order by NAME"))
def distinct_stations(spark, sf_dir):
    return AU.distinct_stations(_obs(spark, sf_dir))


@register("distinct_station_profile", with_views(
    "select distinct STATION, LATITUDE, LONGITUDE, ELEVATION, NAME, TAVG, TMIN, TMAX from obs"))
def distinct_station_profile(spark, sf_dir):
    return AU.distinct_station_profile(_obs(spark, sf_dir))


@register("distinct_station_text", with_views(
    "select distinct concat_ws(' ', coalesce(STATION, 'None'), coalesce(NAME, 'None')) "
    "as STATION_TEXT from (select distinct STATION, NAME from obs)"))
def distinct_station_text(spark, sf_dir):
    return AU.station_text(_obs(spark, sf_dir))


@register("years_present", with_views(
    "select distinct cast(year(DATE) as bigint) as YEAR from obs where DATE is not null"))
def years_present(spark, sf_dir):
    return AU.years_present(_obs(spark, sf_dir))


@register("station_count", with_views(
    "select count(distinct NAME) as n_stations, count(*) as n_rows from obs"))
def station_count(spark, sf_dir):
    return AU.station_count(_obs(spark, sf_dir))


@register("sample_rows", with_views(
    "select STATION, DATE, NAME, TMAX from obs order by STATION, DATE, TMAX nulls first, NAME "
    "limit 5"))
def sample_rows(spark, sf_dir):
    return AU.sample_rows(_obs(spark, sf_dir).select("STATION", "DATE", "NAME", "TMAX"),
                          ["STATION", "DATE", "TMAX", "NAME"], 5)


# --- analysis page: period-start date filter, then conditions (P4 + A3) ---

@register("period_filtered_conditions", with_views(
    "select NAME, cast(date_trunc('year', DATE) as date) as PERIOD_START, "
    "cast(year(DATE) as varchar) as PERIOD_LABEL, " + ", ".join(_CONDITIONS)
    + " from obs where NAME is not null and DATE is not null "
    "and cast(date_trunc('year', DATE) as date) between DATE '1997-06-01' and DATE '2000-12-31' "
    "group by all"))
def period_filtered_conditions(spark, sf_dir):
    rows = P.period_start_range(_obs(spark, sf_dir), "1997-06-01", "2000-12-31", "Y")
    return A.station_period_conditions(rows, "Y")
