"""Registered queries: cleaning, chart series, snowfall and events,
distribution statistics and station names (build steps 4 and 6–9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import names as N
from ..operators import aggregates as A
from ..operators import clean as C
from ..operators import filters as P
from ..operators import names as NM
from ..operators import stats as ST
from ..operators.joins import sized_broadcast
from ..session import materialize
from ..sources.adapter import (city_dimension, first_station, observations, raw_observations, read_table,
                               station_names, with_views)
from . import series as G
from .catalog import _obs, register

# ---------------------------------------------------------------------------
# Step 4: cleaning of the all-text view
# ---------------------------------------------------------------------------

CLEAN_FLOOR = "1996-01-01"
_RAW_COLS = ["STATION", "DATE", "LATITUDE", "LONGITUDE", "ELEVATION", "NAME",
             "TAVG", "TMIN", "TMAX", "PRCP", "SNWD"]
_RAW_MEASURES = ["TAVG", "TMIN", "TMAX", "PRCP"]
_NUM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INF = r"(?i)^[+-]?(inf|infinity)$"


def _sql_blank(c: str) -> str:
    tokens = ", ".join("'" + t.replace("'", "''") + "'" for t in S.NA_TOKENS)
    return f"case when regexp_matches({c}, '^\\s*$') or {c} in ({tokens}) then null else {c} end"


def _sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _sql_num(c: str) -> str:
    x = f"try_cast(trim({c}) as double)"
    return (f"case when regexp_matches({c}, '{_NUM}') then case when isinf({x}) then null else {x} end "
            f"when regexp_matches({c}, '{_INF}') then {x} end")


def _clean_ctes(floor: str) -> list[str]:
    blank = ", ".join(f"{_sql_blank(c)} as {c}" for c in _RAW_COLS)
    all_null = " and ".join(f"{c} is null" for c in _RAW_COLS)
    no_data = " and ".join(f"{c} is null" for c in _RAW_MEASURES + ["SNWD"])
    bad = ", ".join(f"({m} is not null and {_sql_num(m)} is null) as bad_{m}"
                    for m in _RAW_MEASURES)
    sd = _sql_strip("DATE")
    limits = " and ".join(f"({c} is null or {c} between -500 and 512)" for c in S.TEMP_COLS)
    return [
        f"b as (select {blank} from raw_obs)",
        f"""t as (select {_sql_strip('STATION')} as STATION,
  case when regexp_matches({sd}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$')
    and try_cast({sd} as date) between DATE '{S.EARLIEST_DATE}' and DATE '{S.LATEST_DATE}'
    then try_cast({sd} as date) end as DATE,
  {_sql_num('LATITUDE')} as LATITUDE, {_sql_num('LONGITUDE')} as LONGITUDE,
  {_sql_num('ELEVATION')} as ELEVATION, {_sql_strip('NAME')} as NAME,
  {_sql_num('TAVG')} as TAVG0, {_sql_num('TMIN')} as TMIN, {_sql_num('TMAX')} as TMAX,
  {_sql_num('PRCP')} as PRCP, ({all_null}) as e, ({no_data}) as nd, {bad} from b)""",
        f"""f as (select *, coalesce(TAVG0, (TMAX + TMIN) / 2, TMAX, TMIN) as TAVG,
  DATE is null as bd, coalesce(DATE < DATE '{floor}', false) as bf from t)""",
        f"k as (select *, not ({limits}) as ol from f)",
    ]


def _with_clean(floor: str, body: str) -> str:
    return with_views(body, raw=True, ctes=_clean_ctes(floor))


@register("clean_observations", _with_clean(
    CLEAN_FLOOR, "select STATION, DATE, LATITUDE, LONGITUDE, ELEVATION, NAME, TAVG, TMIN, TMAX, "
    "PRCP from k where not e and not nd and not bd and not bf and not ol"))
def clean_observations(spark, sf_dir):
    return C.clean_observations(raw_observations(spark, sf_dir), floor=CLEAN_FLOOR)


@register("clean_report", _with_clean(
    CLEAN_FLOOR, "select count(*) as rows_in, count(*) filter (where e) as dropped_empty, "
    "count(*) filter (where not e and nd) as dropped_no_data, "
    "count(*) filter (where not e and not nd and bd) as dropped_bad_date, "
    "count(*) filter (where not e and not nd and not bd and bf) as dropped_before_floor, "
    "count(*) filter (where not (e or nd or bd or bf) and ol) as dropped_out_of_limits, "
    "count(*) filter (where not (e or nd or bd or bf or ol)) as rows_out, "
    + ", ".join(f"count(*) filter (where not (e or nd or bd or bf) and bad_{m}) as unparsed_{m}"
                for m in _RAW_MEASURES) + ", "
    + ", ".join(f"count(*) filter (where not (e or nd or bd or bf or ol) and {m} is null) as null_{m}"
                for m in _RAW_MEASURES) + " from k"))
def clean_report(spark, sf_dir):
    return C.clean_report(raw_observations(spark, sf_dir), floor=CLEAN_FLOOR)


@register("tavg_fill", with_views(
    "select STATION, DATE, NAME, coalesce(TAVG, (TMAX + TMIN) / 2, TMAX, TMIN) as TAVG, TMIN, TMAX "
    "from obs"))
def tavg_fill(spark, sf_dir):
    return C.fill_average_temperature(_obs(spark, sf_dir)).select(
        "STATION", "DATE", "NAME", "TAVG", "TMIN", "TMAX")


@register("plausible_rows", with_views(
    "select count(*) as n_rows, count(TAVG) as n_tavg from obs where "
    + " and ".join(f"({c} is null or {c} between -500 and 512)" for c in S.TEMP_COLS)))
def plausible_rows(spark, sf_dir):
    kept = C.plausible_temperatures(_obs(spark, sf_dir))
    return kept.agg(F.count(F.lit(1)).alias("n_rows"), F.count("TAVG").alias("n_tavg"))


# ---------------------------------------------------------------------------
# Step 6: chart series for one station (the alphabetically first) and window
# ---------------------------------------------------------------------------

SERIES_START, SERIES_END, SERIES_FLOOR = "1997-03-15", "2000-06-30", "1998-01-01"
_FIRST = ("(select min(concat(n_name, ' AIRPORT ', cast(s_suppkey as string), ', ', r_name, ' US')) from supplier "
          "join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)")
_W = (f"w as (select * from obs where NAME = {_FIRST} "
      f"and DATE >= DATE '{SERIES_FLOOR}' and DATE <= DATE '{SERIES_END}')")


def _station_sql(body: str) -> str:
    return with_views(body, ctes=[_W])


def _yearly_first20_sql(col: str) -> str:
    return with_views(
        "select * from (select NAME, cast(date_trunc('year', DATE) as date) as PERIOD_START, "
        f"cast(year(DATE) as varchar) as PERIOD_LABEL, avg({col}) as {col} from obs "
        "where NAME is not null and DATE is not null group by all) y "
        "where NAME in (select distinct NAME from obs where NAME is not null and DATE is not null "
        "order by NAME limit 20)")


@register("max_temp_trend", _yearly_first20_sql("TMAX"))
def max_temp_trend(spark, sf_dir):
    return G.max_temperature_trend(_obs(spark, sf_dir))


@register("snow_trend", _yearly_first20_sql("SNOW"))
def snow_trend(spark, sf_dir):
    return G.snowfall_trend(_obs(spark, sf_dir))


def _series(fn, *extra):
    def run(spark, sf_dir):
        station = first_station(spark, sf_dir)
        return fn(observations(spark, sf_dir, station), station, SERIES_START, SERIES_END, *extra,
                  floor=SERIES_FLOOR)
    return run


register("temp_lines_long", _station_sql(
    " union all ".join(f"select DATE, '{c}' as METRIC, {c} as VALUE from w"
                       for c in ["TMIN", "TAVG", "TMAX"])))(_series(G.temperature_lines))
register("rain_days", _station_sql("select DATE, 1 as Rain from w where WT16 > 0"))(
    _series(G.rain_days))
register("snow_days", _station_sql("select DATE, 1 as Snow from w where SNOW > 0"))(
    _series(G.snow_days))
register("smoke_days", _station_sql("select DATE, 1 as Smoke from w where WT08 > 0"))(
    _series(G.smoke_days))
register("fog_days", _station_sql(
    "select DATE, WT01, WT02 from w where coalesce(WT01 > 0, false) or coalesce(WT02 > 0, false)"))(
    _series(G.fog_days))
register("cloud_series", _station_sql("select DATE, ACMH from w"))(
    _series(G.measure_series, "ACMH"))
register("unlisted_type_series", _station_sql("select DATE, WT02 from w"))(
    _series(G.measure_series, "WT02"))
register("sunny_days", _station_sql("select DATE, TSUN from w where TSUN > 0"))(
    _series(G.occurrences, "TSUN"))


@register("precip_inches", with_views(
    "select NAME, DATE, round(PRCP / 10 * 0.03937, 6) as PRCP_IN from obs"))
def precip_inches(spark, sf_dir):
    out = G.precipitation_inches(_obs(spark, sf_dir))
    return out.withColumn("PRCP_IN", F.round("PRCP_IN", 6))


@register("filtered_summary", with_views(
    "select count(*) as n_rows, min(DATE) as min_date, max(DATE) as max_date, "
    "count(distinct NAME) as n_stations from obs where DATE is not null and NAME is not null "
    "and DATE >= DATE '1997-01-01' and DATE <= DATE '1999-12-31'"))
def filtered_summary(spark, sf_dir):
    return G.filtered_summary(_obs(spark, sf_dir), "1997-01-01", "1999-12-31")


# ---------------------------------------------------------------------------
# Step 7: snowfall share / ranking, event counts
# ---------------------------------------------------------------------------

SNOW_YEAR = 2000
SHARE_MIN = 0.02          # 0.01 folds nothing on the test data
EVENT_MIN_TOTAL = 10000   # 250 keeps every test year

_G = ("g as (select NAME, cast(year(DATE) as varchar) as PERIOD_LABEL, avg(SNOW) as SNOW "
      "from obs where NAME is not null and DATE is not null group by all)")


_BOX = ["min", "q1", "median", "q3", "max", "lower_whisker", "upper_whisker"]


def _rounded(df, *columns):
    """Six digits on both sides of a comparison; the operators do not round."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _conditions(spark, sf_dir, materialized: bool = False):
    """Station-year conditions (A3). Charts that read it in several branches
    (a total or means as scalar subqueries next to the main plan) get it
    written once to the shared checkpoint folder, so the observations are
    scanned once."""
    out = A.station_period_conditions(_obs(spark, sf_dir), "Y")
    return materialize(out) if materialized else out


@register("snow_share", with_views(
    "select NAME, round(SNOW, 6) as SNOW, round(SNOW / total, 6) as SHARE from o", ctes=[
        _G,
        f"s as (select NAME, sum(SNOW) as SNOW from g where PERIOD_LABEL = '{SNOW_YEAR}' "
        "group by NAME having sum(SNOW) > 0)",
        "t as (select sum(SNOW) as total from s)",
        f"o as (select case when s.SNOW / t.total < {SHARE_MIN} then 'Others' else NAME end "
        "as NAME, sum(s.SNOW) as SNOW, any_value(t.total) as total from s, t group by 1)"]))
def snow_share(spark, sf_dir):
    # One narrow row per station of the year, read by the shares and their total.
    yearly = materialize(A.station_year_snow(_obs(spark, sf_dir), SNOW_YEAR), "station-snow")
    return _rounded(A.snowfall_share(yearly, SNOW_YEAR, SHARE_MIN), "SNOW", "SHARE")


@register("snow_ranking", with_views(
    f"select NAME, sum(SNOW) as SNOW from g where PERIOD_LABEL = '{SNOW_YEAR}' group by NAME "
    f"having sum(SNOW) >= {S.SNOW_RANK_MIN} order by SNOW desc, NAME", ctes=[_G]))
def snow_ranking(spark, sf_dir):
    return A.snowfall_ranking(A.station_year_snow(_obs(spark, sf_dir), SNOW_YEAR), SNOW_YEAR)


def _flag_sum(c: str) -> str:
    return f"cast(sum(case when {c} > 0 then 1 else 0 end) as bigint)"


@register("event_counts", with_views(" union all ".join(
    f"select '{c}' as EVENT, cast(year(DATE) as bigint) as YEAR, {_flag_sum(c)} as COUNT "
    "from obs where DATE is not null group by 2" for c in S.EVENT_CHART_COLS)))
def event_counts(spark, sf_dir):
    return A.yearly_event_counts(_obs(spark, sf_dir), S.EVENT_CHART_COLS)


_EV_FROM, _EV_TO = 1996, 2000


@register("event_counts_valid_years", with_views(
    "select YEAR, " + ", ".join(f'{c} as "{A.chart_label(c)}"' for c in S.EVENT_CHART_COLS)
    + f" from v where (not exists (select 1 from v where YEAR = {_EV_FROM}) or YEAR >= {_EV_FROM})"
    f" and (not exists (select 1 from v where YEAR = {_EV_TO}) or YEAR <= {_EV_TO})", ctes=[
        "y as (select cast(year(DATE) as bigint) as YEAR, "
        + ", ".join(f"{_flag_sum(c)} as {c}" for c in S.EVENT_CHART_COLS)
        + " from obs where DATE is not null group by 1)",
        f"v as (select * from y where {' + '.join(S.EVENT_CHART_COLS)} >= {EVENT_MIN_TOTAL})"]))
def event_counts_valid_years(spark, sf_dir):
    return A.yearly_event_frequencies(_obs(spark, sf_dir), S.EVENT_CHART_COLS,
                                      EVENT_MIN_TOTAL, _EV_FROM, _EV_TO)


# ---------------------------------------------------------------------------
# Step 8: box statistics, imputation, correlation
# ---------------------------------------------------------------------------

def _box_sql(sources: list[str], keys: list[str]) -> str:
    k = ", ".join(keys)
    lf, uf = "q.q1 - 1.5 * (q.q3 - q.q1)", "q.q3 + 1.5 * (q.q3 - q.q1)"
    q = (f"q as (select {k}, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as median, "
         f"quantile_cont(x, 0.75) as q3 from v group by {k})")
    return with_views(
            f"select {', '.join('v.' + c for c in keys)}, count(*) as n, round(min(x), 6) as \"min\", "
            "round(any_value(q.q1), 6) as q1, round(any_value(q.median), 6) as median, "
            "round(any_value(q.q3), 6) as q3, round(max(x), 6) as \"max\", "
            f"round(min(case when x >= {lf} then x end), 6) as lower_whisker, "
            f"round(max(case when x <= {uf} then x end), 6) as upper_whisker, "
            f"cast(count_if(x < {lf} or x > {uf}) as bigint) as n_outliers "
            f"from v join q using ({k}) group by {', '.join('v.' + c for c in keys)}",
            ctes=sources + [q])


@register("temp_box_by_year", _box_sql([
    "g as (select NAME, cast(year(DATE) as bigint) as YEAR, avg(TAVG) as TAVG from obs "
    "where NAME is not null and DATE is not null group by all)",
    "v as (select YEAR, TAVG as x from g where TAVG is not null)"], ["YEAR"]))
def temp_box_by_year(spark, sf_dir):
    return _rounded(ST.yearly_box_of_station_means(_conditions(spark, sf_dir), "TAVG"), *_BOX)


@register("yearly_distributions", _box_sql([
    "v as (" + " union all ".join(
        f"select '{c}' as MEASURE, cast(year(DATE) as bigint) as YEAR, {c} as x from obs "
        f"where DATE is not null and {c} is not null" for c in S.DISTRIBUTION_COLS) + ")"],
    ["MEASURE", "YEAR"]))
def yearly_distributions(spark, sf_dir):
    return _rounded(ST.yearly_distributions(_obs(spark, sf_dir), S.DISTRIBUTION_COLS), *_BOX)


_A3_SQL = [
    "g as (select NAME, cast(year(DATE) as varchar) as PERIOD_LABEL, "
    + ", ".join(f"coalesce(sum({c}), 0.0) as {c}" if c in S.SUMMED_EVENTS
                else f"avg({c}) as {c}" for c in S.AGG_MEASURES)
    + " from obs where NAME is not null and DATE is not null group by all)",
    "m as (select " + ", ".join(f"avg({c}) as {c}" for c in S.CORRELATION_MEASURES) + " from g)",
    "f as (select g.NAME, g.PERIOD_LABEL, "
    + ", ".join(f"coalesce(g.{c}, m.{c}) as {c}" for c in S.CORRELATION_MEASURES)
    + " from g, m)"]


@register("imputed_means", with_views(
    "select NAME, PERIOD_LABEL, "
    + ", ".join(f"round({c}, 6) as {c}" for c in S.CORRELATION_MEASURES) + " from f",
    ctes=_A3_SQL))
def imputed_means(spark, sf_dir):
    filled = ST.impute_means(_conditions(spark, sf_dir, materialized=True),
                             S.CORRELATION_MEASURES)
    return filled.select("NAME", "PERIOD_LABEL",
                         *[F.round(c, 6).alias(c) for c in S.CORRELATION_MEASURES])


def _corr_sql() -> str:
    cols = S.CORRELATION_MEASURES
    cells = " union all ".join(
        f"select '{a}' as COL_A, '{b}' as COL_B, corr({a}, {b}) as x from f"
        for a in cols for b in cols)
    return with_views(
        "select COL_A, COL_B, round(case when isnan(x) then null else x end, 6) as CORR from c",
        ctes=_A3_SQL + [f"c as ({cells})"])


@register("correlation_matrix", _corr_sql())
def correlation_matrix(spark, sf_dir):
    return _rounded(ST.correlation_matrix(_conditions(spark, sf_dir, materialized=True),
                                          S.CORRELATION_MEASURES), "CORR")


# ---------------------------------------------------------------------------
# Step 9: station names
# ---------------------------------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in S.CITY_STOP_WORDS)
_CITY_WORDS_SQL = (
    "case when NAME <> '' then array_to_string(ws[1:coalesce(list_position("
    f"list_transform(ws, lambda w: upper(w) in ({_STOPS})), true), len(ws) + 1) - 1], ' ') end")


def _names(spark, sf_dir):
    return _obs(spark, sf_dir).select("NAME").filter(F.col("NAME").isNotNull()).distinct()


@register("city_part", with_views(
    "select distinct NAME, case when NAME <> '' then trim(split_part(NAME, ',', 1)) end as CITY_PART "
    "from obs where NAME is not null"))
def city_part(spark, sf_dir):
    return _names(spark, sf_dir).select("NAME", N.city_part("NAME").alias("CITY_PART"))


@register("state_part", with_views(
    "select distinct NAME, case when len(string_split(NAME, ',')) > 1 "
    "then trim(string_split(NAME, ',')[2]) end as STATE_PART from obs where NAME is not null"))
def state_part(spark, sf_dir):
    return _names(spark, sf_dir).select("NAME", N.state_part("NAME").alias("STATE_PART"))


@register("city_words", with_views(
    "select NAME, " + _CITY_WORDS_SQL + " as CITY_WORDS from (select NAME, "
    "list_filter(string_split_regex(trim(split_part(NAME, ',', 1)), '\\s+'), lambda w: w <> '') "
    "as ws from (select distinct NAME from obs where NAME is not null))"))
def city_words(spark, sf_dir):
    return _names(spark, sf_dir).select("NAME", N.city_words("NAME").alias("CITY_WORDS"))


def _exception_sql(col: str) -> str:
    whens = " ".join(f"when contains(upper({col}), '{k}') then '{v}'" for k, v in S.CITY_EXCEPTIONS)
    return f"case {whens} end"


def _match_sql(source: str, col: str, body: str) -> str:
    words = f"regexp_extract_all(upper({col}), '\\w+')"
    return with_views(body, cities=True, ctes=[
        f"s as ({source})",
        f"t as (select {col}, ' ' || array_to_string({words}, ' ') || ' ' as tx from s "
        f"where len({words}) > 0)",
        "c as (select distinct upper(city) as CITY from cities where city is not null "
        "and city <> '')",
        f"h as (select {col}, CITY, row_number() over (partition by {col} "
        "order by length(CITY) desc, CITY) as rn from t join c on contains(tx, ' ' || CITY || ' '))",
        f"r as (select s.{col}, coalesce({_exception_sql('s.' + col)}, h.CITY) as CITY "
        f"from s left join h on s.{col} = h.{col} and h.rn = 1)"])


def _cities(spark, sf_dir):
    return NM.prepare_cities(city_dimension(spark, sf_dir))


@register("city_match", _match_sql(
    "select distinct NAME from obs where NAME is not null", "NAME", "select NAME, CITY from r"))
def city_match(spark, sf_dir):
    return NM.match_cities(_obs(spark, sf_dir), _cities(spark, sf_dir))


@register("city_match_rate", _match_sql(
    "select distinct concat_ws(' ', coalesce(STATION, 'None'), coalesce(NAME, 'None')) as STATION_TEXT "
    "from (select distinct STATION, NAME from obs)", "STATION_TEXT",
    "select count(*) as n_stations, count(CITY) as n_matched from r"))
def city_match_rate(spark, sf_dir):
    from ..operators.audit import station_text
    return NM.city_match_rate(station_text(_obs(spark, sf_dir)), _cities(spark, sf_dir))


def _pref_sql() -> str:
    by_city: dict[str, list[str]] = {}
    for station, city in S.CITY_EXCEPTIONS:
        by_city.setdefault(city.upper(), []).append(station.lower().split(",", 1)[0].strip())
    parts = []
    for city, stations in by_city.items():
        any_hit = " or ".join(f"contains(lower(NAME), '{s}')" for s in stations)
        parts.append(f"(upper(city) = '{city}' and ({any_hit}))")
    return " or ".join(parts)


@register("station_choice", with_views(
    "select QUERY, CANDIDATE as CHOSEN, POSITION, "
    "case r when 0 then 'preferred' when 1 then 'city' else 'first' end as RULE "
    "from (select *, row_number() over (partition by QUERY order by r, POSITION, CANDIDATE) "
    "as rn from c) where rn = 1", ctes=[
        "q as (select n_name || ', ' || r_name as QUERY, lower(n_name) as city, "
        "r_name || ' US' as STATE from nation join region on n_regionkey = r_regionkey)",
        "s as (select distinct STATION, NAME from obs where NAME is not null)",
        f"c as (select QUERY, STATION as POSITION, NAME as CANDIDATE, case when {_pref_sql()} "
        "then 0 when contains(lower(NAME), city) then 1 else 2 end as r "
        "from q join s on trim(split_part(NAME, ',', 2)) = STATE)"]))
def station_choice(spark, sf_dir):
    nation = read_table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    queries = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat_ws(", ", "n_name", "r_name").alias("QUERY"),
        F.concat(F.col("r_name"), F.lit(" US")).alias("STATE"))
    stations = (_obs(spark, sf_dir).select("STATION", "NAME").filter(F.col("NAME").isNotNull())
                .distinct().withColumn("STATE", N.state_part("NAME")))
    candidates = stations.join(sized_broadcast(queries), on="STATE").select(
        "QUERY", F.col("STATION").alias("POSITION"), F.col("NAME").alias("CANDIDATE"))
    return NM.choose_station(candidates)


# ---------------------------------------------------------------------------
# Lookups and remaining chart tables (J1, S15, P20, A21, W1, A2 via G2)
# ---------------------------------------------------------------------------

def _values_sql(rows, names) -> str:
    def lit(v):
        return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(values {body}) as t({', '.join(names)})"


def _label_rows():
    type_labels, chart_labels = dict(S.DATA_TYPE_LABELS), dict(S.CHART_LABELS)
    codes = list(dict.fromkeys([c for c, _ in S.DATA_TYPE_LABELS] + [c for c, _ in S.CHART_LABELS]))
    return [(c, type_labels.get(c), chart_labels.get(c)) for c in codes]


@register("null_profile_labeled", with_views(
    "select p.COLUMN_NAME, p.NON_NULL, "
    "coalesce(l.TYPE_LABEL, 'Unknown (' || p.COLUMN_NAME || ')') as TYPE_LABEL, "
    "coalesce(l.CHART_LABEL, p.COLUMN_NAME) as CHART_LABEL, e.ELEMENT_GROUP, e.MEANING "
    "from p left join lab l on p.COLUMN_NAME = l.CODE left join el e on p.COLUMN_NAME = e.CODE",
    ctes=["p as (select * from (select " + ", ".join(
        f"count({c}) as {c}" for c in S.BASE_COLS + S.KEEP_MEASURES) + " from obs) "
        f"unpivot (NON_NULL for COLUMN_NAME in ({', '.join(S.BASE_COLS + S.KEEP_MEASURES)})))",
        "lab as (select * from " + _values_sql(_label_rows(), ["CODE", "TYPE_LABEL", "CHART_LABEL"]) + ")",
        "el as (select * from " + _values_sql(S.ELEMENTS, ["CODE", "ELEMENT_GROUP", "MEANING"]) + ")"]))
def null_profile_labeled(spark, sf_dir):
    from ..operators.audit import null_profile
    from ..sources.dimensions import with_element_meaning, with_labels
    prof = null_profile(_obs(spark, sf_dir), S.BASE_COLS + S.KEEP_MEASURES).select(
        "COLUMN_NAME", "NON_NULL")
    return with_element_meaning(with_labels(prof, "COLUMN_NAME"), "COLUMN_NAME")


def _metrics(kind: str, columns: dict[str, str]):
    aggs = ", ".join(f"{fn} as {c}" for c, fn in columns.items())

    @register(f"station_{kind}_metrics", with_views(
        f"select PERIOD_START, {', '.join(columns)} from g where NAME = {_FIRST} order by PERIOD_START", ctes=[
            f"g as (select NAME, cast(date_trunc('year', DATE) as date) as PERIOD_START, {aggs} from obs "
            "where NAME is not null and DATE is not null group by all)"]))
    def run(spark, sf_dir):
        station = first_station(spark, sf_dir)
        rows = observations(spark, sf_dir, station)
        return G.station_metrics(A.station_period_conditions(rows, "Y"), station, kind)


_metrics("temperature", {c: f"avg({c})" for c in ("TMIN", "TAVG", "TMAX")})
_metrics("precipitation", {c: f"avg({c})" for c in ("PRCP", "SNOW")})
_metrics("events", {c: f"coalesce(sum({c}), 0.0)" for c in ("WT16", "WT08", "WT01")})


@register("control_summary", with_views(
    "select min(DATE) as min_date, max(DATE) as max_date, count(distinct NAME) as n_stations, "
    "case when min(NAME) <> '' then trim(split_part(min(NAME), ',', 1)) end as first_city "
    "from obs"))
def control_summary(spark, sf_dir):
    return G.control_summary(_obs(spark, sf_dir))


@register("snow_share_all_years", with_views(
    "select YEAR, NAME, round(SNOW, 6) as SNOW, round(SNOW / sum(SNOW) over (partition by YEAR), 6) "
    "as SHARE from s", ctes=[
        "g as (select NAME, cast(year(DATE) as bigint) as YEAR, avg(SNOW) as SNOW from obs "
        "where NAME is not null and DATE is not null group by all)",
        "s as (select YEAR, NAME, sum(SNOW) as SNOW from g group by all having sum(SNOW) > 0)"]))
def snow_share_all_years(spark, sf_dir):
    yearly = materialize(A.station_year_snow(_obs(spark, sf_dir)), "station-snow")
    return _rounded(A.snowfall_shares_all_years(yearly), "SNOW", "SHARE")


@register("snow_trend_total", with_views(
    "select * from (select NAME, cast(date_trunc('year', DATE) as date) as PERIOD_START, "
    "cast(year(DATE) as varchar) as PERIOD_LABEL, coalesce(sum(SNOW), 0.0) as SNOW from obs "
    "where NAME is not null and DATE is not null group by all) y "
    "where NAME in (select distinct NAME from obs where NAME is not null and DATE is not null "
    "order by NAME limit 20)"))
def snow_trend_total(spark, sf_dir):
    return G.snowfall_trend(_obs(spark, sf_dir), metric="total")


_PAGE_COLS = ["STATION", "DATE", "NAME", "TMIN", "TAVG", "TMAX", "PRCP"]


@register("results_page", with_views(
    "select " + ", ".join(_PAGE_COLS) + " from obs where DATE is not null and NAME is not null "
    "and DATE >= DATE '1997-01-01' and DATE <= DATE '1999-12-31' order by "
    + ", ".join(f"{c} nulls first" for c in _PAGE_COLS) + f" limit {S.PAGE_SIZE} offset {2 * S.PAGE_SIZE}"))
def results_page(spark, sf_dir):
    """Third page (10 rows) of the results table behind the fetch page, reached
    by two seeks behind the last row shown (T8, G17)."""
    from ..operators.audit import page_after, place_after
    rows = G.filtered_observations(_obs(spark, sf_dir), "1997-01-01", "1999-12-31").select(*_PAGE_COLS)
    place = None
    for _ in range(2):
        place = place_after(page_after(rows, _PAGE_COLS, place, S.PAGE_SIZE).collect(), _PAGE_COLS, place)
    return page_after(rows, _PAGE_COLS, place, S.PAGE_SIZE)


@register("complete_station_years", with_views(
    "select count(*) as n_station_years, count(*) filter (where "
    + " and ".join(f"{c} is not null" for c in S.CORRELATION_MEASURES)
    + ") as n_complete from g", ctes=[_A3_SQL[0]]))
def complete_station_years(spark, sf_dir):
    """Station-years, and those with every correlation measure present (P18),
    in one aggregate."""
    grouped = _conditions(spark, sf_dir)
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in S.CORRELATION_MEASURES])
    return grouped.agg(F.count(F.lit(1)).alias("n_station_years"),
                       F.count_if(complete).alias("n_complete"))


# ---------------------------------------------------------------------------
# Branches that the plain view never reaches: rows and names made to fire them
# ---------------------------------------------------------------------------

@register("station_day_mean", with_views(
    "select NAME, DATE as PERIOD_START, strftime(DATE, '%Y-%m-%d') as PERIOD_LABEL, avg(TMAX) as TMAX from obs "
    "where NAME is not null and DATE is not null group by all"))
def station_day_mean(spark, sf_dir):
    """Daily periods."""
    return A.station_period_means(_obs(spark, sf_dir), "D", ["TMAX"])


@register("clean_empty_rows", with_views(
    "select count(*) as rows_in, count(*) filter (where l_partkey % 5 = 0) as dropped_empty from lineitem"))
def clean_empty_rows(spark, sf_dir):
    """Rows whose every cell is blank or missing (C4): every fifth part's."""
    line = read_table(spark, sf_dir, "lineitem")
    blank = F.col("l_partkey") % 5 == 0
    cell = lambda v: F.when(blank, F.lit(" ")).otherwise(F.lit(v))
    raw = line.select(cell("S").alias("STATION"), cell("2000-01-01").alias("DATE"), cell("1").alias("LATITUDE"),
                      cell("2").alias("LONGITUDE"), cell("3").alias("ELEVATION"), cell("N").alias("NAME"),
                      F.when(~blank, F.lit("5")).alias("TMAX"))
    return C.clean_report(raw, floor=CLEAN_FLOOR).select("rows_in", "dropped_empty")


@register("missing_required_columns", with_views(
    "select count(*) as n_rows, false as ok, true as names_date from obs"))
def missing_required_columns(spark, sf_dir):
    """A table without a base column is refused."""
    obs = _obs(spark, sf_dir)
    ok, why = C.check_required(obs.drop("DATE"))
    return obs.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(ok).alias("ok"), F.lit("DATE" in why).alias("names_date"))


def _exception_names():
    """Each supplier's name becomes one that holds a station of the exception list."""
    keys = [k for k, _ in S.CITY_EXCEPTIONS]
    return keys, F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("s_suppkey") % len(keys) + 1).cast("int"))


_EXC_KEYS = "[" + ", ".join("'" + k.replace("'", "''") + "'" for k, _ in S.CITY_EXCEPTIONS) + "]"


@register("exception_city_match", _match_sql(
    f"select distinct 'Station ' || {_EXC_KEYS}[s_suppkey % {len(S.CITY_EXCEPTIONS)} + 1] || ' ' || s_suppkey as NAME "
    "from supplier", "NAME", "select NAME, CITY from r"))
def exception_city_match(spark, sf_dir):
    """Station names of the exception list get their city from it."""
    _, key = _exception_names()
    named = read_table(spark, sf_dir, "supplier").select(
        F.concat_ws(" ", F.lit("Station"), key, F.col("s_suppkey").cast("string")).alias("NAME"))
    return NM.match_cities(named, _cities(spark, sf_dir))


@register("preferred_station_choice", with_views(
    "select QUERY, CANDIDATE as CHOSEN, POSITION, case r when 0 then 'preferred' when 1 then 'city' else 'first' end as RULE "
    "from (select *, row_number() over (partition by QUERY order by r, POSITION, CANDIDATE) as rn from c) where rn = 1",
    ctes=["q as (select * from (values " + ", ".join(
        f"('{c}, ST', '{c.lower()}')" for c in dict.fromkeys(c for _, c in S.CITY_EXCEPTIONS)) + ") as t(QUERY, city))",
          f"s as (select 'P' || s_suppkey as STATION, {_EXC_KEYS}[s_suppkey % {len(S.CITY_EXCEPTIONS)} + 1] || ' ' || s_suppkey "
          "as NAME from supplier)",
          f"c as (select QUERY, STATION as POSITION, NAME as CANDIDATE, case when {_pref_sql()} then 0 "
          "when contains(lower(NAME), city) then 1 else 2 end as r from q, s)"]))
def preferred_station_choice(spark, sf_dir):
    """The preferred station of a city wins over all others."""
    cities = list(dict.fromkeys(c for _, c in S.CITY_EXCEPTIONS))
    _, key = _exception_names()
    stations = read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("POSITION"),
        F.concat_ws(" ", key, F.col("s_suppkey").cast("string")).alias("CANDIDATE"))
    queries = F.explode(F.array(*[F.lit(f"{c}, ST") for c in cities]))  # the list's few cities
    return NM.choose_station(stations.select(queries.alias("QUERY"), "POSITION", "CANDIDATE"))


_DESK = "'Desk of ' || lower('Customer#' || lpad(o_custkey::varchar, 9, '0')) || ' for CUSTOMER#' || lpad((o_custkey // 2)::varchar, 9, '0')"


@register("exception_table_match", "with e as (select c_custkey as p, upper(c_name) as k, 'City ' || c_nationkey as CITY from customer), "
          f"n as (select distinct {_DESK} as NAME from orders) "
          "select NAME, arg_min(CITY, p) as CITY from n join e on contains(upper(NAME), k) group by NAME")
def exception_table_match(spark, sf_dir):
    """Names matched with a table of exceptions that grows with the data."""
    digits = lambda c: F.lpad(c.cast("string"), 9, "0")
    key = F.col("o_custkey")
    names = read_table(spark, sf_dir, "orders").select(F.concat(
        F.lit("Desk of customer#"), digits(key), F.lit(" for CUSTOMER#"), digits(F.floor(key / 2))).alias("NAME"))
    exceptions = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("PRIORITY"), F.col("c_name").alias("STATION_KEY"),
        F.concat(F.lit("City "), F.col("c_nationkey").cast("string")).alias("CITY"))
    return NM.exception_cities(names, exceptions)


@register("screen_columns", with_views(
    "select count(*) as n_rows, count(DATE) as n_dates, min(strftime(DATE, '%Y-%m-%d')) as first_day, "
    "'STATION,NAME' as text_columns, cast(0 as double) as missing_total from obs"))
def screen_columns(spark, sf_dir):
    """Columns as the results page prepares them: date column resolved (P23),
    absent measures filled (P16), text columns named (P22), dates formatted (F14)."""
    obs = _obs(spark, sf_dir).withColumnRenamed("DATE", "date").drop("PRCP")
    rows = P.fill_missing_columns(P.resolve_date_column(obs), ["PRCP"], fill=0.0)
    text = ",".join(P.string_columns(rows))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count("DATE").alias("n_dates"),
                    F.min(P.iso_date("DATE")).alias("first_day"), F.lit(text).alias("text_columns"),
                    F.sum("PRCP").alias("missing_total"))


@register("validated_series", _station_sql("select DATE, TMAX from w"))
def validated_series(spark, sf_dir):
    """A series whose inputs are checked first."""
    if not P.validate_dates(SERIES_START, SERIES_END) or not P.validate_inputs("X", S.DATA_TYPE_LABELS[0][0]) \
            or P.validate_dates(SERIES_END, SERIES_START) or P.validate_inputs("", S.DATA_TYPE_LABELS[0][0]):
        raise RuntimeError("the input checks are wrong")
    station = first_station(spark, sf_dir)
    return G.station_window(observations(spark, sf_dir, station), station, SERIES_START, SERIES_END,
                            SERIES_FLOOR).select("DATE", "TMAX")


@register("table_catalogue", with_views(
    "select 'stations_view' as TABLE_NAME, 'STATION,NAME' as COLUMNS, count(*) as n_rows from supplier"))
def table_catalogue(spark, sf_dir):
    """Catalogue entry, column listing and row count of a named table."""
    from ..operators import audit as AU
    table = station_names(spark, sf_dir)
    table.createOrReplaceTempView("stations_view")
    name = next(t for t in AU.list_tables(spark) if t == "stations_view")
    return AU.row_count(table).select(F.lit(name).alias("TABLE_NAME"),
                                      F.lit(",".join(AU.column_names(table))).alias("COLUMNS"), "n_rows")


@register("preferred_station_counts", with_views(
    "select upper(c) as CITY, count(*) as n_stations from (values "
    + ", ".join("('{}', '{}')".format(k.replace("'", "''").upper(), c) for k, c in S.CITY_EXCEPTIONS)
    + f") as t(k, c) join supplier on upper({_EXC_KEYS}[s_suppkey % {len(S.CITY_EXCEPTIONS)} + 1]) = k group by 1"))
def preferred_station_counts(spark, sf_dir):
    """Stations of the table that a city prefers, by the exception list turned round."""
    from ..sources.dimensions import preferred_stations
    _, key = _exception_names()
    preferred = preferred_stations(spark).select("CITY", F.explode("STATIONS").alias("KEY"))
    stations = read_table(spark, sf_dir, "supplier").select(F.upper(key).alias("KEY"))
    # A fixed list of a few rows: a bounded broadcast.
    return stations.join(F.broadcast(preferred), "KEY").groupBy("CITY").agg(F.count(F.lit(1)).alias("n_stations"))
