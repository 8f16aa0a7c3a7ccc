"""Registered queries that write and read back: table append and purges,
CSV round trip, incremental ingest and the batch report (build steps 5, 10).

Each run writes under a fresh folder of the shared checkpoint folder.
"""

from __future__ import annotations

import os
import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import aggregates as AG
from ..operators import clean as C
from ..operators import names as NM
from ..session import scratch_path
from ..sources import csv as CSV
from ..sources import files as FS
from ..sources import store as ST
from ..sources.adapter import city_dimension, raw_observations, with_views
from ..streaming import ingest as IN
from . import report as R
from .catalog import ORACLES, _obs, register
from .queries_more import CLEAN_FLOOR, _clean_ctes, _match_sql

_CLEAN_COLS = ["STATION", "DATE", "LATITUDE", "LONGITUDE", "ELEVATION", "NAME",
               "TAVG", "TMIN", "TMAX", "PRCP"]
_CLEAN_ORACLE = with_views(
    "select " + ", ".join(_CLEAN_COLS) + " from k where not e and not nd and not bd "
    "and not bf and not ol", raw=True, ctes=_clean_ctes(CLEAN_FLOOR))
_TABLE_COLS = S.BASE_COLS + S.KEEP_MEASURES
PURGE_FLOOR = "1997-01-01"


def _stored_copy(spark, sf_dir, label: str) -> str:
    path = scratch_path(spark, label)
    ST.ensure_table(spark, path)
    ST.append_observations(_obs(spark, sf_dir), path)
    return path


@register("append_roundtrip", _match_sql(
    "select distinct NAME from obs where NAME is not null", "NAME",
    "select " + ", ".join(f"o.{c}" for c in S.BASE_COLS) + ", r.CITY as CITY_NAME, "
    + ", ".join(f"o.{c}" for c in S.KEEP_MEASURES)
    + " from obs o left join r on o.NAME = r.NAME"))
def append_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "table")
    ST.ensure_table(spark, path)
    cities = NM.prepare_cities(city_dimension(spark, sf_dir))
    ST.append_observations(NM.with_city_name(_obs(spark, sf_dir), cities), path)
    return ST.read_observations(spark, path).select(*S.STORED_COLS)


_SUSPECT = ("coalesce(TAVG < -500 or TAVG > 500, false) or coalesce(TMIN < -500 or TMIN > 500, false)"
            " or coalesce(TMAX < -500 or TMAX > 512, false)")


@register("purge_suspect", with_views(
    "select " + ", ".join(_TABLE_COLS) + f" from obs where not ({_SUSPECT})"))
def purge_suspect(spark, sf_dir):
    path = _stored_copy(spark, sf_dir, "purge-suspect")
    ST.purge_suspect_temperatures(spark, path)
    return ST.read_observations(spark, path).select(*_TABLE_COLS)


@register("purge_before_floor", with_views(
    "select " + ", ".join(_TABLE_COLS) + f" from obs where DATE >= DATE '{PURGE_FLOOR}'"))
def purge_before_floor(spark, sf_dir):
    path = _stored_copy(spark, sf_dir, "purge-floor")
    ST.purge_before(spark, path, PURGE_FLOOR)
    return ST.read_observations(spark, path).select(*_TABLE_COLS)


def _write_raw_files(spark, sf_dir, root: str, two_layouts: bool) -> None:
    raw = raw_observations(spark, sf_dir)
    if not two_layouts:
        CSV.write_csv(raw, os.path.join(root, "a"))
        return
    even = F.coalesce(F.length("NAME"), F.lit(0)) % 2 == 0
    CSV.write_csv(raw.filter(even), os.path.join(root, "a"))
    CSV.write_csv(raw.filter(~even).select(*reversed(raw.columns)), os.path.join(root, "b"))


@register("csv_roundtrip", _CLEAN_ORACLE)
def csv_roundtrip(spark, sf_dir):
    root = scratch_path(spark, "raw-csv")
    _write_raw_files(spark, sf_dir, root, two_layouts=True)
    raw = CSV.read_raw_dir(spark, os.path.join(root, "*", "*.csv"))
    return C.clean_observations(raw, CLEAN_FLOOR).select(*_CLEAN_COLS)


@register("incremental_ingest", _CLEAN_ORACLE)
def incremental_ingest(spark, sf_dir):
    """Two folders whose files hold the columns in opposite orders, taken in
    by one stream; a second run finds nothing new."""
    table, again = _ingested(spark, sf_dir)
    if again.files or again.rows:
        raise RuntimeError("second ingest run picked up files already processed")
    return ST.read_observations(spark, table).select(*_CLEAN_COLS)


def _ingested(spark, sf_dir):
    root = scratch_path(spark, "stream")
    raw_dir, table, ckpt = (os.path.join(root, x) for x in ("raw", "table", "ckpt"))
    _write_raw_files(spark, sf_dir, raw_dir, two_layouts=True)
    IN.ingest(spark, os.path.join(raw_dir, "*"), table, ckpt, floor=CLEAN_FLOOR)
    return table, IN.ingest(spark, os.path.join(raw_dir, "*"), table, ckpt, floor=CLEAN_FLOOR)


def _undated(obs):
    """The observations with every ninth part's date lost."""
    return obs.withColumn("DATE", F.when(F.col("TSUN") % 9 != 0, F.col("DATE")))


_UNDATED = "case when TSUN % 9 <> 0 then DATE end"


@register("ingest_then_append_then_purge", with_views(
    "select " + ", ".join(_CLEAN_COLS) + " from (select " + ", ".join(_CLEAN_COLS)
    + " from k where not e and not nd and not bd and not bf and not ol union all select "
    + ", ".join(f"{_UNDATED} as DATE" if c == "DATE" else c for c in _CLEAN_COLS)
    + f" from obs where {_UNDATED} is not null) where not ({_SUSPECT})",
    raw=True, ctes=_clean_ctes(CLEAN_FLOOR)))
def ingest_then_append_then_purge(spark, sf_dir):
    """One table that the stream, the batch append and the purge all write."""
    table, _ = _ingested(spark, sf_dir)
    ST.append_observations(_undated(_obs(spark, sf_dir)), table)
    removed = ST.purge_suspect_temperatures(spark, table)
    if not removed.rows or ST.purge_suspect_temperatures(spark, table).rows:
        raise RuntimeError("the purge must remove its rows, once")
    return ST.read_observations(spark, table).select(*_CLEAN_COLS)


@register("batch_replay_after_purge", with_views(
    "select " + ", ".join(_TABLE_COLS) + f" from obs where not ({_SUSPECT})"))
def batch_replay_after_purge(spark, sf_dir):
    """A landed batch is replayed before and after a purge: it changes nothing (ST1)."""
    path = scratch_path(spark, "replayed")
    obs = _obs(spark, sf_dir)
    ST.append_batch(obs, path, "source-0")
    ST.append_batch(obs, path, "source-0")
    ST.purge_suspect_temperatures(spark, path)
    ST.append_batch(obs, path, "source-0")
    return ST.read_observations(spark, path).select(*_TABLE_COLS)


DEDUPE_YEAR = 1998


@register("append_dedupe_year", with_views(
    "select STATION, DATE, count(*) as n_rows from (select STATION, DATE from obs union all "
    f"select distinct STATION || '-new', DATE from obs where year(DATE) = {DEDUPE_YEAR}) group by STATION, DATE"))
def append_dedupe_year(spark, sf_dir):
    """A batch of one year, half of its keys stored already, appended without repeats."""
    path = _stored_copy(spark, sf_dir, "dedupe-year")
    year = _obs(spark, sf_dir).filter(F.year("DATE") == DEDUPE_YEAR)
    new = year.withColumn("STATION", F.concat("STATION", F.lit("-new")))
    ST.append_observations(year.unionByName(new), path, dedupe_keys=("STATION", "DATE"))
    return ST.read_observations(spark, path).groupBy("STATION", "DATE").agg(F.count(F.lit(1)).alias("n_rows"))


@register("count_before_floor", with_views(
    f"select count(*) as n_rows from obs where DATE < DATE '{PURGE_FLOOR}'"))
def count_before_floor(spark, sf_dir):
    return ST.count_before(spark, _stored_copy(spark, sf_dir, "count-floor"), PURGE_FLOOR)


@register("append_dedupe", with_views(
    "select STATION, DATE, count(*) as n_rows from (select distinct STATION, DATE from obs) group by all"))
def append_dedupe(spark, sf_dir):
    """The same rows appended three times, deduplicated by station and date."""
    path = scratch_path(spark, "dedupe")
    for _ in range(3):
        ST.append_observations(_obs(spark, sf_dir), path, dedupe_keys=("STATION", "DATE"))
    return ST.read_observations(spark, path).groupBy("STATION", "DATE").agg(F.count(F.lit(1)).alias("n_rows"))


_N_CLEAN = "(select count(*) from k where not e and not nd and not bd and not bf and not ol)"


def _statuses(spark, rows):
    return spark.createDataFrame([(n, r.ok, r.rows) for n, r in rows], "STEP string, OK boolean, ROWS bigint")


@register("import_latest_result", with_views(
    f"select * from (values ('import', true, {_N_CLEAN}), ('empty', false, 0), ('stored', true, {_N_CLEAN})) "
    "as t(STEP, OK, ROWS)", raw=True, ctes=_clean_ctes(CLEAN_FLOOR)))
def import_latest_result(spark, sf_dir):
    """Status of importing the newest raw file, and of one whose rows all go."""
    root = scratch_path(spark, "import")
    table = os.path.join(root, "table")
    raw = raw_observations(spark, sf_dir)
    # The newest import is a folder of part files; as plain text it would be several times the tables.
    CSV.write_csv(raw, os.path.join(root, "raw"), compressed=True)
    done = ST.import_latest(spark, os.path.join(root, "raw"), table, CLEAN_FLOOR, os.path.join(root, "clean"))
    FS.delete(spark, os.path.join(root, "raw"))  # taken in
    CSV.write_csv(raw.withColumn("DATE", F.lit("no date")), os.path.join(root, "bad"), compressed=True)
    empty = ST.import_latest(spark, os.path.join(root, "bad"), table, CLEAN_FLOOR, os.path.join(root, "clean-bad"))
    stored = ST.WriteResult(True, ST.read_observations(spark, table).count(), "")
    return _statuses(spark, [("import", done), ("empty", empty), ("stored", stored)])


@register("rebuild_result", with_views(
    f"select * from (values ('rebuild', true, {_N_CLEAN}), ('empty', false, 0), ('kept', true, {_N_CLEAN})) "
    "as t(STEP, OK, ROWS)", raw=True, ctes=_clean_ctes(CLEAN_FLOOR)))
def rebuild_result(spark, sf_dir):
    """Status of rebuilding a filled table from clean files, and from none that count."""
    root, table = scratch_path(spark, "rebuild"), _stored_copy(spark, sf_dir, "rebuild-table")
    CSV.write_csv(C.clean_observations(raw_observations(spark, sf_dir), CLEAN_FLOOR), os.path.join(root, "clean"))
    done = ST.rebuild_from_clean_files(spark, os.path.join(root, "clean"), table)
    empty = ST.rebuild_from_clean_files(spark, os.path.join(root, "clean"), table, floor="2200-01-01")
    kept = ST.WriteResult(True, ST.read_observations(spark, table).count(), "")
    return _statuses(spark, [("rebuild", done), ("empty", empty), ("kept", kept)])


@register("union_of_layouts", with_views(
    "select STATION, DATE, nullif(TMAX, '') as TMAX, cast(null as string) as TMIN from raw_obs union all "
    "select STATION, DATE, cast(null as string), nullif(TMIN, '') from raw_obs", raw=True))
def union_of_layouts(spark, sf_dir):
    """Files with different columns, combined by name."""
    root = scratch_path(spark, "layouts")
    raw = raw_observations(spark, sf_dir)
    CSV.write_csv(raw.select("STATION", "DATE", "TMAX"), os.path.join(root, "a"))
    CSV.write_csv(raw.select("TMIN", "DATE", "STATION"), os.path.join(root, "b"))
    out = CSV.read_raw_dir(spark, os.path.join(root, "*", "*.csv")).select("STATION", "DATE", "TMAX", "TMIN")
    return out.withColumns({c: F.nullif(c, F.lit("")) for c in ("TMAX", "TMIN")})


@register("latest_file", with_views(
    "select 'new' as FOLDER, count(*) as n_rows from obs"))
def latest_file(spark, sf_dir):
    """Rows of the newest of two imports, each a folder of part files."""
    root = scratch_path(spark, "latest")
    obs = _obs(spark, sf_dir).select("STATION", "DATE", "TMAX")
    CSV.write_csv(obs.filter("TMAX > 0"), os.path.join(root, "old"))
    time.sleep(0.01)  # file times are kept in milliseconds
    CSV.write_csv(obs, os.path.join(root, "new"))
    newest = CSV.latest_import(spark, os.path.join(root, "*", "*.csv"))
    return CSV.read_raw(spark, newest).agg(
        F.lit(newest[0].split("/")[-2]).alias("FOLDER"), F.count(F.lit(1)).alias("n_rows"))


@register("file_manifest", "with n as (select count(*) as n_rows from lineitem) select 1 as n_names, n_rows from n")
def file_manifest(spark, sf_dir):
    """Distinct file names behind a table, written as text."""
    path = scratch_path(spark, "manifest")
    table = spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet"))
    CSV.write_manifest(table, path)
    return table.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(spark.read.text(path).distinct().count()).alias("n_names"), "n_rows")


REPORT_YEAR = 2000
_A3 = ("g as (select NAME, cast(year(DATE) as bigint) as YEAR, "
       + ", ".join(f"coalesce(sum({c}), 0.0) as {c}" if c in S.SUMMED_EVENTS
                   else f"avg({c}) as {c}" for c in S.AGG_MEASURES)
       + " from obs where NAME is not null and DATE is not null group by all)")
_FIRST20 = "(select distinct NAME from g order by NAME limit 20)"
_SNOW = (f"s as (select NAME, sum(SNOW) as SNOW from g where YEAR = {REPORT_YEAR} "
         "group by NAME having sum(SNOW) > 0)")
_SHARE_GROUPS = (f"select count(distinct case when SNOW / (select sum(SNOW) from s) < "
                 f"{S.SNOW_SHARE_MIN} then 'Others' else NAME end) from s")
_EVENTS = ("e as (select cast(year(DATE) as bigint) as YEAR, "
           + ", ".join(f"sum(case when {c} > 0 then 1 else 0 end) as n_{c}" for c in R.EVENTS)
           + ", " + " + ".join(f"n_{c}" for c in R.EVENTS) + " as total from obs where DATE is not null group by 1)")


@register("batch_report", with_views(
    'select "TABLE", cast(ROWS as bigint) as ROWS from (values '
    
    f"('null_profile', {len(S.BASE_COLS) + len(S.KEEP_MEASURES)}), "
    "('station_year_conditions', (select count(*) from g)), "
    f"('max_temp_trend', (select count(*) from g where NAME in {_FIRST20})), "
    f"('snow_trend', (select count(*) from g where NAME in {_FIRST20})), "
    f"('snow_share', ({_SHARE_GROUPS})), "
    f"('snow_ranking', (select count(*) from s where SNOW >= {S.SNOW_RANK_MIN})), "
    "('temp_box_by_year', (select count(distinct YEAR) from g where TAVG is not null)), "
    f"('event_frequencies', (select count(*) from e where total >= {S.MIN_EVENT_TOTAL})), "
    f"('correlation_matrix', {len(S.CORRELATION_MEASURES) ** 2})"
    ') as t("TABLE", ROWS)', ctes=[_A3, _SNOW, _EVENTS]))
def batch_report(spark, sf_dir):
    return R.report_summary(spark, _report(spark, sf_dir))


def _report(spark, sf_dir):
    return R.write_report(_obs(spark, sf_dir), scratch_path(spark, "report"), REPORT_YEAR)


_BOX_COLS = ["min", "q1", "median", "q3", "max", "lower_whisker", "upper_whisker"]


def _report_sql() -> str:
    """Every cell of the nine report tables, one row each."""
    cell = lambda table, key, value, source: (
        f"select '{table}' as \"TABLE\", {key} as KEY, cast({value} as double) as VALUE from {source}")
    parts = [cell("snow_ranking", "NAME", "round(SNOW, 6)", f"s where SNOW >= {S.SNOW_RANK_MIN}"),
             cell("max_temp_trend", "NAME || ' ' || YEAR", "round(TMAX, 6)", f"g where NAME in {_FIRST20}"),
             cell("snow_trend", "NAME || ' ' || YEAR", "round(SNOW, 6)", f"g where NAME in {_FIRST20}"),
             cell("snow_share", "NAME || ' SNOW'", "round(SNOW, 6)", "o"),
             cell("snow_share", "NAME || ' SHARE'", "round(SNOW / total, 6)", "o"),
             cell("correlation_matrix", "COL_A || ' ' || COL_B", "CORR", f"({ORACLES['correlation_matrix']})")]
    parts += [cell("station_year_conditions", f"NAME || ' ' || YEAR || ' {c}'", f"round({c}, 6)", "g") for c in S.AGG_MEASURES]
    parts += [cell("temp_box_by_year", f"YEAR || ' {c}'", f'"{c}"', f"({ORACLES['temp_box_by_year']})") for c in _BOX_COLS]
    parts += [cell("null_profile", f"'{c}'", "n", f"(select count({c}) as n from obs)") for c in S.BASE_COLS + S.KEEP_MEASURES]
    parts += [cell("event_frequencies", f"YEAR || ' {AG.chart_label(c)}'", f"n_{c}", f"e where total >= {S.MIN_EVENT_TOTAL}")
              for c in R.EVENTS]
    shares = ("t as (select sum(SNOW) as total from s), o as (select case when s.SNOW / t.total < "
              f"{S.SNOW_SHARE_MIN} then 'Others' else NAME end as NAME, sum(s.SNOW) as SNOW, any_value(t.total) as total "
              "from s, t group by 1)")
    return with_views(" union all ".join(parts), ctes=[_A3, _SNOW, _EVENTS, shares])


@register("batch_report_contents", _report_sql())
def batch_report_contents(spark, sf_dir):
    """Every value of the nine written report tables."""
    t = {name: spark.read.parquet(p) for name, p in _report(spark, sf_dir).items()}

    def cells(name, key, columns):
        values = F.array(*[F.struct(F.lit(label).alias("label"), F.round(F.col(f"`{c}`").cast("double"), 6).alias("VALUE"))
                           for c, label in columns.items()])
        return t[name].select(F.concat_ws(" ", *key).alias("key"), F.explode(values).alias("cell")).select(
            F.lit(name).alias("TABLE"), F.concat("key", "cell.label").alias("KEY"), F.col("cell.VALUE").alias("VALUE"))
    named = lambda columns: {c: f" {c}" for c in columns}
    year = ["NAME", "PERIOD_LABEL"]
    return reduce(DataFrame.unionByName, [
        cells("snow_ranking", ["NAME"], {"SNOW": ""}), cells("max_temp_trend", year, {"TMAX": ""}),
        cells("snow_trend", year, {"SNOW": ""}), cells("snow_share", ["NAME"], named(["SNOW", "SHARE"])),
        cells("correlation_matrix", ["COL_A", "COL_B"], {"CORR": ""}),
        cells("station_year_conditions", year, named(S.AGG_MEASURES)), cells("temp_box_by_year", ["YEAR"], named(_BOX_COLS)),
        cells("null_profile", ["COLUMN_NAME"], {"NON_NULL": ""}),
        cells("event_frequencies", ["YEAR"], named(AG.chart_label(c) for c in R.EVENTS))])


@register("stored_profile", with_views(
    "select year(DATE)::integer as YEAR, count(*) as n_rows, min(DATE) as min_date, max(DATE) as max_date, "
    "count(TMAX) as n_TMAX, count(TSUN) as n_TSUN from obs where DATE is not null group by 1"))
def stored_profile(spark, sf_dir):
    """Counts and date bounds of every stored year, from the footers."""
    return ST.stored_profile(spark, _stored_copy(spark, sf_dir, "profiled"), ["TMAX", "TSUN"], by_year=True)


_YEAR_RANGES = ((1992, 1993), (1994, 1996), (1992, 1998), (1900, 1901))


@register("stored_station_counts", with_views(
    " union all ".join(
        f"select {a} as FROM_YEAR, {b} as TO_YEAR, count(distinct NAME) as n_stations, count(*) as n_rows, true as within "
        f"from obs where year(DATE) between {a} and {b}" for a, b in _YEAR_RANGES)))
def stored_station_counts(spark, sf_dir):
    """Distinct stations of ranges of years by merged sketches (A10, D1), beside
    the exact count: within five standard errors."""
    path = _stored_copy(spark, sf_dir, "sketched")
    table = ST.read_observations(spark, path)
    out = None
    for a, b in _YEAR_RANGES:
        exact = table.filter(F.col("YEAR").between(a, b)).agg(F.countDistinct("NAME").alias("exact"))
        part = ST.stored_station_count(spark, path, a, b).crossJoin(exact).select(  # one row and one row
            F.lit(a).alias("FROM_YEAR"), F.lit(b).alias("TO_YEAR"), F.col("exact").alias("n_stations"), "n_rows",
            (F.abs(F.col("n_stations") - F.col("exact")) <= 0.08 * F.col("exact")).alias("within"))
        out = part if out is None else out.unionByName(part)
    return out
