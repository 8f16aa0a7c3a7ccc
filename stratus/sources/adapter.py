"""Observation views over the provided star-schema test tables.

The test tables hold no weather data. One ``lineitem`` row becomes one daily
observation of the supplier's "station"; measures are whole numbers held in
``double`` so sums do not depend on evaluation order. The same definition is
kept as SQL text (``OBS_SQL`` / ``RAW_OBS_SQL``) for the DuckDB oracle.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import sized_broadcast


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_SUPPLIER_COLS = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation ⋈ region."""
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return nation.join(sized_broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))


def _station_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier ⋈ nation ⋈ region, one row per station."""
    supplier = read_table(spark, sf_dir, "supplier").select(*_SUPPLIER_COLS)
    return supplier.join(sized_broadcast(_geo(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey"))


def _joined(spark: SparkSession, sf_dir: str, columns: list[str], station: str | None = None) -> DataFrame:
    lineitem = read_table(spark, sf_dir, "lineitem").select(*columns)
    stations = _station_dimension(spark, sf_dir)
    if station is not None:
        # The station's keys come from the dimension, so that they filter the
        # scan of the observations before the join.
        stations = stations.filter(_name_expr() == station)
        keys = [r[0] for r in stations.select("s_suppkey").collect()]
        lineitem = lineitem.filter(F.col("l_suppkey").isin(keys))
    # The station side grows with the data (one row per supplier). Its rows
    # are the supplier's, widened by the nation and region names; it is
    # broadcast only while they are few, otherwise this is a shuffle join.
    supplier = read_table(spark, sf_dir, "supplier").select(*_SUPPLIER_COLS)
    return lineitem.join(sized_broadcast(stations, rows_of=supplier),
                         F.col("l_suppkey") == F.col("s_suppkey"))


def _name_expr() -> F.Column:
    return F.concat(F.col("n_name"), F.lit(" AIRPORT "), F.col("s_suppkey").cast("string"),
                    F.lit(", "), F.col("r_name"), F.lit(" US"))


def first_station(spark: SparkSession, sf_dir: str) -> str | None:
    """The first station name in alphabetical order, from the dimension."""
    return _station_dimension(spark, sf_dir).select(F.min(_name_expr())).first()[0]


def station_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(STATION, NAME) of the station dimension."""
    return _station_dimension(spark, sf_dir).select(F.col("s_name").alias("STATION"), _name_expr().alias("NAME"))


def observations(spark: SparkSession, sf_dir: str, station: str | None = None) -> DataFrame:
    """Clean observation rows (schema of the stored table minus CITY_NAME);
    of one station only when it is named."""
    return _observations(spark, sf_dir, station)


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text rows as a raw station file would hold them (for cleaning)."""
    return _raw_observations(spark, sf_dir)


def _observations(spark: SparkSession, sf_dir: str, station: str | None = None) -> DataFrame:
    ln = F.col("l_linenumber")
    qty = F.col("l_quantity")
    disc100 = F.round(F.col("l_discount") * 100)
    tax100 = F.round(F.col("l_tax") * 100)
    j = _joined(spark, sf_dir, ["l_suppkey", "l_partkey", "l_linenumber", "l_quantity",
                                "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                                "l_linestatus", "l_shipdate"], station)
    dbl = lambda c: c.cast("double")
    return j.select(
        F.col("s_name").alias("STATION"),
        F.col("l_shipdate").cast("date").alias("DATE"),
        dbl(30 + F.col("n_regionkey")).alias("LATITUDE"),
        dbl(-70 - F.col("n_nationkey")).alias("LONGITUDE"),
        dbl(F.round(F.col("s_acctbal"))).alias("ELEVATION"),
        _name_expr().alias("NAME"),
        F.when(ln.isin(3, 4), dbl(qty * 20 - 450)).alias("TAVG"),
        F.when(ln != 2, dbl(qty * 20 - 500 - disc100 * 3)).alias("TMIN"),
        F.when(ln != 1, dbl(qty * 20 - 400)).alias("TMAX"),
        dbl(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("WT16"),
        F.when(ln != 4, dbl(F.when(F.month("l_shipdate").isin(12, 1) & (tax100 == 8), 8)
                            .otherwise(0))).alias("SNOW"),
        dbl(disc100).alias("ACMH"),
        F.when(ln == 7, dbl(qty)).alias("WSFG"),
        F.when(ln != 3, dbl(F.round(F.col("l_extendedprice") / 600))).alias("PRCP"),
        dbl(tax100).alias("RHAV"),
        dbl(F.col("l_partkey") % 600).alias("TSUN"),
        dbl(F.when(F.col("l_returnflag") == "R", 1)).alias("WT08"),
        dbl(F.when(F.col("l_returnflag") == "A", 1)).alias("WT01"),
        dbl(F.when(disc100 == 10, 1)).alias("WT02"),
    )


def _raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ln = F.col("l_linenumber")
    pk = F.col("l_partkey")
    qty = F.col("l_quantity")
    txt_int = lambda c: c.cast("int").cast("string")
    lineitem = read_table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    # Two joins in place of one with the widened dimension: the supplier's own columns
    # are few, so that many more rows of them are broadcast before line items are shuffled.
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    j = (lineitem.join(sized_broadcast(supplier, rows_of=supplier), F.col("l_suppkey") == F.col("s_suppkey"))
         .join(sized_broadcast(_geo(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey")))
    return j.select(
        F.when(pk % 7 == 0, F.concat(F.lit("  "), F.col("s_name"), F.lit(" ")))
         .otherwise(F.col("s_name")).alias("STATION"),
        F.when(pk % 97 == 0, F.lit("bad-date")).when(pk % 89 == 0, F.lit(" "))
         .otherwise(F.col("l_shipdate").cast("date").cast("string")).alias("DATE"),
        (30 + F.col("n_regionkey")).cast("string").alias("LATITUDE"),
        (-70 - F.col("n_nationkey")).cast("string").alias("LONGITUDE"),
        F.col("s_suppkey").cast("string").alias("ELEVATION"),
        F.when(pk % 83 == 0, F.lit("")).otherwise(_name_expr()).alias("NAME"),
        F.when(ln.isin(3, 4), txt_int(qty * 20 - 450)).alias("TAVG"),
        F.when(ln == 2, F.lit("  ")).when(ln == 5, F.lit(None).cast("string"))
         .when(pk % 79 == 0, F.lit("abc")).otherwise(txt_int(qty * 20 - 500)).alias("TMIN"),
        F.when(ln == 1, F.lit("")).when(ln == 5, F.lit(None).cast("string"))
         .when(pk % 73 == 0, F.lit("NaN")).otherwise(txt_int(qty * 20 - 400)).alias("TMAX"),
        F.when(ln.isin(3, 5), F.lit(" ")).when(pk % 71 == 0, F.lit("12f"))
         .otherwise(txt_int(F.round(F.col("l_extendedprice") / 600))).alias("PRCP"),
        F.when((ln == 5) & (pk % 2 == 0), F.lit("3")).alias("SNWD"),
        F.lit(",,W").alias("TMAX_ATTRIBUTES"),
    )


def city_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City names for matching: all region and nation names."""
    region = read_table(spark, sf_dir, "region")
    nation = read_table(spark, sf_dir, "nation")
    return (region.select(F.col("r_name").alias("city"))
            .unionByName(nation.select(F.col("n_name").alias("city")))
            .unionByName(spark.range(1).select(F.lit("EAST").alias("city"))))


# ---------------------------------------------------------------------------
# The same views as SQL text, for the DuckDB oracle.
# ---------------------------------------------------------------------------

_FROM = """from lineitem join supplier on l_suppkey = s_suppkey
 join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""

OBS_SQL = f"""select s_name as STATION, cast(l_shipdate as date) as DATE,
 cast(30 + n_regionkey as double) as LATITUDE,
 cast(-70 - n_nationkey as double) as LONGITUDE,
 cast(round(s_acctbal) as double) as ELEVATION,
 concat(n_name, ' AIRPORT ', cast(s_suppkey as string), ', ', r_name, ' US') as NAME,
 case when l_linenumber in (3,4) then cast(l_quantity*20 - 450 as double) end as TAVG,
 case when l_linenumber <> 2 then cast(l_quantity*20 - 500 - round(l_discount*100)*3 as double) end as TMIN,
 case when l_linenumber <> 1 then cast(l_quantity*20 - 400 as double) end as TMAX,
 cast(case when l_linestatus = 'O' then 1 else 0 end as double) as WT16,
 case when l_linenumber <> 4 then cast(case when month(l_shipdate) in (12,1) and round(l_tax*100) = 8 then 8 else 0 end as double) end as SNOW,
 cast(round(l_discount*100) as double) as ACMH,
 case when l_linenumber = 7 then cast(l_quantity as double) end as WSFG,
 case when l_linenumber <> 3 then cast(round(l_extendedprice/600) as double) end as PRCP,
 cast(round(l_tax*100) as double) as RHAV,
 cast(l_partkey % 600 as double) as TSUN,
 cast(case when l_returnflag = 'R' then 1 end as double) as WT08,
 cast(case when l_returnflag = 'A' then 1 end as double) as WT01,
 cast(case when round(l_discount*100) = 10 then 1 end as double) as WT02
{_FROM}"""

RAW_OBS_SQL = f"""select case when l_partkey % 7 = 0 then concat('  ', s_name, ' ') else s_name end as STATION,
 case when l_partkey % 97 = 0 then 'bad-date' when l_partkey % 89 = 0 then ' '
      else cast(cast(l_shipdate as date) as string) end as DATE,
 cast(30 + n_regionkey as string) as LATITUDE, cast(-70 - n_nationkey as string) as LONGITUDE,
 cast(s_suppkey as string) as ELEVATION,
 case when l_partkey % 83 = 0 then '' else concat(n_name, ' AIRPORT ', cast(s_suppkey as string), ', ', r_name, ' US') end as NAME,
 case when l_linenumber in (3,4) then cast(cast(l_quantity*20 - 450 as int) as string) end as TAVG,
 case when l_linenumber = 2 then '  ' when l_linenumber = 5 then null when l_partkey % 79 = 0 then 'abc'
      else cast(cast(l_quantity*20 - 500 as int) as string) end as TMIN,
 case when l_linenumber = 1 then '' when l_linenumber = 5 then null when l_partkey % 73 = 0 then 'NaN'
      else cast(cast(l_quantity*20 - 400 as int) as string) end as TMAX,
 case when l_linenumber in (3,5) then ' ' when l_partkey % 71 = 0 then '12f'
      else cast(cast(round(l_extendedprice/600) as int) as string) end as PRCP,
 case when l_linenumber = 5 and l_partkey % 2 = 0 then '3' end as SNWD,
 ',,W' as TMAX_ATTRIBUTES
{_FROM}"""

CITY_SQL = """select r_name as city from region
 union all select n_name as city from nation
 union all select 'EAST' as city"""


def with_views(body: str, raw: bool = False, cities: bool = False,
               ctes: tuple[str, ...] | list[str] = ()) -> str:
    """Prefix an oracle query with the adapter views it needs as CTEs, then
    any further ``name as (...)`` CTEs of the query itself."""
    parts = [f"obs as ({OBS_SQL})"]
    if raw:
        parts.append(f"raw_obs as ({RAW_OBS_SQL})")
    if cities:
        parts.append(f"cities as ({CITY_SQL})")
    parts.extend(ctes)
    return "with " + ",\n".join(parts) + "\n" + body
