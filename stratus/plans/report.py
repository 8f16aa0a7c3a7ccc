"""Batch report: every chart's result set written as a table in one job.

One aggregate by station and year (conditions, event days and counts) is all
that the report takes from the daily observations: one scan. It is written once,
every table is made from that copy, and a lost executor re-reads files instead
of re-running the aggregation.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import aggregates as A
from ..operators import stats as ST
from ..session import materialize
from . import series as G


REPORT_THREADS = 4
EVENTS = ["WT01", "WT02", "WT08", "WT16"]


def write_report(df: DataFrame, out_dir: str, snow_year: int,
                 min_event_total: int = S.MIN_EVENT_TOTAL,
                 share_min: float = S.SNOW_SHARE_MIN) -> dict[str, str]:
    """Write the report tables under ``out_dir``; returns name -> path.

    Tables that do not depend on each other are written as concurrent Spark
    jobs (submitted from a few driver threads), so small stages of one table
    do not leave the cluster idle while another waits.
    """
    spark = df.sparkSession
    paths: dict[str, str] = {}

    def put(task) -> tuple[str, str]:
        name, build = task
        path = os.path.join(out_dir, name)
        build().write.mode("overwrite").parquet(path)
        return name, path

    def wave(tasks) -> None:
        with ThreadPoolExecutor(max_workers=REPORT_THREADS) as pool:
            paths.update(pool.map(put, tasks))

    # The one pass over the daily observations.
    facts = materialize(A.station_year_facts(df, EVENTS), "report-facts")
    wave([("null_profile", lambda: A.profile_of_facts(facts)),
          ("station_year_conditions", lambda: A.conditions_of_facts(facts)),
          ("event_frequencies", lambda: A.events_of_facts(facts, EVENTS, min_event_total))])
    conditions = spark.read.parquet(paths["station_year_conditions"])
    # Everything else reads the written station-year table; TMAX and SNOW
    # there are the station-year means the trend charts plot.
    wave([("max_temp_trend", lambda: G.trend_of_first_stations(conditions, "TMAX")),
          ("snow_trend", lambda: G.trend_of_first_stations(conditions, "SNOW")),
          ("snow_share", lambda: A.snowfall_share(conditions, snow_year, share_min)),
          ("snow_ranking", lambda: A.snowfall_ranking(conditions, snow_year)),
          ("temp_box_by_year", lambda: ST.yearly_box_of_station_means(conditions, "TAVG")),
          ("correlation_matrix",
           lambda: ST.correlation_matrix(conditions, S.CORRELATION_MEASURES))])
    return paths


def report_summary(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(TABLE, ROWS) for the written report tables."""
    frames = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("ROWS"))
              .select(F.lit(name).alias("TABLE"), "ROWS") for name, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
