import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratus import schema as S
from stratus.operators import aggregates as A

D = dt.date(2020, 1, 1)


def test_null_grouping(spark):
    df = spark.createDataFrame([("a", D, None), ("a", D, None), (None, D, 1.0)],
                               "NAME string, DATE date, SNOW double")
    totals = A.station_period_snow_totals(df).collect()
    assert [(r.NAME, r.SNOW) for r in totals] == [("a", 0.0)]
    means = A.station_period_means(df, agg_cols=["SNOW"]).collect()
    assert [(r.NAME, r.SNOW) for r in means] == [("a", None)]


def test_conditions_sum_flags_mean_others(spark):
    df = spark.createDataFrame([("a", D, 1.0, 2.0, 1.0), ("a", D, None, 4.0, 1.0)],
                               "NAME string, DATE date, WT16 double, TMAX double, WT02 double")
    r = A.station_period_conditions(df).first()
    assert (r.WT16, r.TMAX, r.WT02) == (1.0, 3.0, 1.0)


def _grouped(spark):
    rows = [("S1", D, 10.0), ("S2", D, 1.0), ("S3", D, 0.1), ("S4", D, 0.0),
            ("S1", dt.date(2021, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "NAME string, DATE date, SNOW double")
    return A.station_period_means(df, "Y", ["SNOW"])


def test_snow_share_folds_small_slices(spark):
    out = {r.NAME: r for r in A.snowfall_share(_grouped(spark), 2020, 0.05).collect()}
    assert set(out) == {"S1", "S2", "Others"}
    assert out["Others"].SNOW == pytest.approx(0.1)
    assert sum(r.SHARE for r in out.values()) == pytest.approx(1.0, abs=1e-5)


def test_snow_ranking_threshold_and_order(spark):
    out = A.snowfall_ranking(_grouped(spark), 2020).collect()
    assert [r.NAME for r in out] == ["S1", "S2"]


def test_event_frequencies_valid_years_and_bounds(spark):
    rows = []
    for year, n in [(2018, 1), (2019, 5), (2020, 5), (2021, 5)]:
        rows += [(dt.date(year, 1, 1), 1.0, None)] * n
    df = spark.createDataFrame(rows, "DATE date, WT01 double, WT08 double")
    out = A.yearly_event_frequencies(df, ["WT01", "WT08"], min_total=3)
    assert sorted(r.YEAR for r in out.collect()) == [2019, 2020, 2021]
    assert out.columns == ["YEAR", "Fog Occurrence", "Smoke or Haze Occurrence"]
    # year_from 2018 is not a valid year: ignored; year_to 2020 is: applied
    out = A.yearly_event_frequencies(df, ["WT01", "WT08"], 3, year_from=2018, year_to=2020)
    assert sorted(r.YEAR for r in out.collect()) == [2019, 2020]
    # no valid year at all: empty result, no error
    assert A.yearly_event_frequencies(df, ["WT01"], min_total=100).count() == 0


def test_unknown_label(spark):
    df = spark.createDataFrame([(D, 1.0)], "DATE date, WT02 double")
    assert A.yearly_event_frequencies(df, ["WT02"], 0).columns == ["YEAR", "Unknown (WT02)"]


def test_top_positive_is_ordered_with_ties(spark):
    rows = [("b", 1.0), ("a", 1.0), ("c", 1.0), ("c", 1.0), ("d", 0.0)]
    df = spark.createDataFrame(rows, "NAME string, TSUN double")
    out = A.top_positive_stations(df, "TSUN", 2).collect()
    assert [(r.NAME, r.records) for r in out] == [("c", 2), ("a", 1)]


def test_report_reads_the_days_once(spark, tmp_path):
    from stratus.operators import audit as AU
    from stratus.plans import report as R
    rows = [(f"S{i % 5}" if i % 11 else None, dt.date(2000 + i % 3, 1 + i % 12, 1) if i % 7 else None, float(i % 4), float(i))
            for i in range(200)]
    days = spark.createDataFrame(rows, "NAME string, DATE date, WT01 double, TMAX double").withColumns(
        {c: F.lit(None).cast("double") if c in ("RHAV", "TSUN") else F.col("TMAX") / 7 for c in S.AGG_MEASURES
         if c not in ("WT01", "TMAX")})
    read = spark.sparkContext.accumulator(0)

    def seen(name):
        read.add(1)
        return name
    counted = days.withColumn("NAME", F.udf(seen, "string").asNondeterministic()("NAME"))
    paths = R.write_report(counted, str(tmp_path), 2000, min_event_total=1)
    assert read.value == 200
    rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)
    table = lambda name: spark.read.parquet(paths[name])
    assert rows_of(table("null_profile")) == rows_of(AU.null_profile(days))
    assert rows_of(table("event_frequencies")) == rows_of(A.yearly_event_frequencies(days, R.EVENTS, 1))
    got, want = table("station_year_conditions"), A.station_period_conditions(days, "Y")
    assert got.columns == want.columns
    rounded = lambda df: df.select(*[F.round(c, 9).alias(c) if c in S.AGG_MEASURES else c for c in df.columns])
    assert rows_of(rounded(got)) == rows_of(rounded(want)) and got.count() == 15
