"""Invariants from the test strategy, on the provided sf0.001 tables."""

import re

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratus import schema as S
from stratus.functions.periods import period_label
from stratus.operators import aggregates as A
from stratus.operators import clean as C
from stratus.operators import names as NM
from stratus.operators import stats as ST
from stratus.sources import adapter as AD


def test_period_labels_agree_with_pandas(spark):
    rng = np.random.default_rng(5)
    days = [dt.date(1990, 1, 1) + dt.timedelta(days=int(d)) for d in rng.integers(0, 15000, 400)]
    df = spark.createDataFrame([(d,) for d in days], "DATE date")
    got = df.select("DATE", *[period_label("DATE", f).alias(f) for f in "YQMWD"]).collect()
    for r in got:
        ts = pd.Timestamp(r.DATE)
        for f in "YQMWD":
            assert r[f] == str(ts.to_period(f)), (r.DATE, f)


def test_city_match_values_come_from_the_dimensions(spark, sf_small):
    cities = NM.prepare_cities(AD.city_dimension(spark, sf_small))
    allowed = {r.CITY for r in cities.collect()} | {c for _, c in S.CITY_EXCEPTIONS}
    got = NM.match_cities(AD.observations(spark, sf_small), cities).collect()
    assert got and all(r.CITY is None or r.CITY in allowed for r in got)


def test_clean_output_respects_limits_and_is_stable(spark, sf_small):
    once = C.clean_observations(AD.raw_observations(spark, sf_small), "1996-01-01")
    bad = once.filter(" or ".join(f"({c} < -500 or {c} > 512)" for c in S.TEMP_COLS))
    assert bad.count() == 0
    assert once.filter(F.col("DATE") < F.lit(dt.date(1996, 1, 1))).count() == 0
    text = once.select(*[F.col(c).cast("string").alias(c) for c in once.columns])
    twice = C.clean_observations(text, "1996-01-01")
    # rows only SNWD kept alive drop the second time; nothing else changes
    assert twice.count() <= once.count()
    assert twice.exceptAll(once).count() == 0


def test_snow_shares_sum_to_one(spark, sf_small):
    grouped = A.station_period_conditions(AD.observations(spark, sf_small))
    year = grouped.filter(F.col("SNOW") > 0).select(F.min("PERIOD_LABEL")).first()[0]
    shares = A.snowfall_share(grouped, int(year), 0.05).collect()
    assert sum(r.SHARE for r in shares) == pytest.approx(1.0, abs=1e-5)
    per_year = A.snowfall_shares_all_years(grouped).groupBy("YEAR").agg(F.sum("SHARE").alias("s"))
    assert all(abs(r.s - 1.0) < 1e-4 for r in per_year.collect())


def test_correlation_matrix_symmetric_unit_diagonal(spark, sf_small):
    grouped = A.station_period_conditions(AD.observations(spark, sf_small))
    cells = {(r.COL_A, r.COL_B): r.CORR
             for r in ST.correlation_matrix(grouped, S.CORRELATION_MEASURES).collect()}
    assert len(cells) == len(S.CORRELATION_MEASURES) ** 2
    for (a, b), v in cells.items():
        assert v == cells[(b, a)]
        if a == b and v is not None:
            assert v == pytest.approx(1.0)


def test_cleaning_counts_measured_in_fixtures(spark):
    """FIXTURES §5: cleaning the all-text view at sf0.01 with floor 1996-01-01."""
    import os
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("sf0.01 tables not present")
    rep = C.clean_report(AD.raw_observations(spark, sf), "1996-01-01").first()
    assert rep.rows_out == 42907
    assert {m: rep.rows_out - rep[f"null_{m}"] for m in ["TAVG", "TMIN", "TMAX", "PRCP"]} == {
        "TAVG": 39159, "TMIN": 32457, "TMAX": 31693, "PRCP": 32537}


def test_fixture_counts_at_sf001(spark):
    """Other FIXTURES §5 measurements at sf0.01."""
    import os

    from stratus.operators import filters as P
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("sf0.01 tables not present")
    obs = AD.observations(spark, sf)
    assert P.suspect_temperatures(obs).count() == 5447
    assert P.extreme_cold(obs).count() == 23468
    assert A.heavy_precipitation_years(obs).count() == 660
    grouped = A.station_period_conditions(obs)
    assert A.snowfall_share(grouped, 2000, 0.02).count() == 19
    assert A.snowfall_ranking(grouped, 2000).count() == 18
    assert A.yearly_event_frequencies(obs, S.EVENT_CHART_COLS, 10000).count() == 6
    cities = NM.prepare_cities(AD.city_dimension(spark, sf))
    matched = NM.match_cities(obs, cities)
    assert matched.count() == 100
    known = {r.CITY for r in cities.collect()}
    for r in matched.collect():  # the longest city, as whole words of the name
        words = f" {' '.join(re.findall(r'[A-Z0-9_]+', r.NAME.upper()))} "
        assert r.CITY == min((c for c in known if f" {c} " in words), key=lambda c: (-len(c), c))
