import datetime as dt

from pyspark.sql import functions as F

from stratus.operators import clean as C

COLS = ["STATION", "DATE", "LATITUDE", "LONGITUDE", "ELEVATION", "NAME",
        "TMAX", "TMIN", "TAVG", "PRCP", "SNWD", "TMAX_ATTRIBUTES"]


def _row(station="A1", date="2020-01-01", name="X CITY, NY US", tmax=None, tmin=None,
         tavg=None, prcp=None, snwd=None, attrs=",,W"):
    return (station, date, "40.0", "-75.0", "10.0", name, tmax, tmin, tavg, prcp, snwd, attrs)


GOLDEN = [
    _row(" A1 ", "2020-01-01", " X CITY, NY US ", "100", "50", None, "10"),   # 1 kept
    _row(date="2020-01-02", tmax="100"),                                      # 2 kept
    _row(date="2020-01-03", tavg="  "),                                       # 3 no data
    _row(date="2020-01-04", snwd="5"),                                        # 4 kept
    _row(date="bad", tmax="10"),                                              # 5 bad date
    _row(date="1999-12-31", tmax="10"),                                       # 6 floor
    _row(date="2020-01-07", tmax="513"),                                      # 7 limit
    _row(date="2020-01-08", tmax="512", tmin="-500"),                         # 8 kept
    _row(date="2020-01-09", tmax="abc", tmin="20"),                           # 9 kept
    _row(date="2020-01-10", name="", tmax="10"),                              # 10 kept
    _row(date="2020-1-5", tmax="10"),                                         # 11 kept
    _row(date="2020-01-12", tmax="NaN", prcp="1e1"),                          # 12 kept
    _row(date="2020-01-13", tmax="10", prcp="12f"),                           # 13 kept
    (None,) * 12,                                                             # 14 empty
    _row(" A1 ", "2020-01-01", " X CITY, NY US ", "100", "50", None, "10"),   # 15 = 1
]


def _raw(spark, rows=GOLDEN, cols=COLS):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))


def test_golden_rows(spark):
    out = C.clean_observations(_raw(spark), floor="2000-01-01")
    assert out.columns == ["STATION", "DATE", "LATITUDE", "LONGITUDE", "ELEVATION", "NAME",
                           "TAVG", "TMIN", "TMAX", "PRCP"]
    rows = {(r.DATE, r.TMAX, r.TMIN): r for r in out.collect()}
    assert out.count() == 10
    by_date = {}
    for r in out.collect():
        by_date.setdefault(r.DATE, []).append(r)
    d = dt.date
    first = by_date[d(2020, 1, 1)]
    assert len(first) == 2 and all(r.STATION == "A1" and r.NAME == "X CITY, NY US"
                                   and r.TAVG == 75.0 for r in first)
    assert by_date[d(2020, 1, 2)][0].TAVG == 100.0
    r4 = by_date[d(2020, 1, 4)][0]
    assert (r4.TAVG, r4.TMIN, r4.TMAX, r4.PRCP) == (None, None, None, None)
    assert by_date[d(2020, 1, 8)][0].TAVG == 6.0
    r9 = by_date[d(2020, 1, 9)][0]
    assert r9.TMAX is None and r9.TAVG == 20.0
    r10 = by_date[d(2020, 1, 10)][0]
    assert r10.NAME is None and r10.TAVG == 10.0
    assert by_date[d(2020, 1, 5)][0].TAVG == 10.0
    r12 = by_date[d(2020, 1, 12)][0]
    assert r12.TMAX is None and r12.TAVG is None and r12.PRCP == 10.0
    r13 = by_date[d(2020, 1, 13)][0]
    assert r13.PRCP is None and r13.TAVG == 10.0
    for dropped in [d(2020, 1, 3), d(2020, 1, 7), d(1999, 12, 31)]:
        assert dropped not in by_date
    assert rows  # noqa


def test_report_counts(spark):
    rep = C.clean_report(_raw(spark), floor="2000-01-01").first().asDict()
    assert rep["rows_in"] == 15
    assert rep["dropped_empty"] == 1
    assert rep["dropped_no_data"] == 1
    assert rep["dropped_bad_date"] == 1
    assert rep["dropped_before_floor"] == 1
    assert rep["dropped_out_of_limits"] == 1
    assert rep["rows_out"] == 10
    assert rep["unparsed_TMAX"] == 1      # 'abc' ('NaN' is a missing token)
    assert rep["unparsed_PRCP"] == 1      # '12f'


def test_no_floor_keeps_old_rows(spark):
    out = C.clean_observations(_raw(spark), floor=None)
    assert out.filter(F.col("DATE") == dt.date(1999, 12, 31)).count() == 1


def test_missing_required_gives_empty(spark):
    df = spark.createDataFrame([("A", "2020-01-01", "1")], "STATION string, DATE string, TMAX string")
    out = C.clean_observations(df)
    assert out.count() == 0
    assert "STATION" in out.columns and "DATE" in out.columns


def test_no_data_columns_drops_every_row(spark):
    df = _raw(spark).select("STATION", "DATE", "LATITUDE", "LONGITUDE", "ELEVATION", "NAME")
    assert C.clean_observations(df).count() == 0


def test_plausibility_bounds_hold(spark):
    out = C.clean_observations(_raw(spark), floor=None)
    bad = out.filter(~(F.col("TMAX").isNull() | F.col("TMAX").between(-500, 512)))
    assert bad.count() == 0


def test_cleaning_twice_is_stable(spark):
    once = C.clean_observations(_raw(spark), floor="2000-01-01")
    as_text = once.select(*[F.col(c).cast("string").alias(c) for c in once.columns])
    twice = C.clean_observations(as_text, floor="2000-01-01")
    # Row 4 had only SNWD (not kept): it goes the second time, as documented.
    assert twice.count() == once.count() - 1


def test_report_by_observation_matches_aggregate(spark):
    from pyspark.sql import Observation
    obs = Observation("clean")
    out = C.clean_observations(_raw(spark), floor="2000-01-01", metrics=obs)
    assert out.count() == 10
    assert obs.get == C.clean_report(_raw(spark), floor="2000-01-01").first().asDict()


def test_number_parsing_follows_the_original(spark):
    from stratus.functions.text import parse_number
    cells = ["inf", "-Infinity", "1d", "1f", "0x1p3", "1e5", " 5 ", "+5", ".5", "5.",
             "NaN", "1_000", "1e", "e5", "--5"]
    got = [r.v for r in spark.createDataFrame([(c,) for c in cells], "c string")
           .select(parse_number("c").alias("v")).collect()]
    inf = float("inf")
    assert got == [inf, -inf, None, None, None, 1e5, 5.0, 5.0, 0.5, 5.0,
                   None, None, None, None, None]


def test_number_parsing_matches_pandas_on_random_text(spark):
    import math
    import random

    import pandas as pd

    from stratus.functions.text import parse_number
    rnd = random.Random(3)
    alphabet = list("0123456789+-.eEdDfF ainfINFty_x\t")
    cells = sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 7)))
                    for _ in range(3000)} | {"inf", " inf ", "-Infinity", "1e500", "+.5", "."})
    expect = pd.to_numeric(pd.Series(cells, dtype=object), errors="coerce")
    got = [r.v for r in spark.createDataFrame([(c,) for c in cells], "c string")
           .select(parse_number("c").alias("v")).collect()]
    for c, e, g in zip(cells, expect, got):
        if isinstance(e, float) and math.isnan(e):
            assert g is None, c
        else:   # pandas' own parser is not always correctly rounded
            assert g is not None and (g == e or abs(g - e) <= 1e-15 * abs(e)), c


def test_date_parsing_matches_pandas(spark):
    import random

    import pandas as pd

    from stratus.functions.text import parse_date
    rnd = random.Random(9)
    cells = ["2020-01-01"] + [
        f"{rnd.choice(['2020', '1999', '0020', '20201', '2262', '1677'])}"
        f"{rnd.choice(['-', '-', '/', ''])}{rnd.choice(['1', '01', '12', '13', '00'])}"
        f"-{rnd.choice(['1', '01', '31', '30', '29', '32', '00'])}" for _ in range(1500)
    ] + ["2020-01-01T05:00:00", "bad", "2021-02-29", "1677-09-21", "1677-09-22", "2262-04-11",
         "2262-04-12"]
    expect = pd.to_datetime(pd.Series(cells, dtype=object), errors="coerce")
    got = [r.v for r in spark.createDataFrame([(c,) for c in cells], "c string")
           .select(parse_date("c").alias("v")).collect()]
    for c, e, g in zip(cells, expect, got):
        assert g == (None if pd.isna(e) else e.date()), c
