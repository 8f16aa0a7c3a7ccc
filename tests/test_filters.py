import datetime as dt

from pyspark.sql import functions as F

from stratus.operators import audit as AU
from stratus.operators import filters as P
from stratus.plans import series as G

D = dt.date


def _df(spark):
    rows = [("A", D(2020, 6, 1), 1.0, None), ("A", D(2021, 1, 1), 0.0, 1.0),
            ("B", D(2021, 3, 1), None, None), (None, D(2021, 4, 1), 2.0, 0.0),
            ("A", None, 3.0, 0.0)]
    return spark.createDataFrame(rows, "NAME string, DATE date, WT01 double, WT02 double")


def test_period_start_range_drops_partial_period(spark):
    out = P.period_start_range(_df(spark), "2020-06-01", "2021-12-31")
    # the 2020 period starts on 2020-01-01, before the range start
    assert sorted(r.DATE for r in out.collect()) == [D(2021, 1, 1), D(2021, 3, 1), D(2021, 4, 1)]


def test_floor_clamp_and_open_ranges(spark):
    assert P.clamp_start(None, "2021-01-01") == D(2021, 1, 1)
    assert P.clamp_start("2021-02-01", "2021-01-01") == D(2021, 2, 1)
    assert P.date_range(_df(spark), None, "2020-12-31").count() == 1
    assert P.date_range(_df(spark), "2021-03-01", None).count() == 2
    assert P.date_range_with_floor(_df(spark), None, None, "2021-01-01").count() == 3


def test_keys_events_and_usable(spark):
    df = _df(spark)
    assert P.drop_incomplete_keys(df).count() == 3
    assert P.any_event(df, ["WT01", "WT02", "WTXX"]).count() == 4
    usable = P.usable_columns(df.filter(F.col("NAME") == "B"), ["WT01", "WT02"]).first()
    assert (usable.WT01, usable.WT02) == (False, False)
    assert P.columns_for("WT01") == ["WT01", "WT02"] and P.columns_for("ZZZ") == ["ZZZ"]
    assert P.missing_columns(df, {"NAME", "TMAX"}) == {"TMAX"}
    assert "TMAX" in P.fill_missing_columns(df, ["TMAX"], 0.0).columns
    assert P.string_columns(df) == ["NAME"]
    renamed = P.resolve_date_column(df.withColumnRenamed("DATE", "date"))
    assert "DATE" in renamed.columns


def test_validation_helpers():
    assert P.validate_dates("2020-01-01", "2020-02-01")
    assert not P.validate_dates("2020-03-01", "2020-02-01")
    assert not P.validate_dates("bad", "2020-02-01")
    assert P.validate_inputs("Boston", "TAVG") and not P.validate_inputs("", "TAVG")
    assert not P.validate_inputs("Boston", "XXXX")
    assert P.data_type_label("Snow") == "Snowfall" and P.data_type_label("Q") == "Unknown (Q)"


def test_catalog_and_paging(spark):
    df = _df(spark)
    df.createOrReplaceTempView("obs_view_for_test")
    assert "obs_view_for_test" in AU.list_tables(spark)
    assert AU.column_names(df) == ["NAME", "DATE", "WT01", "WT02"]
    ordered = ["DATE", "NAME"]
    pages = [AU.page(df.filter(F.col("DATE").isNotNull()), ordered, k, 2).collect() for k in range(3)]
    assert [len(p) for p in pages] == [2, 2, 0]


def test_control_summary_and_station_metrics(spark):
    df = _df(spark).withColumn("NAME", F.when(F.col("NAME") == "A", "X CITY, NY US")
                               .otherwise(F.col("NAME")))
    r = G.control_summary(df).first()
    assert (r.min_date, r.max_date, r.n_stations, r.first_city) == (
        D(2020, 6, 1), D(2021, 4, 1), 2, "B")


def test_pages_by_key_equal_pages_by_offset(spark):
    from stratus.operators.audit import page, page_after, place_after
    rows = [(None, 1), (None, 1), ("a", None), ("a", 2), ("a", 2), ("a", 2), ("a", 2), ("b", None), ("b", 0), ("c", 5), ("c", 5)]
    df = spark.createDataFrame(rows, "x string, y int")
    place = None
    for number in range(5):
        got = page_after(df, ["x", "y"], place, 3).collect()
        assert got == page(df, ["x", "y"], number, 3).collect()
        place = place_after(got, ["x", "y"], place)
