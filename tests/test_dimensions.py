from stratus.sources import dimensions as DM


def test_labels_fallbacks(spark):
    df = spark.createDataFrame([("TAVG",), ("SNOW",), ("Snow",), ("XYZ",)], "code string")
    got = {r.code: (r.TYPE_LABEL, r.CHART_LABEL) for r in DM.with_labels(df, "code").collect()}
    assert got["TAVG"] == ("Average temperature", "Average Temperature")
    assert got["SNOW"] == ("Unknown (SNOW)", "Snowfall")
    assert got["Snow"] == ("Snowfall", "Snow")
    assert got["XYZ"] == ("Unknown (XYZ)", "XYZ")


def test_preferred_stations_inverse(spark):
    got = {r.CITY: r.STATIONS for r in DM.preferred_stations(spark).collect()}
    assert got["NEW YORK"] == ["JFK INTERNATIONAL AIRPORT", "NY CITY CENTRAL PARK"]
    assert set(got) == {"NEW YORK", "NEWARK", "MINNEAPOLIS", "BALTIMORE"}


def test_element_meaning_and_semi_join(spark):
    df = spark.createDataFrame([("SNWD", 1), ("NOPE", 2)], "code string, k int")
    got = {r.code: r.MEANING for r in DM.with_element_meaning(df, "code").collect()}
    assert got == {"SNWD": "Snow depth on ground (mm or cm)", "NOPE": None}
    keys = spark.createDataFrame([(2,)], "k int")
    assert [r.code for r in DM.restrict_to(df, keys, "k").collect()] == ["NOPE"]
