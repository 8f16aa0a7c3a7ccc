import datetime as dt

from pyspark.sql import functions as F

from stratus.functions.periods import period_label, period_start


def test_labels_and_starts(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1),)], "DATE date")
    row = df.select(*[period_label("DATE", f).alias(f) for f in "YQMWD"],
                    *[period_start("DATE", f).alias("s" + f) for f in "YQMW"]).first()
    assert (row.Y, row.Q, row.M, row.W, row.D) == ("2020", "2020Q1", "2020-01",
                                                   "2019-12-30/2020-01-05", "2020-01-01")
    assert row.sW == dt.date(2019, 12, 30)
    assert row.sY == row.sQ == row.sM == dt.date(2020, 1, 1)


def test_label_from_start_equals_label_from_date(spark):
    df = spark.range(0, 800).select(F.date_add(F.lit(dt.date(2019, 1, 1)), F.col("id").cast("int"))
                                    .alias("DATE"))
    for f in "YQMW":
        bad = df.filter(period_label("DATE", f) != period_label(period_start("DATE", f), f))
        assert bad.count() == 0
