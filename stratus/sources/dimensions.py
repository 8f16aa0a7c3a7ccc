"""Small fixed dimensions (element dictionary, labels, city exceptions) and
the lookups that use them.

The dimensions hold a few dozen rows fixed by the code, so broadcasting them
is bounded by construction; lookups are left-outer equi-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def element_dimension(spark: SparkSession) -> DataFrame:
    """Element code, group and meaning."""
    return spark.createDataFrame(S.ELEMENTS, "CODE string, ELEMENT_GROUP string, MEANING string")


def label_dimension(spark: SparkSession) -> DataFrame:
    """Code -> form label and chart label (S16); the two label sets disagree
    on some codes and are both kept."""
    type_labels = dict(S.DATA_TYPE_LABELS)
    chart_labels = dict(S.CHART_LABELS)
    codes = list(dict.fromkeys([c for c, _ in S.DATA_TYPE_LABELS] + [c for c, _ in S.CHART_LABELS]))
    rows = [(c, type_labels.get(c), chart_labels.get(c)) for c in codes]
    return spark.createDataFrame(rows, "CODE string, TYPE_LABEL string, CHART_LABEL string")


def exception_dimension(spark: SparkSession) -> DataFrame:
    """Station-name substring -> city, with its priority."""
    rows = [(i, k, v) for i, (k, v) in enumerate(S.CITY_EXCEPTIONS)]
    return spark.createDataFrame(rows, "PRIORITY int, STATION_KEY string, CITY string")


def preferred_stations(spark: SparkSession) -> DataFrame:
    """Inverse of the exception list: city -> its preferred stations."""
    return (exception_dimension(spark)
            .groupBy(F.upper("CITY").alias("CITY"))
            .agg(F.sort_array(F.collect_list(F.struct("PRIORITY", F.upper("STATION_KEY")
                                                      .alias("STATION")))).alias("_s"))
            .select("CITY", F.transform("_s", lambda s: s["STATION"]).alias("STATIONS")))


def with_labels(df: DataFrame, code_col: str, spark: SparkSession | None = None) -> DataFrame:
    """Attach labels to a code column (J1): broadcast left join; codes
    without a form label read ``Unknown (<code>)``, chart labels fall back to
    the code itself."""
    spark = spark or df.sparkSession
    labels = F.broadcast(label_dimension(spark))
    out = df.join(labels, df[code_col] == labels["CODE"], "left")
    return out.select(
        *[df[c] for c in df.columns],
        F.coalesce(F.col("TYPE_LABEL"), F.concat(F.lit("Unknown ("), df[code_col], F.lit(")")))
        .alias("TYPE_LABEL"),
        F.coalesce(F.col("CHART_LABEL"), df[code_col]).alias("CHART_LABEL"))


def with_element_meaning(df: DataFrame, code_col: str) -> DataFrame:
    """Attach element group and meaning to a code column (S15 lookup)."""
    el = F.broadcast(element_dimension(df.sparkSession))
    out = df.join(el, df[code_col] == el["CODE"], "left")
    return out.select(*[df[c] for c in df.columns], "ELEMENT_GROUP", "MEANING")


def restrict_to(df: DataFrame, keys: DataFrame, on: list[str] | str,
                max_bytes: int | None = None) -> DataFrame:
    """Rows whose key appears in ``keys`` (J2/J3): a left semi join, the key
    side broadcast when its size allows."""
    from ..operators.joins import DEFAULT_BROADCAST_BYTES, sized_broadcast
    return df.join(sized_broadcast(keys, max_bytes or DEFAULT_BROADCAST_BYTES), on=on,
                   how="left_semi")
