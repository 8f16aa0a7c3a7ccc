"""Station-name operators that need a join: city matching and station choice.

City matching is an equi-join of word n-grams against the city dimension:
each distinct station name is split into words, every run of 1..k words
(k = most words in any city) is a candidate, and candidates are joined to
the city names. The work is linear in the words of the station names; no
station is compared with every city.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.names import city_part, exception_city, name_tokens, preferred_station_keys
from ..functions.text import strip
from ..session import materialize
from .joins import sized_broadcast
from .substrings import contained_keys


def prepare_cities(cities: DataFrame, column: str = "city") -> DataFrame:
    """Upper-case distinct city names (S17); ordering is done by the matcher."""
    return (cities.select(F.upper(F.col(column)).alias("CITY"))
            .filter(F.col("CITY").isNotNull() & (F.col("CITY") != "")).distinct())


def exception_cities(names: DataFrame, exceptions: DataFrame, name_col: str = "NAME") -> DataFrame:
    """``(name_col, CITY)`` of the names that contain an exception key.

    ``exceptions``: PRIORITY, STATION_KEY and CITY, any number of rows. The key
    of least priority (ties: the least city) counts; null and empty keys are
    ignored. Equal to the first match of an ordered list.
    """
    upper = names.select(name_col, F.upper(name_col).alias("TEXT")).distinct()
    keyed = exceptions.select("PRIORITY", F.upper("STATION_KEY").alias("KEY"), "CITY")
    best = keyed.groupBy("KEY").agg(F.min(F.struct("PRIORITY", "CITY")).alias("best"))
    found = (contained_keys(upper, keyed).join(sized_broadcast(best), "KEY")
             .groupBy("TEXT").agg(F.min("best")["CITY"].alias("CITY")))
    return upper.join(found, "TEXT").select(name_col, "CITY")


def match_cities(stations: DataFrame, cities: DataFrame, name_col: str = "NAME",
                 exceptions=S.CITY_EXCEPTIONS) -> DataFrame:
    """City of each distinct station name (N5): exception list first, else the
    longest city (ties: alphabetical) that appears as whole words; else NULL.

    ``cities`` has one column ``CITY`` (see ``prepare_cities``).
    ``exceptions`` is a short list of pairs or a table (see ``exception_cities``).
    Returns (name_col, CITY).
    """
    # One row per distinct name, written once: both the n-gram side and the
    # final left join read it, so the (large) input is scanned once.
    names = materialize(stations.select(F.col(name_col).alias("_name")).filter(
        F.col("_name").isNotNull()).distinct(), "names")
    max_words = cities.select(F.max(F.size(F.split("CITY", " ")))).scalar()
    toks = (names.select("_name", name_tokens("_name").alias("_w"))
            .filter(F.size("_w") > 0).withColumn("_maxw", F.coalesce(max_words, F.lit(0))))
    n = F.size("_w")
    grams = toks.filter(F.col("_maxw") > 0).select("_name", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.transform(F.sequence(F.lit(1), F.least(F.col("_maxw"), n - i)),
                              lambda k: F.array_join(F.slice("_w", i + 1, k), " ")))))
        .alias("CITY"))
    hits = grams.join(sized_broadcast(cities), on="CITY")
    best = hits.groupBy("_name").agg(
        F.min(F.struct((-F.length("CITY")).alias("k"), F.col("CITY"))).getField("CITY")
        .alias("_word_city"))
    out = names.join(sized_broadcast(best, rows_of=names), on="_name", how="left")
    if isinstance(exceptions, DataFrame):
        special = exception_cities(names, exceptions, "_name").withColumnRenamed("CITY", "_special")
        return out.join(sized_broadcast(special, rows_of=names), on="_name", how="left").select(
            F.col("_name").alias(name_col), F.coalesce("_special", "_word_city").alias("CITY"))
    return out.select(F.col("_name").alias(name_col),
                      F.coalesce(exception_city("_name", exceptions),
                                 F.col("_word_city")).alias("CITY"))


def with_city_name(df: DataFrame, cities: DataFrame) -> DataFrame:
    """Fill CITY_NAME of observations from the station name (Q21 via N5).

    Matching runs once per distinct name; the (name -> city) table, one row
    per station, joins back to the rows by an equi-join on NAME.
    """
    # One row per station, written once: its real size decides the broadcast.
    matched = materialize(match_cities(df.select("NAME"), cities)
                          .withColumnRenamed("CITY", "_city"), "city-of-name")
    base = df.drop("CITY_NAME") if "CITY_NAME" in df.columns else df
    out = base.join(sized_broadcast(matched), on="NAME", how="left").withColumnRenamed(
        "_city", "CITY_NAME")
    return out.select(*[c for c in S.STORED_COLS if c in out.columns],
                      *[c for c in out.columns if c not in S.STORED_COLS])


def city_match_rate(station_text: DataFrame, cities: DataFrame,
                    text_col: str = "STATION_TEXT") -> DataFrame:
    """Matched / total over distinct station strings."""
    m = match_cities(station_text, cities, text_col)
    return m.agg(F.count(F.lit(1)).alias("n_stations"),
                 F.count("CITY").alias("n_matched"))


def choose_station(candidates: DataFrame, query_col: str = "QUERY",
                   position_col: str = "POSITION", text_col: str = "CANDIDATE",
                   exceptions=S.CITY_EXCEPTIONS) -> DataFrame:
    """Pick one candidate station per query city.

    A candidate whose text holds a preferred station of the city wins; else
    the first whose text holds the city text (the query before its comma);
    else the first candidate. "First" is by ``position_col``. One grouped
    min over a struct: no sort of whole groups. ``exceptions`` is a short list
    of pairs or a table (see ``exception_cities``).
    """
    city = F.lower(strip_city(F.col(query_col)))
    text = F.lower(F.col(text_col))
    if isinstance(exceptions, DataFrame):
        keys = exceptions.select(F.lower("CITY").alias("_city"),
                                 strip(F.lower(F.split("STATION_KEY", ",", -1).getItem(0))).alias("KEY")).distinct()
        held = contained_keys(candidates.select(text.alias("TEXT")), keys).join(keys, "KEY")
        held = held.select(F.col("TEXT").alias("_text"), "_city").distinct().withColumn("_held", F.lit(True))
        candidates = candidates.withColumns({"_city": city, "_text": text}).join(held, ["_city", "_text"], "left")
        is_pref = F.col("_held").isNotNull()
    else:
        prefs = preferred_station_keys(F.upper(city), exceptions)
        is_pref = F.exists(prefs, lambda p: text.contains(p))
    is_city = text.contains(city)
    rule = (F.when(is_pref, F.lit(0)).when(is_city, F.lit(1)).otherwise(F.lit(2)))
    ranked = candidates.select(F.col(query_col), rule.alias("_r"), F.col(position_col),
                               F.col(text_col))
    best = ranked.groupBy(query_col).agg(
        F.min(F.struct("_r", position_col, text_col)).alias("_best"))
    return best.select(
        query_col,
        F.col("_best").getField(text_col).alias("CHOSEN"),
        F.col("_best").getField(position_col).alias(position_col),
        F.element_at(F.array(F.lit("preferred"), F.lit("city"), F.lit("first")),
                     F.col("_best").getField("_r") + 1).alias("RULE"))


def strip_city(query):
    """City text of a query such as "NEW YORK, NY" (the part before the comma)."""
    return city_part(query)
