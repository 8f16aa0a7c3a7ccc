"""Column functions over station names ("CITY PLACE, ST US")."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .text import strip


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def city_part(name: str | Column = "NAME") -> Column:
    """Text before the first comma, stripped; NULL for a missing or empty name."""
    n = _c(name)
    return F.when(n != "", strip(F.split(n, ",", -1).getItem(0)))


def state_part(name: str | Column = "NAME") -> Column:
    """Text between the first and second comma, stripped; NULL without a comma."""
    return strip(F.get(F.split(_c(name), ",", -1), 1))


def words(text: str | Column) -> Column:
    """Whitespace-separated words (no empty words)."""
    return F.filter(F.split(_c(text), r"\s+", -1), lambda w: w != "")


def city_words(name: str | Column = "NAME", stop_words=S.CITY_STOP_WORDS) -> Column:
    """Words of the city part up to the first stop word, space-joined.

    May be the empty string; NULL for a missing or empty name.
    """
    ws = words(city_part(name))
    stops = F.array(*[F.lit(w) for w in stop_words])
    first_stop = F.array_min(F.transform(
        ws, lambda w, i: F.when(F.array_contains(stops, F.upper(w)), i)))
    keep = F.coalesce(first_stop, F.size(ws))
    return F.when(_c(name) != "", F.array_join(F.slice(ws, 1, keep), " "))


def exception_city(name: str | Column = "NAME", exceptions=S.CITY_EXCEPTIONS) -> Column:
    """City of the first exception key contained in the upper-case name."""
    upper = F.upper(_c(name))
    out = None
    for key, city in exceptions:
        cond = upper.contains(key.upper())
        out = F.when(cond, F.lit(city)) if out is None else out.when(cond, F.lit(city))
    return out if out is not None else F.lit(None).cast("string")


def preferred_station_keys(city_upper: str | Column, exceptions=S.CITY_EXCEPTIONS) -> Column:
    """Lower-case station keys (text before any comma) preferred for a city.

    The inverse of the exception list: city -> its exception stations.
    """
    city = _c(city_upper)
    by_city: dict[str, list[str]] = {}
    for station, c in exceptions:
        by_city.setdefault(c.upper(), []).append(station.lower().split(",", 1)[0].strip())
    out = None
    for c, stations in by_city.items():
        arr = F.array(*[F.lit(s) for s in stations])
        out = F.when(city == c, arr) if out is None else out.when(city == c, arr)
    empty = F.array().cast("array<string>")
    return out.otherwise(empty) if out is not None else empty


def name_tokens(name: str | Column = "NAME") -> Column:
    """Upper-case word tokens of a name (letters, digits, underscore)."""
    return F.regexp_extract_all(F.upper(_c(name)), F.lit(r"(?U)\w+"), 0)
