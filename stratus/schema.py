"""Observation schema, column groups and the fixed lookup values.

Everything in the "fixed values" block must equal what the original
application uses, so results line up; it is stated here as plain data.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column groups (must equal the original application's)
# ---------------------------------------------------------------------------

BASE_COLS = ["STATION", "DATE", "LATITUDE", "LONGITUDE", "ELEVATION", "NAME"]

# Measures kept by cleaning, in cleaning / storage order.
KEEP_MEASURES = ["TAVG", "TMIN", "TMAX", "WT16", "SNOW", "ACMH", "WSFG",
                 "PRCP", "RHAV", "TSUN", "WT08", "WT01", "WT02"]

# Same 13 measures in the order the period aggregates use.
AGG_MEASURES = ["TMIN", "TAVG", "TMAX", "PRCP", "SNOW", "TSUN",
                "ACMH", "WSFG", "RHAV", "WT01", "WT02", "WT08", "WT16"]

# Event flags the condition aggregate sums instead of averaging.
SUMMED_EVENTS = ["WT16", "WT08", "WT01"]

TEMP_COLS = ["TAVG", "TMIN", "TMAX"]

# Measures of the correlation chart (all but WT02).
CORRELATION_MEASURES = ["TMIN", "TAVG", "TMAX", "PRCP", "SNOW", "TSUN",
                        "ACMH", "WSFG", "RHAV", "WT01", "WT08", "WT16"]

# Events of the yearly event-frequency chart.
EVENT_CHART_COLS = ["WT01", "WT08", "WT16", "WSFG"]

# Measures of the yearly distribution chart.
DISTRIBUTION_COLS = ["TAVG", "PRCP", "SNOW"]

STORED_COLS = BASE_COLS + ["CITY_NAME"] + KEEP_MEASURES

ATTRIBUTE_SUFFIX = "_ATTRIBUTES"

OBSERVATION_SCHEMA = T.StructType(
    [T.StructField("STATION", T.StringType()),
     T.StructField("DATE", T.DateType()),
     T.StructField("LATITUDE", T.DoubleType()),
     T.StructField("LONGITUDE", T.DoubleType()),
     T.StructField("ELEVATION", T.DoubleType()),
     T.StructField("NAME", T.StringType()),
     T.StructField("CITY_NAME", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in KEEP_MEASURES])


def raw_schema(columns: list[str]) -> T.StructType:
    """All-text schema for a raw CSV header (no type inference)."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


# ---------------------------------------------------------------------------
# Fixed values (must equal the original application's)
# ---------------------------------------------------------------------------

# Tokens the CSV reader of the original treats as missing, besides blanks.
NA_TOKENS = ["NA", "N/A", "n/a", "NaN", "nan", "-nan", "-NaN", "null", "NULL",
             "None", "<NA>", "#N/A", "#NA", "#N/A N/A", "1.#IND", "-1.#IND",
             "1.#QNAN", "-1.#QNAN"]

# Dates the original's timestamp type can hold (nanoseconds since 1970 in a
# signed 64-bit integer); text dates outside this range are missing there.
EARLIEST_DATE = "1677-09-22"
LATEST_DATE = "2262-04-11"

# Temperature plausibility limits (tenths of a degree).
TEMP_LOWER = -500.0
TEMP_UPPER = 512.0          # cleaning keeps [-500, 512] for all three
AUDIT_UPPER_AVG_MIN = 500.0  # the audit flags TAVG/TMIN above 500 ...
AUDIT_UPPER_MAX = 512.0      # ... and TMAX above 512
EXTREME_COLD = -100.0

# Thresholds of the charts and audits.
HEAVY_PRCP_LIMIT = 5000.0
MIN_EVENT_TOTAL = 250
SNOW_SHARE_MIN = 0.01
SNOW_RANK_MIN = 0.15
TOP_STATIONS = 20
PAGE_SIZE = 10
INCH_PER_MM = 0.03937

# Words that end the city part of a station name.
CITY_STOP_WORDS = ["UNIVERSI", "UNIVERSITY", "AIRPORT", "INTERNATIONAL",
                   "STATION", "FIELD", "MIDWAY", "PARK", "RIVERSIDE", "STATE"]

# Station-name substring -> city, checked in this order before word matching.
CITY_EXCEPTIONS = [
    ("JFK INTERNATIONAL AIRPORT", "NEW YORK"),
    ("NEWARK LIBERTY INTERNATIONAL AIRPORT", "NEWARK"),
    ("NY CITY CENTRAL PARK", "NEW YORK"),
    ("LOWER ST. ANTHONY FALLS, MN US", "MINNEAPOLIS"),
    ("BALTIMORE HAMILTON, MD US", "BALTIMORE"),
]

# Data-type code -> form label (unknown codes read "Unknown (<code>)").
DATA_TYPE_LABELS = [
    ("TAVG", "Average temperature"),
    ("WT16", "Rain"),
    ("Snow", "Snowfall"),
    ("WT01", "Fog, ice fog, or freezing fog"),
    ("ACMH", "Average cloudiness (midnight-midnight)"),
    ("WSFG", "Average daily wind speed"),
    ("PRCP", "Precipitation"),
    ("RHAV", "Average relative humidity"),
    ("TSUN", "Daily total sunshine"),
    ("WT08", "Smoke or haze"),
]

# Measure code -> chart label.
CHART_LABELS = [
    ("TAVG", "Average Temperature"),
    ("TMAX", "Maximum Temperature"),
    ("TMIN", "Minimum Temperature"),
    ("PRCP", "Precipitation"),
    ("SNOW", "Snowfall"),
    ("TSUN", "Sunshine Duration"),
    ("ACMH", "Average Cloud Height"),
    ("WSFG", "Wind Gust Speed"),
    ("RHAV", "Relative Humidity"),
    ("WT01", "Fog Occurrence"),
    ("WT08", "Smoke or Haze Occurrence"),
    ("WT16", "Rain Occurrence"),
]

# Data-type code -> measure columns of its station chart and chart kind.
DATA_TYPE_COLUMNS = {
    "TAVG": (["TMIN", "TAVG", "TMAX"], "line"),
    "PRCP": (["PRCP"], "bar"),
    "WT16": (["WT16"], "line"),
    "Snow": (["SNOW"], "bar"),
    "ACMH": (["ACMH"], "line"),
    "WSFG": (["WSFG"], "line"),
    "RHAV": (["RHAV"], "line"),
    "TSUN": (["TSUN"], "line"),
    "WT08": (["WT08"], "bar"),
    "WT01": (["WT01", "WT02"], "scatter"),
}

# Element dictionary: code, group, meaning.
ELEMENTS = [
    ("STATION", "Location", "Unique Station ID"),
    ("DATE", "Location", "Observation Date (YYYY-MM-DD)"),
    ("LATITUDE", "Location", "Location latitude (decimal degrees)"),
    ("LONGITUDE", "Location", "Location longitude (decimal degrees)"),
    ("ELEVATION", "Location", "Elevation (in meters)"),
    ("NAME", "Location", "Station Name"),
    ("PRCP", "Precipitation & Snow", "Precipitation (tenths of mm)"),
    ("SNOW", "Precipitation & Snow", "Snowfall (mm or cm)"),
    ("SNWD", "Precipitation & Snow", "Snow depth on ground (mm or cm)"),
    ("TMAX", "Temperature", "Max temp (°C ×10)"),
    ("TMIN", "Temperature", "Min temp (°C ×10)"),
    ("TAVG", "Temperature", "Avg temp (°C ×10)"),
    ("AWND", "Wind", "Avg wind speed (m/s ×10)"),
    ("WSFG", "Wind", "Max wind gust"),
    ("WDFG", "Wind", "Wind direction of gust"),
    ("WDF1", "Wind", "Wind direction (1-minute)"),
    ("WDF2", "Wind", "Wind direction (2-minute)"),
    ("WDF5", "Wind", "Wind direction (5-minute)"),
    ("WSF1", "Wind", "Wind speed (1-minute)"),
    ("WSF2", "Wind", "Wind speed (2-minute)"),
    ("WSF5", "Wind", "Wind speed (5-minute)"),
    ("TSUN", "Sun, Pressure & Sky", "Total sunshine (minutes)"),
    ("PSUN", "Sun, Pressure & Sky", "% possible sunshine"),
    ("ASLP", "Sun, Pressure & Sky", "Avg sea-level pressure"),
    ("ASTP", "Sun, Pressure & Sky", "Avg station pressure"),
    ("ACMH", "Sun, Pressure & Sky", "Avg cloud cover (midnight)"),
    ("ACSH", "Sun, Pressure & Sky", "Avg cloud cover (sunrise)"),
    ("SN12", "Snow Variants", "Snowfall over 12 hours"),
    ("SN32", "Snow Variants", "Snowfall over 32 hours"),
    ("SN52", "Snow Variants", "Snowfall over 52 hours"),
    ("SX12", "Snow Variants", "Snow depth max over 12 hours"),
    ("SX32", "Snow Variants", "Snow depth max over 32 hours"),
    ("SX52", "Snow Variants", "Snow depth max over 52 hours"),
    ("WT01", "Weather Type Flags", "Fog / freezing fog"),
    ("WT02", "Weather Type Flags", "Heavy fog"),
    ("WT03", "Weather Type Flags", "Thunder"),
    ("WT04", "Weather Type Flags", "Ice pellets/sleet"),
    ("WT05", "Weather Type Flags", "Hail"),
    ("WT06", "Weather Type Flags", "Glaze/rime"),
    ("WT07", "Weather Type Flags", "Blowing dust"),
    ("WT08", "Weather Type Flags", "Smoke/haze"),
    ("WT09", "Weather Type Flags", "Blowing snow"),
    ("WT10", "Weather Type Flags", "Tornado/funnel cloud"),
    ("WT11", "Weather Type Flags", "High/damaging winds"),
    ("WT13", "Weather Type Flags", "Lightning"),
    ("WT14", "Weather Type Flags", "Mist"),
    ("WT15", "Weather Type Flags", "Drizzle"),
    ("WT16", "Weather Type Flags", "Rain"),
    ("WT17", "Weather Type Flags", "Snow"),
    ("WT18", "Weather Type Flags", "Ground fog"),
    ("WT19", "Weather Type Flags", "Ice crystals"),
    ("WT21", "Weather Type Flags", "Snow grains"),
    ("WT22", "Weather Type Flags", "Freezing drizzle"),
    ("DAEV", "Other Variables", "Daily evaporation"),
    ("EVAP", "Other Variables", "Pan evaporation"),
    ("DAWM", "Other Variables", "Water movement"),
    ("PGTM", "Other Variables", "Peak gust time (minutes after midnight)"),
    ("FMTM", "Other Variables", "Time of max temperature"),
    ("MNPN", "Other Variables", "Min pan evaporation"),
    ("MXPN", "Other Variables", "Max pan evaporation"),
    ("FRGT", "Other Variables", "Freezing rain trace"),
]

