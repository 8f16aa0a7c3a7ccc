import random

from pyspark.sql import functions as F

from stratus import schema as S
from stratus.functions import names as N
from stratus.operators import names as NM


def test_name_parts(spark):
    df = spark.createDataFrame([("NEW YORK INTERNATIONAL AIRPORT, NY US",), ("ABC",), ("",), (None,)],
                               "NAME string")
    rows = df.select("NAME", N.city_part("NAME").alias("c"), N.state_part("NAME").alias("s"),
                     N.city_words("NAME").alias("w")).collect()
    got = {r.NAME: (r.c, r.s, r.w) for r in rows}
    assert got["NEW YORK INTERNATIONAL AIRPORT, NY US"] == (
        "NEW YORK INTERNATIONAL AIRPORT", "NY US", "NEW YORK")
    assert got["ABC"] == ("ABC", None, "ABC")
    assert got[""] == (None, None, None)
    assert got[None] == (None, None, None)


def test_city_match(spark):
    cities = NM.prepare_cities(spark.createDataFrame(
        [("New York",), ("YORK",), ("ST. LOUIS",)], "city string"))
    stations = spark.createDataFrame(
        [("A NEW YORK LGA, NY US",), ("YORK 3 SSW, PA US",), ("ST. LOUIS LAMBERT, MO US",),
         ("NEWYORK X",), ("JFK INTERNATIONAL AIRPORT, NY US",), ("",)], "NAME string")
    got = {r.NAME: r.CITY for r in NM.match_cities(stations, cities).collect()}
    assert got == {"A NEW YORK LGA, NY US": "NEW YORK", "YORK 3 SSW, PA US": "YORK",
                   "ST. LOUIS LAMBERT, MO US": None, "NEWYORK X": None,
                   "JFK INTERNATIONAL AIRPORT, NY US": "NEW YORK", "": None}


def test_match_rate(spark):
    cities = NM.prepare_cities(spark.createDataFrame([("YORK",)], "city string"))
    st = spark.createDataFrame([("S1 YORK, PA US",), ("S2 X, PA US",)], "STATION_TEXT string")
    r = NM.city_match_rate(st, cities).first()
    assert (r.n_stations, r.n_matched) == (2, 1)


def test_station_choice(spark):
    cands = [("NEW YORK, NY", 1, "NEW YORK LAGUARDIA, NY US"),
             ("NEW YORK, NY", 2, "JFK INTERNATIONAL AIRPORT, NY US"),
             ("NEW YORK, NY", 3, "NEWARK, NJ US")]
    df = spark.createDataFrame(cands, "QUERY string, POSITION int, CANDIDATE string")
    r = NM.choose_station(df).first()
    assert (r.CHOSEN, r.RULE) == ("JFK INTERNATIONAL AIRPORT, NY US", "preferred")
    r = NM.choose_station(df.filter(F.col("POSITION") != 2)).first()
    assert (r.CHOSEN, r.RULE) == ("NEW YORK LAGUARDIA, NY US", "city")
    r = NM.choose_station(df.filter(F.col("POSITION") == 3)).first()
    assert (r.CHOSEN, r.RULE) == ("NEWARK, NJ US", "first")


def _brute_force_city(name, cities, exceptions):
    """Reference rule, written plainly: exception substring first, else the
    longest city (ties alphabetical) found as whole words in the name's word
    tokens joined by spaces."""
    import re
    upper = name.upper()
    for key, city in exceptions:
        if key in upper:
            return city
    joined = " ".join(re.findall(r"\b[\w\s]+\b", upper))
    for city in sorted(cities, key=lambda c: (-len(c), c)):
        if re.search(r"\b" + re.escape(city) + r"\b", joined):
            return city
    return None


def test_city_match_against_brute_force(spark):
    import random

    from stratus import schema as S
    rnd = random.Random(1)
    words = ["NEW", "YORK", "ST.", "LOUIS", "PARK", "CITY", "SAN", "JOSE", "LAKE", "N", "3",
             "AIRPORT", "WEST", "FT.", "WORTH", "O'HARE", "X-RAY", "JFK", "INTERNATIONAL"]
    city_list = ["NEW YORK", "YORK", "ST. LOUIS", "SAN JOSE", "LAKE CITY", "CITY", "WEST",
                 "JOSE", "FT WORTH", "X-RAY", "O'HARE"]
    names = set()
    for _ in range(400):
        parts = [rnd.choice(words) for _ in range(rnd.randint(1, 5))]
        sep = rnd.choice([", ", " ", " - "])
        names.add(" ".join(parts) + sep + rnd.choice(["NY US", "MO US", "CA US"]))
    names |= {"JFK INTERNATIONAL AIRPORT, NY US", "NEWARK LIBERTY INTERNATIONAL AIRPORT, NJ US"}
    cities = NM.prepare_cities(spark.createDataFrame([(c,) for c in city_list], "city string"))
    got = {r.NAME: r.CITY for r in NM.match_cities(
        spark.createDataFrame([(n,) for n in sorted(names)], "NAME string"), cities).collect()}
    for n in names:
        assert got[n] == _brute_force_city(n, city_list, S.CITY_EXCEPTIONS), n


def _random_names(n_names, n_keys):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("ABCDE .,'é") for _ in range(rng.randrange(1, 6)))
    keys = [(rng.randrange(n_keys // 2), word() + rng.choice(["", " ", word()]), f"C{rng.randrange(9)}") for _ in range(n_keys)]
    return [" ".join(word() for _ in range(rng.randrange(0, 9))) for _ in range(n_names)], keys


def test_exceptions_from_a_table_equal_every_key_tried(spark):
    names, keys = _random_names(300, 400)
    filler = [(1_000 + i, f"STATION NUMBER {i} FIELD", "NOWHERE") for i in range(10_000)]
    keys += filler + [(0, None, "X"), (0, "", "X"), (5_000, "number 77 field", "SEVEN")]
    names += ["A Station Number 77 Field, NY", "", None]
    got = {r.NAME: r.CITY for r in NM.exception_cities(
        spark.createDataFrame([(n,) for n in names + names], "NAME string"),
        spark.createDataFrame(keys, "PRIORITY int, STATION_KEY string, CITY string")).collect()}
    want = {}
    for n in names:
        hits = [(p, c) for p, k, c in keys if n is not None and k and k.upper() in n.upper()]
        if hits:
            want[n] = min(hits)[1]
    assert got == want and len(want) > 50


def test_a_table_of_exceptions_equals_the_list(spark):
    from stratus.sources.dimensions import exception_dimension
    table = exception_dimension(spark)
    names = spark.createDataFrame([(f"at {k.lower()} {i}",) for i, (k, _) in enumerate(S.CITY_EXCEPTIONS)]
                                  + [("YORK", ), ("x",), (None,)], "NAME string")
    cities = NM.prepare_cities(spark.createDataFrame([("York",)], "city string"))
    rows = lambda e: sorted(map(tuple, NM.match_cities(names, cities, exceptions=e).collect()))
    assert rows(table) == rows(S.CITY_EXCEPTIONS)
    candidates = spark.createDataFrame(
        [(f"{c.title()}, ST", p, t) for c in ("NEW YORK", "NEWARK", "MINNEAPOLIS", "OTHER") for p, t in
         enumerate(["first one", "at Lower St. Anthony Falls", "new york city", "Ny City Central Park 3", None])]
        + [(None, 0, "x")], "QUERY string, POSITION int, CANDIDATE string")
    rows = lambda e: sorted(map(tuple, NM.choose_station(candidates, exceptions=e).collect()), key=repr)
    assert rows(table) == rows(S.CITY_EXCEPTIONS)


def test_contained_keys_meet_on_a_gram(spark):
    from stratus.operators.substrings import contained_keys
    texts = spark.createDataFrame([("abcdef",), ("xyz",)], "TEXT string")
    found = contained_keys(texts, spark.createDataFrame([("cde",), ("f",), ("abcdefg",), ("yz",)], "KEY string"))
    assert sorted(map(tuple, found.collect())) == [("abcdef", "cde"), ("abcdef", "f"), ("xyz", "yz")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
