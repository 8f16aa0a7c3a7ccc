import re

from stratus.llm import revisits as R
from stratus.llm.queries import captures

SCHEMA = ("record_id bigint, url string, time bigint, kind string, etag string, digest string, last_modified string,"
          " headers map<string,string>")
H = {"ETag": '"a"', "Content-Type": "text/html", "Date": "d1"}


def brute(rows):
    def canon(url):
        if url is None:
            return None
        bare = re.sub(r"#.*$", "", url.strip())
        m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)([^?]*)(?:\?(.*))?$", bare)
        params = sorted(p for p in (m[3] or "").split("&") if p and p.split("=")[0] not in R.TRACKING)
        return (re.sub(r"^www\.|:(?:80|443)$", "", m[1].lower()) + re.sub(r"/+$", "", m[2])
                + ("?" + "&".join(params) if params else ""))
    strong = lambda e: None if e is None else re.sub("^W/", "", e)
    out = []
    for i, url, t, kind, etag, digest, modified, headers in rows:
        if kind != "revisit":
            continue
        own = {k.lower(): v for k, v in (headers or {}).items()}
        earlier = [r for r in rows if r[3] == "response" and None not in (r[0], r[2], i, t, url, r[1])
                   and canon(r[1]) == canon(url) and (r[2], r[0]) < (t, i)]
        target = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        status = "orphan"
        if target:
            ok = (strong(etag) == strong(target[4]) if etag is not None else digest == target[5] if digest is not None
                  else modified == target[6] if modified is not None else True)
            status = "resolved" if ok else "mismatch"
        merged = own
        if status == "resolved":
            merged = {k.lower(): v for k, v in (target[7] or {}).items()}
            merged.update({k: v for k, v in own.items() if k in R.PERMITTED_HEADERS and v is not None})
        out.append((i, canon(url), status, target[0] if status == "resolved" else None, merged))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://www.A.org/x/", 10, "response", '"a"', "s1", "m1", H),
    (2, "https://a.org:443/x#frag", 11, "revisit", 'W/"a"', None, None, {"Date": "d2", "Content-Type": "no", "Expires": "e"}),
    (3, "a.org/x?utm_source=f", 12, "revisit", '"b"', None, None, None),
    (4, "http://a.org/x", 13, "response", '"b"', "s2", None, {}),
    (5, "http://a.org/x", 14, "revisit", None, "s2", "zz", {}), (6, "http://a.org/x", 14, "revisit", None, None, "m1", None),
    (7, "http://a.org/x", 14, "revisit", None, None, None, {"X": "y"}), (8, "http://a.org/y", 14, "revisit", '"a"', None, None, None),
    (9, "http://a.org/x", 9, "revisit", '"a"', None, None, None), (10, None, 20, "revisit", None, None, None, H),
    (11, "http://a.org/x", None, "revisit", None, None, None, None), (12, "http://a.org/x", 13, "revisit", None, "s2", None, None),
    (13, "http://a.org/x?b=2&a=1", 5, "response", None, "q", None, None), (14, "http://a.org/x?a=1&b=2", 6, "revisit", None, "q", None, {"age": "1"}),
    (14, "http://a.org/x?a=1&b=2", 6, "revisit", None, "q", None, {"age": "1"}), (15, "", 1, "revisit", None, None, None, None),
    (None, "http://a.org/x", 30, "revisit", None, None, None, None), (None, "http://a.org/x", 29, "response", None, None, None, None),
]


def run(records):
    return sorted(((r.record_id, r.canonical, r.status, r.target_id, r.headers) for r in R.resolve(records).collect()), key=repr)


def sort_headers(rows):
    return sorted(((*r[:4], sorted(r[4].items())) for r in rows), key=repr)


def test_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'x' AS canonical_", "1 AS target")
    assert sort_headers(run(df)) == sort_headers(brute(ROWS))


def test_hot_url_is_sliced(spark):
    rows = [(i, "http://hot.org/", i * 7 % 1000, "response" if i % 5 == 0 else "revisit", None, None, None, {"n": str(i)})
            for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sort_headers(run(df)) == sort_headers(brute(rows))


def test_empty_and_derived_tables(spark, sf_small):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    records = captures(spark.read.parquet(f"{sf_small}/pages.parquet"))
    rows = [tuple(r) for r in records.collect()]
    got = run(records)
    assert sort_headers(got) == sort_headers(brute(rows)) and {r[2] for r in got} == {"orphan", "resolved", "mismatch"}


def test_header_names_that_differ_in_case_only(spark):
    response = {"ETag": '"a"', "etag": '"b"', "X": "1", "x": "2"}
    revisit = {"Date": "d1", "date": "d2", "DATE": "d3", "X": "9"}
    rows = [(1, "http://a/", 1, "response", None, None, None, response),
            (2, "http://a/", 2, "revisit", None, None, None, revisit),
            (3, "http://b/", 2, "revisit", None, None, None, revisit),
            (None, "http://a/", 3, "revisit", None, None, None, None)]
    found = {r.record_id: r for r in R.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[2].status == "resolved" and found[2].headers == {"etag": '"b"', "x": "2", "date": "d2"}
    assert found[3].status == "orphan" and found[3].headers == {"date": "d2", "x": "9"}
    assert found[None].status == "orphan" and found[None].headers == {}
