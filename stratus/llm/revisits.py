"""WARC not-modified revisits: as-of join to the latest earlier full response.

A revisit record says that a page had not changed, and carries no body. It is
resolved to the latest earlier full response of the same canonical URL, by an
as-of join over time. The join is accepted when the revisit's validators
agree with the response (its ETag when it names one, else its payload digest,
else Last-Modified; with no validator at all the server's word stands). The
resolved record has the response's body and its headers, updated by those
headers of the revisit that a not-modified answer may change.

One URL may hold a large share of the captures, so the records are range
partitioned by URL and time and each partition is a slice: the latest response
of each (URL, slice) is an aggregate, carried on to the following slices, and
only the rows of one slice are ordered in one task.

Defined cases: a revisit without an earlier response is ``orphan``; one whose
validators disagree is ``mismatch`` (both keep only their own headers and no
body); a record without URL or time is never a target and is an orphan as a
revisit; at equal times the smaller record id is the earlier; repeated rows
are resolved each by itself; a revisit without a record id is an orphan; null
headers are empty; of header names that differ in case only the last in order
counts (maps keep no order of their own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import staged

# Headers that a 304 answer may update (RFC 9110, 15.4.5; RFC 9111, 3.2).
PERMITTED_HEADERS = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
# Query parameters that do not change the page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme-less host without ``www.`` and default port, path
    without trailing slash, sorted query without tracking parameters, no
    fragment. Null stays null."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)", 1)),
                            r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def lowered_headers(headers: Column) -> Column:
    """Headers by lower-case name; of names that differ in case only the last in order counts."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    entries = F.sort_array(entries)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    last = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, updated by the revisit's permitted ones."""
    allowed = F.map_filter(lowered_headers(revisit), lambda k, v: k.isin(*PERMITTED_HEADERS) & v.isNotNull())
    rest = F.map_filter(lowered_headers(response), lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(rest, allowed)


def _agree(revisit: str, response: str) -> Column:
    strong = lambda c: F.regexp_replace(c, r"^W/", "")
    a, b = (lambda n: F.col(f"{revisit}.{n}")), (lambda n: F.col(f"{response}.{n}"))
    return (F.when(a("etag").isNotNull(), F.coalesce(strong(a("etag")) == strong(b("etag")), F.lit(False)))
            .when(a("digest").isNotNull(), F.coalesce(a("digest") == b("digest"), F.lit(False)))
            .when(a("last_modified").isNotNull(), F.coalesce(a("last_modified") == b("last_modified"), F.lit(False)))
            .otherwise(F.lit(True)))


def latest_responses(records: DataFrame) -> DataFrame:
    """``(record_id, time, canonical, target)`` of the revisits with a target.

    ``records`` is sliced: within a canonical URL, a later slice holds only
    later records. ``target`` holds the time, id and validators of the response.
    """
    response = F.when(F.col("kind") == "response", F.struct("time", "record_id", "etag", "digest", "last_modified"))
    sliced = (records.where(F.col("canonical").isNotNull() & F.col("time").isNotNull() & F.col("record_id").isNotNull())
              .select("canonical", "slice", "time", "record_id", "kind", response.alias("response")))
    slices = sliced.groupBy("canonical", "slice").agg(F.max("response").alias("last"))
    earlier = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("canonical", "slice", F.max("last").over(earlier).alias("carried"))
    so_far = (Window.partitionBy("canonical", "slice").orderBy("time", "record_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    within = sliced.withColumn("inside", F.max("response").over(so_far)).where("kind = 'revisit'")
    return (within.join(carried, ["canonical", "slice"])
            .select("canonical", "time", "record_id", F.coalesce("inside", "carried").alias("target"))
            .where(F.col("target").isNotNull())
            .groupBy("canonical", "time", "record_id").agg(F.max("target").alias("target")))


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: status, target, merged headers and the body's key.

    ``records``: record_id, url, time, kind ('response' or 'revisit'), etag,
    digest, last_modified, headers (map). Bodies are not read: join
    ``target_id`` with the response records to fetch them.
    """
    wanted = ["record_id", "url", "time", "kind", "etag", "digest", "last_modified", "headers"]
    keyed = records.select(*wanted, canonical_url(F.col("url")).alias("canonical"))
    # Range partitions split a hot URL by time; the slice is written with the row.
    ordered = keyed.repartitionByRange("canonical", "time", "record_id")
    base = staged(ordered.withColumn("slice", F.spark_partition_id()), "revisits")
    found = latest_responses(base)
    revisits = base.where("kind = 'revisit'").alias("v")
    joined = revisits.join(found.alias("f"), (F.col("v.record_id") == F.col("f.record_id")) & (F.col("v.time") == F.col("f.time"))
                           & (F.col("v.canonical") == F.col("f.canonical")), "left")
    checked = joined.select(
        "v.*", "f.target", F.when(F.col("f.target").isNull(), "orphan")
        .when(_agree("v", "f.target"), "resolved").otherwise("mismatch").alias("status"))
    # The response's headers come by its id: small rows, without the bodies.
    sources = (base.where("kind = 'response'").groupBy("canonical", "time", "record_id")
               .agg(F.max_by("headers", F.to_json("headers")).alias("source_headers")))
    s = sources.alias("s")
    merged = checked.alias("c").join(
        s, (F.col("c.status") == "resolved") & (F.col("s.record_id") == F.col("c.target.record_id"))
        & (F.col("s.time") == F.col("c.target.time")) & (F.col("s.canonical") == F.col("c.canonical")), "left")
    own = lowered_headers(F.col("c.headers"))
    resolved = F.col("c.status") == "resolved"
    return merged.select(
        "c.record_id", "c.canonical", "c.time", "c.status",
        F.when(resolved, F.col("c.target.record_id")).alias("target_id"),
        F.when(resolved, F.col("c.target.digest")).alias("digest"),
        F.when(resolved, merged_headers(F.col("s.source_headers"), F.col("c.headers"))).otherwise(own).alias("headers"))
