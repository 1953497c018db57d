"""WARC revisits: "not modified" records resolved to the latest earlier full response of the same canonical URL.

Records are a table ``record_id long, kind string ('response' or 'revisit'), url string, ts long (seconds), status int,
headers map<string,string>, digest string``. The join is as-of by time within a canonical URL. It runs on points, the distinct
(URL, time) pairs: each keeps its full response with the greatest record_id, so copies of a capture weigh nothing. Time is cut
at quantiles into slices; a slice carries over the last response of the slices before it, so a URL with a third of all
captures is spread over the slices. Headers travel with the points, payloads do not: a resolved revisit names the record that
holds its payload.

A revisit is checked against that response: by entity tag if it has one (weak comparison), else by Last-Modified, else by
payload digest. The merged headers are the response's, updated by the revisit's, but for those that a 304 may not change.

Cases
-----
* outcome ``resolved``; ``mismatch`` if a validator differs or the response lacks it; ``no_validator`` if the revisit has none;
  ``no_response`` if there is no earlier full response; ``no_url`` where the URL is null; only ``resolved`` rows have headers and digest
* a response at the revisit's own time is not earlier; of responses at one time the greatest record_id counts
* responses other than status 200, and those without time or id, are not full; a revisit without time has no earlier response
* null headers are empty, header names are compared in lower case (of repeats the last in name order stays); repeated
  revisits are each resolved; an empty table gives an empty report; other columns are ignored
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, stage

#: Header fields that a 304 does not change (fixed values): they belong to the connection or describe the stored payload.
NOT_UPDATED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, default port, fragment, tracking parameters and final slashes; host in lower case."""
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z]+://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www[0-9]*\.", ""), ":(80|443)$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z]+://[^/?]*", "")
    rest = F.regexp_replace(rest, "([?&])utm_[a-z]+=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "[?]&+", "?"), "[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, r"/+([?]|$)", "$1"))


def _headers(name: str = "headers") -> Column:
    """Sorted array of ``(name, value)``, names in lower case and distinct."""
    entries = F.coalesce(F.map_entries(name), F.array().cast("array<struct<key:string,value:string>>"))
    low = F.array_sort(F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    names = F.array_distinct(F.transform(low, lambda e: e["key"]))
    return F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(low, lambda e: e["key"] == n), -1)["value"].alias("value")))


def _value(entries: Column, name: str) -> Column:
    found = F.filter(entries, lambda e: e["key"] == name)
    return F.when(F.size(found) > 0, F.element_at(found, -1)["value"])


def _merged(stored: Column, update: Column) -> Column:
    fresh = F.filter(update, lambda e: ~e["key"].isin(*NOT_UPDATED))
    names = F.transform(fresh, lambda e: e["key"])
    kept = F.filter(stored, lambda e: ~F.array_contains(names, e["key"]))
    return F.map_from_entries(F.array_sort(F.concat(kept, fresh)))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``record_id, canonical_url, ts, outcome, resolved_id, headers, digest`` of every revisit."""
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), F.col("kind"), canonical_url(F.col("url")).alias("canonical_url"),
        F.col("ts").cast("long").alias("ts"), F.col("status").cast("int").alias("status"), _headers().alias("headers"), F.col("digest").cast("string").alias("digest"),
    )
    rows = stage(rows.where("kind IN ('response', 'revisit')"), "warc-records")
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull()
    response = F.struct("ts", "record_id", "headers", "digest")
    dated = rows.where("canonical_url IS NOT NULL AND ts IS NOT NULL")
    points = stage(dated.groupBy("canonical_url", "ts").agg(F.max(F.when(full, response)).alias("response")), "warc-points")

    n = 4 * parallelism(records.sparkSession)
    cuts = points.select(F.percentile_approx("ts", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    points = points.withColumn("slice", F.size(F.filter(bounds, lambda c: c <= F.col("ts"))))
    within = Window.partitionBy("canonical_url", "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    last = points.groupBy("canonical_url", "slice").agg(F.max("response").alias("last"))
    last = last.select("canonical_url", "slice", F.max("last").over(across).alias("carried"))
    asof = points.withColumn("here", F.max("response").over(within)).join(last, ["canonical_url", "slice"])
    asof = stage(asof.select("canonical_url", "ts", F.coalesce("here", "carried").alias("stored")), "warc-asof")

    found = rows.where("kind = 'revisit'").hint("merge").join(asof, ["canonical_url", "ts"], "left")
    stored = F.col("stored")
    tag = F.regexp_replace(_value(F.col("headers"), "etag"), "^W/", "")
    stored_tag = F.regexp_replace(_value(stored["headers"], "etag"), "^W/", "")
    since, stored_since = _value(F.col("headers"), "last-modified"), _value(stored["headers"], "last-modified")

    def same(a: Column, b: Column) -> Column:
        return F.when(a == b, "resolved").otherwise("mismatch")

    outcome = (
        F.when(F.col("canonical_url").isNull(), "no_url").when(stored.isNull(), "no_response").when(tag.isNotNull(), same(tag, stored_tag))
        .when(since.isNotNull(), same(since, stored_since)).when(F.col("digest").isNotNull(), same(F.col("digest"), stored["digest"])).otherwise("no_validator")
    )
    found = found.withColumn("outcome", outcome)

    def if_resolved(c: Column) -> Column:
        return F.when(F.col("outcome") == "resolved", c)

    return found.select(
        "record_id", "canonical_url", "ts", "outcome", stored["record_id"].alias("resolved_id"),
        if_resolved(_merged(stored["headers"], F.col("headers"))).alias("headers"), if_resolved(stored["digest"]).alias("digest"),
    )


def captures(pages: DataFrame, revisit_after: int = 1000) -> DataFrame:
    """Two records for each page, as a crawler would have left them: the page's own capture at second ``page_id``, and a "not modified" revisit. By
    page_id in turn, the revisit comes ``revisit_after`` seconds later with the entity tag, the modification date, the payload's digest or no validator that the
    server kept from then, or with the tag a second before the capture; every 29th has lost its URL."""
    page_id = F.col("page_id").cast("long")
    digest = F.md5(F.coalesce("html", F.lit("")))
    changed = F.concat(F.lit("day "), F.floor(page_id / 7).cast("string"))
    turn = F.pmod(page_id, F.lit(5))
    base = pages.select(page_id.alias("page_id"), F.col("url").cast("string").alias("url"), digest.alias("payload"), changed.alias("changed"), turn.alias("turn"), F.length(F.coalesce("html", F.lit(""))).alias("size"))

    def headers(*pairs: tuple[str, Column]) -> Column:
        entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs])
        return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))

    def record(no: Column, kind: str, url: Column, ts: Column, status: int, with_headers: Column, payload: Column) -> Column:
        return F.struct(no.alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"), ts.alias("ts"), F.lit(status).alias("status"), with_headers.alias("headers"), payload.alias("digest"))

    tag = F.concat(F.lit('"'), F.substring("payload", 1, 16), F.lit('"'))
    later = page_id + F.when(F.col("turn") == 4, -1).otherwise(revisit_after)
    first = headers(("Content-Length", F.col("size")), ("Content-Type", F.lit("text/html")), ("Date", page_id), ("ETag", tag), ("Last-Modified", F.col("changed")))
    again = headers(
        ("Content-Length", F.lit(0)), ("Date", later), ("ETag", F.when(F.col("turn").isin(0, 4), F.concat(F.lit("W/"), tag))),
        ("Last-Modified", F.when(F.col("turn") == 1, F.col("changed"))), ("X-Cache", F.lit("HIT")),
    )
    response = record(page_id * 2, "response", F.col("url"), page_id, 200, first, F.col("payload"))
    revisit = record(page_id * 2 + 1, "revisit", F.when(page_id % 29 != 0, F.col("url")), later, 304, again, F.when(F.col("turn") == 2, F.col("payload")))
    return base.select(F.inline(F.array(response, revisit)))
