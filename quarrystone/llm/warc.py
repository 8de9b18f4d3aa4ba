"""WARC revisit records of the profile server-not-modified, resolved to stored responses.

A revisit is joined as of its time to the latest earlier full response with the same
canonical URL. Its validators are checked (ETag by weak comparison, else
Last-Modified, else the payload digest), and the headers that a 304 answer may
change are merged into the stored ones.

Time is cut into slices at quantiles, so that a URL with much of all captures spans
many groups; each slice passes on only its last response. Headers join last, by
record id.

Defined results: records without a URL, a time or an id take no part; header names
are compared in lower case; of responses at the same time the largest record id
counts; a response at the revisit's own time is not earlier; of repeated record ids
one counts; a revisit without a match has status no_response and null fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an answer 304 may change in the stored headers.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
SLICES = 64


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without its last slash, sorted query without tracking; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(url), "(?s)#.*$", ""), "^[hH][tT][tT][pP][sS]?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "(:80|:443)$", "")
    host = F.regexp_replace(host, "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/$", "")
    query = F.regexp_extract(bare, "(?s)^[^?]*[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|gclid|fbclid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.aggregate(entries, F.expr("cast(map() as map<string,string>)"), lambda m, e: F.when(F.map_contains_key(m, e["key"]), m).otherwise(F.map_concat(m, F.create_map(e["key"], e["value"]))))


def resolve(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """records(record_id long, kind 'response' or 'revisit', url, captured_at long, headers map, digest)

    -> for each revisit: record_id, canonical_url, response_id, response_at, status (resolved, mismatch,
    unchecked or no_response) and headers, the merged ones of a resolved or unchecked revisit.
    """
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("canonical_url"), "captured_at", _lowered(F.col("headers")).alias("headers"), "digest")
    rows = rows.where("record_id is not null and canonical_url is not null and captured_at is not null and kind in ('response', 'revisit')")
    at = [k / slices for k in range(1, slices)]
    cuts = sorted(set(rows.agg(F.percentile_approx("captured_at", at, 1000)).first()[0] or []))
    cut = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    slim = rows.select("record_id", "kind", "canonical_url", "captured_at", F.size(F.filter(cut, lambda c: c < F.col("captured_at"))).alias("slice"))
    full = F.when(F.col("kind") == "response", F.struct("captured_at", "record_id"))
    earlier = Window.partitionBy("canonical_url", "slice").orderBy("captured_at").rangeBetween(Window.unboundedPreceding, -1)
    inside = slim.withColumn("inside", F.max(full).over(earlier)).where("kind = 'revisit'")
    last = slim.groupBy("canonical_url", "slice").agg(F.max(full).alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("canonical_url", "slice", F.max("last").over(before).alias("carried")).where("carried is not null")
    found = inside.join(carried, ["canonical_url", "slice"], "left").select("record_id", F.coalesce("inside", "carried").alias("r"))
    found = found.select("record_id", F.col("r.record_id").alias("response_id"), F.col("r.captured_at").alias("response_at"))
    revisits = rows.where("kind = 'revisit'").dropDuplicates(["record_id"])
    responses = rows.where("kind = 'response'").dropDuplicates(["record_id"])
    stored = responses.select(F.col("record_id").alias("response_id"), F.col("headers").alias("stored"), F.col("digest").alias("stored_digest"))
    both = revisits.join(found.dropDuplicates(["record_id"]), "record_id").join(stored, "response_id", "left")

    def tag(headers: str) -> Column:
        return F.regexp_replace(F.btrim(F.col(headers)["etag"]), "^W/", "")

    def compared(a: Column, b: Column, otherwise: Column) -> Column:
        return F.when(a.isNull() | b.isNull(), otherwise).when(a == b, "resolved").otherwise("mismatch")

    modified = lambda headers: F.btrim(F.col(headers)["last-modified"])
    by_digest = compared(F.col("digest"), F.col("stored_digest"), F.lit("unchecked"))
    verdict = compared(tag("headers"), tag("stored"), compared(modified("headers"), modified("stored"), by_digest))
    status = F.when(F.col("response_id").isNull(), "no_response").otherwise(verdict)
    new = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    old = F.map_filter("stored", lambda k, v: ~F.map_contains_key(new, k))
    return both.withColumn("status", status).select(
        "record_id", "canonical_url", "response_id", "response_at", "status", F.when(F.col("status").isin("resolved", "unchecked"), F.map_concat(old, new)).alias("headers")
    )


def captures(pages: DataFrame, delay: int = 5000) -> DataFrame:
    """Two records for each row of pages(page_id, url, html): the full response at second page_id and, delay later, the answer 304 to a conditional request that carries its ETag."""
    etag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    length = F.octet_length("html").cast("string")

    def headers(*pairs: tuple[str, Column]) -> Column:
        return F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())

    full = headers(("Content-Type", F.lit("text/html")), ("Content-Length", length), ("ETag", etag), ("Date", F.col("page_id").cast("string")))
    again = headers(("Content-Length", F.lit("0")), ("ETag", F.concat(F.lit("W/"), etag)), ("Date", (F.col("page_id") + delay).cast("string")), ("Cache-Control", F.lit("no-cache")))
    digest = F.concat(F.lit("md5:"), F.md5("html"))

    def record(kind: str, number: Column, time: Column, heads: Column) -> Column:
        return F.struct(number.alias("record_id"), F.lit(kind).alias("kind"), "url", time.alias("captured_at"), heads.alias("headers"), digest.alias("digest"))

    at = F.col("page_id").cast("long")
    return pages.select(F.explode(F.array(record("response", at * 2, at, full), record("revisit", at * 2 + 1, at + delay, again))).alias("r")).select("r.*")
