"""WARC: resolving not-modified revisits.

A revisit record says that a page had not changed since an earlier capture.  It is resolved
by an as-of join: the latest full response before it with the same canonical URL.  The
response must fit the revisit's validators: the entity tag if it has one (weak comparison),
else the modification date, else the payload digest; without any, it is taken as it is.  The
resolved record has the response's headers with those that a 304 answer may renew.

The as-of join never sorts all records of one URL in one task: they are cut into spans of
time; inside a span a window finds the latest response, and a second window over one row a
span hands the last response of earlier spans on.

Defined results
    null url              the canonical URL is null; such records match nothing
    null time             before all others: nothing is earlier
    same time             a response at the revisit's own time is not earlier; among responses
                          of one time the greatest record id counts as the latest
    repeated rows         each revisit is resolved
    null headers          no headers
    empty table           no rows
    extra columns         not read
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import saved

# Headers that a 304 answer may renew, by the HTTP semantics standard.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
# Query parameters that only track where a visitor came from.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
SPAN = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, default port, tracking parameters and last slash; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[a-zA-Z]+://", "")
    host = F.regexp_replace(F.translate(F.regexp_extract(bare, "^[^/?]*", 0), UPPER, LOWER), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})=")))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))


def _tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, span: int = SPAN) -> DataFrame:
    """One row a revisit: record_id, url_key, base_id, status, headers.

    ``records`` has record_id, url, ts (whole number), kind ('response' or 'revisit'), etag,
    last_modified, digest and headers (map of lower-case names).  status is resolved,
    mismatch (base_id is the response that failed) or missing.
    """
    slim = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "etag", "last_modified", "digest", F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("headers"))
    slim = slim.withColumn("__span", F.floor(F.col("ts") / span))
    slim = saved(slim, "records")
    held = F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers")
    # a response only counts for records after its time: it sorts after revisits of the same time
    order = [F.col("ts").asc_nulls_first(), F.when(F.col("kind") == "response", 1).otherwise(0), F.col("record_id")]
    inside = W.Window.partitionBy("url_key", "__span").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
    response = F.when(F.col("kind") == "response", held)
    # what has no URL or time matches nothing and goes around the windows
    known, lost = slim.where("url_key is not null and ts is not null"), slim.where("kind = 'revisit' and (url_key is null or ts is null)")
    near = known.withColumn("__base", F.last(response, ignorenulls=True).over(inside)).where("kind = 'revisit'")
    # last response of each span, then of all spans before
    ends = known.where("kind = 'response'").groupBy("url_key", "__span").agg(F.max_by(held, F.struct("ts", "record_id")).alias("__end"))
    spans = known.select("url_key", "__span").distinct().join(ends, ["url_key", "__span"], "left")
    over = W.Window.partitionBy("url_key").orderBy("__span").rowsBetween(W.Window.unboundedPreceding, -1)
    earlier = spans.select("url_key", "__span", F.last("__end", ignorenulls=True).over(over).alias("__earlier")).where("__earlier is not null")
    out = near.join(earlier, ["url_key", "__span"], "left").withColumn("__base", F.coalesce("__base", "__earlier")).drop("__earlier")
    out = out.unionByName(lost.withColumn("__base", F.lit(None).cast(near.schema["__base"].dataType)))
    base = F.col("__base")
    fits = F.when(F.col("etag").isNotNull(), F.coalesce(_tag(F.col("etag")) == _tag(base["etag"]), F.lit(False)))
    fits = fits.when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == base["last_modified"], F.lit(False)))
    fits = fits.when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == base["digest"], F.lit(False))).otherwise(F.lit(True))
    status = F.when(base.isNull(), "missing").when(fits, "resolved").otherwise("mismatch")
    renewed = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    kept = F.map_filter(base["headers"], lambda k, _: ~F.array_contains(F.map_keys(renewed), k))
    merged = F.when(F.col("status") == "resolved", F.map_concat(kept, renewed)).otherwise(F.col("headers"))
    return out.withColumn("status", status).select("record_id", "url_key", base["record_id"].alias("base_id"), "status", merged.alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures derived from ``pages``: each page is a full response, and is visited again later.

    The revisit carries the validators of its own page's response, so it fits only if no
    other version of the same canonical URL was captured in between.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    slim = pages.select("page_id", "url", F.md5(html).alias("digest"), F.octet_length(html).cast("string").alias("size"), (F.col("page_id") * 2).alias("at"), (2 * (F.col("page_id") + 1 + (F.col("page_id") * 7) % 97) + 1).alias("again"))
    tag = F.concat(F.lit('"'), F.col("digest"), F.lit('"'))
    when = F.col("at").cast("string")
    first = slim.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("at").alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), when.alias("last_modified"), "digest",
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size"), F.lit("etag"), tag, F.lit("date"), when).alias("headers"),
    )
    third = F.col("page_id") % 3
    second = slim.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", F.col("again").alias("ts"), F.lit("revisit").alias("kind"),
        F.when(third != 0, F.concat(F.lit("W/"), tag)).alias("etag"), F.when(third == 0, when).alias("last_modified"), "digest",
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), F.col("again").cast("string"), F.lit("set-cookie"), F.lit("a=1")).alias("headers"),
    )
    return first.unionByName(second)


def revisit_digest(pages: DataFrame) -> DataFrame:
    out = resolve_revisits(records_of_pages(pages))
    head = lambda name: F.element_at(F.col("headers"), F.lit(name))
    return out.select("record_id", "url_key", "base_id", "status", head("date").alias("date"), head("content-length").alias("content_length"), F.size("headers").cast("long").alias("n_headers"))


#: The same by one window over all captures of a URL.
SQL = f"""
WITH bare AS (
  SELECT page_id, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z]+://', '') AS u FROM pages
), parts AS (
  SELECT page_id, coalesce(html, '') AS html,
         regexp_replace(translate(regexp_extract(u, '^[^/?]*', 0), '{UPPER}', '{LOWER}'), ':(80|443)$', '')
           || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/$', '') AS place,
         list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^({TRACKING})='))) AS params
  FROM bare
), keyed AS (
  SELECT page_id, md5(html) AS digest, CAST(octet_length(encode(html)) AS VARCHAR) AS size,
         place || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key
  FROM parts
), r AS (
  SELECT page_id * 2 AS record_id, url_key, page_id * 2 AS ts, 1 AS is_response, page_id, digest, size FROM keyed
  UNION ALL
  SELECT page_id * 2 + 1, url_key, 2 * (page_id + 1 + (page_id * 7) % 97) + 1, 0, page_id, digest, size FROM keyed
), w AS (
  SELECT *, last_value(CASE WHEN is_response = 1 THEN {{'id': record_id, 'digest': digest, 'ts': ts, 'size': size}} END IGNORE NULLS)
    OVER (PARTITION BY url_key ORDER BY ts, is_response, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base
  FROM r
), s AS (
  SELECT *, CASE WHEN base IS NULL THEN 'missing'
                 WHEN page_id % 3 <> 0 THEN CASE WHEN base.digest = digest THEN 'resolved' ELSE 'mismatch' END
                 WHEN base.ts = page_id * 2 THEN 'resolved' ELSE 'mismatch' END AS status
  FROM w WHERE is_response = 0
)
SELECT record_id, url_key, base.id AS base_id, status, CAST(ts AS VARCHAR) AS date,
       CASE WHEN status = 'resolved' THEN base.size ELSE '0' END AS content_length,
       CAST(CASE WHEN status = 'resolved' THEN 4 ELSE 3 END AS BIGINT) AS n_headers
FROM s
"""
