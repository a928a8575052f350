"""Operator 1: resolution of not-modified revisits in web archives.

A revisit record says that a page had not changed since an earlier capture. It is joined to
the latest earlier full response (status 200) of its canonical URL; its validators must agree
with that response's (ETag by weak comparison where both have one, else Last-Modified); then
the stored headers are updated by those of the revisit that a 304 response may carry.

The as-of join never gathers a URL: time is cut at quantiles into SLICES slices, each slice
of a URL keeps its last full response, those are carried forward along the URL's slices (no
more than SLICES rows), and only revisits with no full response before them in their own
slice take what was carried.

Defined results: outcome is "resolved", "changed" (validators differ), "unverified" (no
validator that both have), "no_response" (nothing earlier) or "no_url" (null or blank url);
resolved_id is set for the first three, headers for "resolved" alone. Of responses at one time
the greatest record_id is the latest; a response at the revisit's own time isn't earlier; a
null time is never earlier nor later, so nothing is found; a repeated revisit row is resolved
each time; repeated response rows count once; header names compare in lower case, of a
name that comes twice the last value holds, null values are absent; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SLICES = 256
# Header fields that a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# Query parameters that only track.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without the last slash, sorted query without tracking; no scheme, no fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^www[0-9]*\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    joined = F.array_join(F.array_sort(query), "&")
    return F.when(F.trim(url) != "", F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit(""))))


def plain_headers(headers: str) -> str:
    """SQL: the map with names in lower case, without null values, the last value of a name."""
    e = f"filter(map_entries(coalesce({headers}, cast(map() as map<string, string>))), x -> x.value is not null)"
    names = f"array_distinct(transform({e}, x -> lower(x.key)))"
    return f"map_from_arrays({names}, transform({names}, k -> element_at(filter({e}, x -> lower(x.key) = k), -1).value))"


def resolve(records: DataFrame) -> DataFrame:
    """Of records (record_id, kind, url, time, status, headers) every revisit, with its full response.

    record_id and time are whole numbers, kind is "response" or "revisit", headers map<string, string>.
    Returns record_id, canonical_url, resolved_id, outcome, headers.
    """
    rows = records.select(F.col("record_id").cast("long").alias("id"), "kind", canonical_url(F.col("url")).alias("canon"), F.col("time").cast("long").alias("time"), "status", F.expr(plain_headers("headers")).alias("headers"))
    revisits = rows.where("kind = 'revisit'").drop("kind", "status")
    full = rows.where("kind = 'response' and status = 200 and canon is not null and time is not null")
    cuts = full.select(F.percentile_approx("time", [k / SLICES for k in range(1, SLICES)], 100 * SLICES)).first()[0] or []
    cuts = sorted(set(cuts))

    def sliced(df: DataFrame) -> DataFrame:
        # slices are half open, so equal times never part
        part = F.size(F.filter(F.expr(f"cast(split('{','.join(map(str, cuts))}', ',') as array<bigint>)"), lambda c: c <= F.col("time"))) if cuts else F.lit(0)
        return df.withColumn("slice", part.cast("int"))

    asked = sliced(revisits.where("canon is not null and time is not null")).select("canon", "slice", "time", F.col("id"), F.lit(0).alias("turn"))
    given = sliced(full).select("canon", "slice", "time", F.col("id"), F.lit(1).alias("turn"))
    events = asked.union(given)
    last = F.max(F.when(F.col("turn") == 1, F.struct("time", "id")))
    along = Window.partitionBy("canon").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy("canon", "slice").agg(last.alias("last")).withColumn("carried", F.max("last").over(along)).select("canon", "slice", "carried")
    within = Window.partitionBy("canon", "slice").orderBy("time", "turn", "id").rowsBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("own", last.over(within)).where("turn = 0").join(carried, ["canon", "slice"])
    found = found.select(F.col("id").alias("rev_id"), F.col("time").alias("rev_time"), F.col("canon").alias("rev_canon"), F.coalesce("own.id", "carried.id").alias("resolved_id")).distinct()

    stored = full.select(F.col("id").alias("resolved_id"), F.col("headers").alias("stored")).dropDuplicates(["resolved_id"])
    found = found.join(stored, "resolved_id", "left")
    out = revisits.join(found, (F.col("id") == F.col("rev_id")) & (F.col("canon") == F.col("rev_canon")) & (F.col("time") == F.col("rev_time")), "left")
    tag = lambda c: F.regexp_replace(F.element_at(c, "etag"), "^W/", "")
    day = lambda c: F.element_at(c, "last-modified")
    outcome = (
        F.when(F.col("canon").isNull(), "no_url")
        .when(F.col("resolved_id").isNull(), "no_response")
        .when(tag("stored").isNotNull() & tag("headers").isNotNull(), F.when(tag("stored") == tag("headers"), "resolved").otherwise("changed"))
        .when(day("stored").isNotNull() & day("headers").isNotNull(), F.when(day("stored") == day("headers"), "resolved").otherwise("changed"))
        .otherwise("unverified")
    )
    news = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.array_contains(F.map_keys(news), k)), news)
    out = out.withColumn("outcome", outcome)
    return out.select(F.col("id").alias("record_id"), F.col("canon").alias("canonical_url"), "resolved_id", "outcome", F.when(F.col("outcome") == "resolved", merged).alias("headers"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive records of every page: a full response, and a revisit some time later that other captures of the URL may precede."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.md5("html").alias("tag"), F.octet_length("html").alias("n"))
    response = pages.selectExpr(
        "page_id * 2 as record_id", "'response' as kind", "url", "page_id * 10 as time", "200 as status",
        "map('Content-Type', 'text/html', 'Content-Length', cast(n as string), 'ETag', tag, 'Last-Modified', cast(page_id as string), 'Cache-Control', 'max-age=600', 'Date', cast(page_id * 10 as string)) as headers",
    )
    revisit = pages.selectExpr(
        "page_id * 2 + 1 as record_id", "'revisit' as kind", "url", "page_id * 10 + page_id * 7919 % 5003 as time", "304 as status",
        "map('ETag', concat('W/', tag), 'Cache-Control', 'max-age=60', 'Date', cast(page_id * 10 + page_id * 7919 % 5003 as string), 'Content-Length', '0', 'Server', 'archive') as headers",
    )
    return response.union(revisit)


def digest(found: DataFrame) -> DataFrame:
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
    return found.select("record_id", "canonical_url", "resolved_id", "outcome", text.alias("headers"))


ORACLE = r"""
with pages2 as (
  select page_id, md5(html) as tag, strlen(html) as n, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest, trim(url) as url from pages),
parts as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '') as host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)'))), '&') as q
  from pages2),
canon as (
  select page_id, tag, n, case when url <> '' then host || path || case when q <> '' then '?' || q else '' end end as canon,
         page_id * 10 as t, page_id * 10 + page_id * 7919 % 5003 as rt from parts),
found as (
  select r.page_id, r.canon, r.tag, r.rt, (select max(f.page_id) from canon f where f.canon = r.canon and f.t < r.rt) as target from canon r)
select f.page_id * 2 + 1 as record_id, f.canon as canonical_url, f.target * 2 as resolved_id,
       case when f.canon is null then 'no_url' when f.target is null then 'no_response' when f.tag is null or g.tag is null then 'unverified' when f.tag = g.tag then 'resolved' else 'changed' end as outcome,
       case when f.tag = g.tag then 'cache-control=max-age=60; content-length=' || g.n || '; content-type=text/html; date=' || f.rt || '; etag=W/' || f.tag || '; last-modified=' || g.page_id end as headers
from found f left join canon g on g.page_id = f.target
"""
