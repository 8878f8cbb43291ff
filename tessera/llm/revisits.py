"""Not-modified revisits of web archives: an as-of join by canonical URL to the latest earlier full response.

A revisit holds no body; it stands for the latest response of its canonical URL
captured before it, if the validators agree (equal entity tags, weak or strong, or without
tags equal times of last change). The headers that a not-modified answer may
carry then replace those of the response. One URL may have any number of captures:
captures are cut into slices of time, so a task gets a slice of a URL; the last
response of each slice is carried on over the slices in a second pass over
one row for each URL and slice.

Captures without URL or without time are of no URL or no time: their revisits never resolve, and their responses serve none.
Names of headers are compared and given in lower case; of names that differ in case only, the later in the map counts.
A weak tag (W/"x") equals a strong one of the same text, as a not-modified answer compares them. URLs stay apart
that differ in the order of parameters or in percent-encoding. Ties of time go by record_id; repeated rows resolve each. Null headers are none. Empty tables give no rows; extra columns
are ignored. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 answer may bring up to date (RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
SLICES = 64
SLICE_ROWS = 1_000_000


def canonical_url(url: Column) -> Column:
    """Without scheme, www, default port, fragment, tracking (utm_) and empty parameters and the path's last slash; host in lower case."""
    u = F.regexp_replace(url, r"(?s)#.*$", "")
    scheme, rest = F.lower(F.regexp_extract(u, r"^([A-Za-z]+)://", 1)), F.regexp_replace(u, r"^[A-Za-z]+://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(F.regexp_replace(host, r":80$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/$", "")
    kept = F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_"))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.regexp_replace(host, r"^www\.", ""), path, query)


def lowered(headers: Column) -> Column:
    """The map with its keys in lower case; of equal ones the later. Null for null."""
    one = lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"]))
    return F.aggregate(F.map_entries(headers), F.create_map().cast("map<string,string>"), one)


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^[Ww]/", "")


def resolve(records: DataFrame) -> DataFrame:
    """Rows of revisits from record_id, url, time (long), kind (response or revisit), headers (map).

    Returns record_id, url_key, refers_to, status (resolved, changed, unresolved), headers.
    """
    headers = F.coalesce(lowered(F.col("headers")), F.create_map().cast("map<string,string>"))
    all_ = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("time"), "kind", headers.alias("headers"))
    r = all_.filter("url_key is not null and time is not null")
    bounds = r.agg(F.min("time").alias("t0"), F.max("time").alias("t1"), F.count("*").alias("n")).first()
    t0, t1 = (bounds["t0"] or 0), (bounds["t1"] or 0)
    width = (t1 - t0) // max(SLICES, -(-bounds["n"] // SLICE_ROWS)) + 1
    r = r.withColumn("slice", F.floor((F.col("time") - t0) / F.lit(width)))
    full = F.when(F.col("kind") == "response", F.struct("record_id", F.col("headers").alias("full_headers")))
    w = Window.partitionBy("url_key", "slice").orderBy("time", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    here = r.withColumn("near", F.last(full, ignorenulls=True).over(w))
    last = r.filter("kind = 'response'").groupBy("url_key", "slice").agg(F.max_by(F.struct("record_id", F.col("headers").alias("full_headers")), F.struct("time", "record_id")).alias("last"))
    slices = r.filter("kind = 'revisit'").select("url_key", "slice").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType)).unionByName(last)
    slices = slices.groupBy("url_key", "slice").agg(F.first("last", ignorenulls=True).alias("last"))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("url_key", "slice", F.last("last", ignorenulls=True).over(before).alias("carry"))
    out = here.filter("kind = 'revisit'").join(carried, ["url_key", "slice"], "left").withColumn("base", F.coalesce("near", "carry"))
    own, stored = F.col("headers"), F.col("base.full_headers")
    tag = F.coalesce(_strong(own["etag"]) == _strong(stored["etag"]), own["last-modified"] == stored["last-modified"], F.lit(False))
    status = F.when(F.col("base").isNull(), "unresolved").when(tag, "resolved").otherwise("changed")
    permitted = F.map_filter(own, lambda k, v: k.isin(PERMITTED))
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(permitted, k))
    merged = F.when(F.col("status") == "resolved", F.map_concat(kept, permitted)).otherwise(own)
    refers = F.when(F.col("status") == "resolved", F.col("base.record_id"))
    out = out.withColumn("status", status).select("record_id", "url_key", refers.alias("refers_to"), "status", merged.alias("headers"))
    lost = all_.filter("kind = 'revisit' and (url_key is null or time is null)")
    return out.unionByName(lost.select("record_id", "url_key", F.lit(None).cast(out.schema["refers_to"].dataType).alias("refers_to"), F.lit("unresolved").alias("status"), "headers"))


def captures(pages: DataFrame) -> DataFrame:
    """An archive made of pages, as the tables hold none; three captures of each.

    The page itself, every fifth time as a revisit of what was never stored; a later revisit under another
    form of its URL, every seventh with a new entity tag; and the front page of its site, every third time as
    a revisit, with its language section as tag, so that busy sites have very many captures of one URL.
    """
    id_, url = F.col("page_id"), F.col("url")
    every = lambda n: id_ % n == 0
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1))
    section = F.regexp_extract(url, r"^[A-Za-z]+://[^/]*/([a-z]*)", 1)
    plain = F.regexp_replace(url, r"#.*$", "")
    other = F.when(every(2), F.regexp_replace(plain, r"^[a-z]+://(www\.)?", "https://WWW.")).otherwise(F.regexp_replace(plain, r"^[a-z]+://(www\.)?", "http://"))
    other = F.concat(other, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("utm_medium=mail#again"))
    tag = F.md5("html")
    parts = [
        (0, url, 4 * id_, F.when(every(5), "revisit").otherwise("response"), tag),
        (1, other, 4 * id_ + 1 + 4 * (id_ % 1000), F.lit("revisit"), F.when(every(7), "new").otherwise(tag)),
        (2, F.concat(F.lit("http://"), host, F.lit(":80/")), 4 * id_ + 2, F.when(every(3), "revisit").otherwise("response"), section),
    ]
    fields = [F.struct((3 * id_ + k).alias("record_id"), u.alias("url"), t.alias("time"), kind.alias("kind"), e.alias("tag")) for k, u, t, kind, e in parts]
    rows = pages.select("page_id", F.length("html").cast("string").alias("size"), F.explode(F.array(*fields)).alias("c")).select("page_id", "size", "c.*")
    day = F.format_string("day %d", "time")
    response = F.create_map(F.lit("etag"), "tag", F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), "size", F.lit("date"), day)
    revisit = F.create_map(F.lit("etag"), "tag", F.lit("date"), day, F.lit("server"), F.lit("x"))
    return rows.select("record_id", "url", "time", "kind", F.when(F.col("kind") == "revisit", revisit).otherwise(response).alias("headers"))
