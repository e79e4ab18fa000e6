"""WARC: not-modified revisits resolved by an as-of join.

A revisit record says that a page was unchanged since an earlier capture and has headers but no body. Its page is the latest earlier full response
of the same canonical URL; it is resolved if the validators agree (the entity tag if both name one, compared weakly, else the last-modified
time), and takes that response's body and headers, except that the headers a not-modified answer may renew (``RENEWED``) are its own.

Records of a URL are cut into slices of time. The latest response of each slice, a short table, is carried on to the slices that
follow; within a slice the records themselves are ordered. So a URL with a third of all records is many small windows. Only ids and times
are ordered; bodies are joined to what was found.

A null URL, time or record id makes a record unresolvable: a revisit of that kind is returned as ``no_response``, a response is never
referred to. Of responses at one time the one with the largest record id is the latest; a response at the revisit's own time is not earlier.
Repeated rows are resolved each, records that share an id but neither URL nor time are told apart; headers are matched whatever their case, and of a header named twice in differing case the first counts.
Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The header fields that a not-modified answer may renew.
RENEWED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "x-cache")
#: Parameters that don't name a resource.
TRACKING = "(utm_[a-z]+|ref|fbclid|gclid|sessionid)"
#: Units of time in a slice.
SLICE = 4096


def canonical(url: Column) -> Column:
    """Host in lower case without www., path without trailing slash, parameters in order without tracking ones, no fragment, no scheme.

    The scheme's default port goes: 443 of https, 80 of all others.
    """
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    port = F.when(F.lower(plain).startswith("https://"), ":443").otherwise(":80")
    plain = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, "^([^/?]*)", 1)), "^www\\.", "")
    host = F.when(host.endswith(port), F.left(host, F.length(host) - F.length(port))).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(plain, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(plain, "\\?(.*)$", 1)
    kept = F.filter(F.array_sort(F.split(query, "&")), lambda x: (x != "") & ~F.lower(x).rlike(f"^{TRACKING}(=|$)"))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lowered(headers: Column) -> Column:
    """Header names in lower case, the first of each."""
    names = F.array_distinct(F.transform(F.map_keys(headers), lambda k: F.lower(k)))
    value = lambda n: F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == n)[0]["value"]
    return F.when(headers.isNotNull(), F.map_from_arrays(names, F.transform(names, value)))


def merged(own: Column, base: Column) -> Column:
    """The response's headers, renewed by those of the revisit that may be."""
    renewed = F.map_filter(own, lambda k, v: k.isin(*RENEWED) & v.isNotNull())
    rest = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(renewed), k))
    return F.map_concat(rest, renewed)


def weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def latest(records: DataFrame, width: int = SLICE) -> DataFrame:
    """record_id, key, ts, refers_to, refers_ts: for each distinct revisit with a URL and a time, the latest earlier response."""
    base = records.where("key is not null and ts is not null and record_id is not null").select("record_id", "key", "ts", "kind", F.floor(F.col("ts") / width).alias("slice"))
    full = F.col("kind") == "response"
    at = F.when(full, F.struct("ts", F.col("record_id").alias("id")))
    ends = base.where(full).groupBy("key", "slice").agg(F.max(at).alias("last"))
    # A slice without responses needs what comes before it: slices of revisits join the line without a value.
    slices = base.groupBy("key", "slice").agg(F.max(F.lit(1)).alias("_one")).join(ends, ["key", "slice"], "left")
    before = F.max("last").over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = slices.select("key", "slice", before.alias("carried"))
    inside = F.max(at).over(Window.partitionBy("key", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1))
    own = base.select("record_id", "key", "slice", "ts", "kind", inside.alias("inside")).where("kind = 'revisit'").distinct()
    found = F.coalesce("inside", "carried")
    return own.join(carried, ["key", "slice"]).select("record_id", "key", "ts", found["id"].alias("refers_to"), found["ts"].alias("refers_ts"))


def resolve(records: DataFrame, width: int = SLICE) -> DataFrame:
    """records: record_id, url, ts, kind ('response', 'revisit', ...), headers (map), body. One row for each revisit.

    Returns record_id, url, ts, refers_to, status (resolved, changed: validators differ, no_validator, no_response), headers, body.
    """
    keyed = records.select(F.col("record_id").cast("long").alias("record_id"), "url", canonical(F.col("url")).alias("key"), F.col("ts").cast("long").alias("ts"), "kind", "headers", "body")
    revisits = keyed.where("kind = 'revisit'").select("record_id", "key", "url", "ts", lowered(F.col("headers")).alias("own"))
    # A record's id may be repeated: URL and time belong to what names it.
    linked = revisits.join(latest(keyed, width).where("refers_to is not null"), ["record_id", "key", "ts"], "left")
    full = keyed.where("kind = 'response' and record_id is not null and ts is not null and key is not null")
    full = full.select(F.col("record_id").alias("refers_to"), "key", F.col("ts").alias("refers_ts"), lowered(F.col("headers")).alias("base"), "body")
    # Of responses that agree in id, URL and time, one is chosen by what it holds, so that reruns agree.
    chosen = F.min_by(F.struct("base", "body"), F.struct(F.md5(F.coalesce("body", F.lit(""))), F.to_json("base")))
    bodies = full.groupBy("refers_to", "key", "refers_ts").agg(chosen.alias("_r"))
    both = linked.join(bodies, ["refers_to", "key", "refers_ts"], "left").select(*linked.columns, F.col("_r.base").alias("base"), F.col("_r.body").alias("body"))
    tags = (F.col("own")["etag"], F.col("base")["etag"])
    dates = (F.col("own")["last-modified"], F.col("base")["last-modified"])
    agree = F.when(tags[0].isNotNull() & tags[1].isNotNull(), weak(tags[0]) == weak(tags[1])).when(dates[0].isNotNull() & dates[1].isNotNull(), dates[0] == dates[1])
    status = F.when(F.col("refers_to").isNull(), "no_response").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("changed")
    good = status == "resolved"
    headers = F.when(good, merged(F.col("own"), F.col("base"))).otherwise(F.col("own"))
    return both.select("record_id", "url", "ts", "refers_to", status.alias("status"), headers.alias("headers"), F.when(good, F.col("body")).alias("body"))


def captures(pages: DataFrame) -> DataFrame:
    """WARC records of a table of pages: each page a full response at time 8 * page_id, and a revisit 8001 later.

    Every third page stands for the root of its host, so that a URL has many captures. The revisit of every thirteenth page comes before its
    response instead. The page's digest is its entity tag, in the revisit of every fifth page in weak form; every seventh page has no tag,
    every seventeenth no last-modified time and its revisit no validator at all, and the revisit of every eleventh page names another tag.
    """
    page = F.col("page_id").cast("long")
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.when(page % 3 == 0, F.regexp_replace("url", "^([A-Za-z]+://[^/?#]*).*$", "$1/")).otherwise(F.col("url")).alias("url")
    tag = F.concat(F.lit('"'), F.substring(F.md5(html), 1, 12), F.lit('"'))
    tag = F.when(page % 7 != 0, tag)
    date = F.when(page % 17 != 0, F.concat(F.lit("day "), F.floor(page / 100).cast("string")))
    seen = F.when(page % 17 == 0, F.lit(None)).when(page % 11 == 0, F.lit('"other"')).when(page % 5 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    later = F.when(page % 13 == 0, 8 * page - 5).otherwise(8 * page + 8001)
    pairs = lambda *x: F.map_filter(F.create_map(*x), lambda k, v: v.isNotNull())
    number = lambda x: x.cast("string")
    full = pages.select(
        (2 * page).alias("record_id"), url, (8 * page).alias("ts"), F.lit("response").alias("kind"),
        pairs(F.lit("ETag"), tag, F.lit("Last-Modified"), date, F.lit("Content-Length"), number(F.length(html)), F.lit("Date"), number(8 * page)).alias("headers"), html.alias("body"),
    )
    again = pages.select(
        (2 * page + 1).alias("record_id"), url, later.alias("ts"), F.lit("revisit").alias("kind"),
        pairs(F.lit("etag"), seen, F.lit("last-modified"), date, F.lit("date"), number(later), F.lit("content-length"), F.lit("0")).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return full.unionByName(again)
