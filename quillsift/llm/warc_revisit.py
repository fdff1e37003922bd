"""Not-modified revisits of a web archive: each is given the latest earlier full response of its canonical URL.

The as-of join works on narrow rows (no payloads). First the records of a URL at one instant become one row, counted
in their own tasks; then instants meet in two levels: inside pieces of `piece_seconds` of a URL's time by a window, and
across pieces by the last response of each piece, of which a URL has as many as its time span holds. So however much
traffic a URL has, no task gets more of its rows than a piece has instants. Revisits and payloads are joined with written
tables that have each key once, where Spark's adaptive skew join splits a hot URL or original; payload columns are joined
to resolved revisits alone.

A revisit is `resolved` if a validator agrees (ETag by weak comparison, else Last-Modified), `mismatch` if one differs,
`unverified` if the two records have no validator in common, and `missing` without an earlier response. Resolved and
unverified revisits get the response's headers with those that a 304 answer may renew taken from the revisit.

Defined results: a response at the very instant of a revisit is not earlier; of responses at one instant the largest
record_id counts; a null URL or time is `missing`; of headers that repeat (any case) the first counts; null headers are
none; records of other types are ignored; equal revisits are resolved one by one; empty tables work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spare, written

#: Headers that a 304 answer renews (RFC 9110, 15.4.5, and the caching fields that go with them).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
PIECE_SECONDS = 86400


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a last slash, query sorted without trackers."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)="))
    joined = F.array_join(F.array_sort(query), "&")
    return F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def lower_headers(headers: Column) -> Column:
    """Header names in lower case, the first of each."""
    pairs = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.transform(pairs, lambda e: F.lower(e["key"]))
    first = F.filter(pairs, lambda e, i: F.array_position(names, F.lower(e["key"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def _narrow(records: DataFrame, kind: str) -> DataFrame:
    headers = lower_headers(F.col("http_headers"))
    return records.where(F.col("warc_type") == kind).select(
        "record_id", F.col("url").alias("_url"), canonical_url(F.col("url")).alias("_key"), F.col("warc_date").alias("_ts"), headers.alias("_headers")
    )


def _agree(ours: Column, theirs: Column) -> Column:
    """True, False, or null where a validator is missing on a side."""
    weak = lambda e: F.regexp_replace(e, "^W/", "")
    etag = weak(ours["etag"]) == weak(theirs["etag"])
    return F.coalesce(etag, ours["last-modified"] == theirs["last-modified"])


def resolve_revisits(records: DataFrame, piece_seconds: int = PIECE_SECONDS) -> DataFrame:
    """records (record_id, url, warc_date, warc_type, http_headers map) to a row for each revisit: revisit_id, url,
    canonical_url, warc_date, original_id, status, headers."""
    piece = F.floor(F.unix_seconds("_ts") / piece_seconds)
    known = F.col("_key").isNotNull() & F.col("_ts").isNotNull()
    named = "struct<ts:timestamp,id:bigint,headers:map<string,string>>"
    original = F.struct(F.col("_ts").alias("ts"), F.col("record_id").alias("id"), F.col("_headers").alias("headers")).cast(named)
    revisits = _narrow(records, "revisit")

    # one row for each instant of a URL: its response of the largest record_id, and whether a revisit asks
    told = _narrow(records, "response").where(known).groupBy("_key", "_ts").agg(F.max_by(original, "record_id").alias("_o"))
    asked = revisits.where(known).select("_key", "_ts").distinct()
    instants = told.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    instants = written(instants.withColumn("_piece", piece), "instants")

    # inside a piece: an answer comes before the responses of its own instant
    order = Window.partitionBy("_key", "_piece").orderBy("_ts", F.col("_asked").desc())
    inside = instants.withColumn("_in", F.last("_o", ignorenulls=True).over(order)).where("_asked")

    # across pieces: the last response of each, then of the pieces before
    pieces = instants.groupBy("_key", "_piece").agg(F.max_by("_o", F.when(F.col("_o").isNotNull(), F.col("_ts"))).alias("_last"))
    before = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).select("_key", "_piece", "_before")
    answers = inside.join(carried, ["_key", "_piece"], "left").select("_key", "_ts", F.coalesce("_in", "_before").alias("_o"))
    found = revisits.where(known).join(written(answers, "answers"), ["_key", "_ts"]).select("record_id", "_url", "_key", "_ts", "_headers", "_o")
    found = found.unionByName(revisits.where(~known).select("record_id", "_url", "_key", "_ts", "_headers", F.lit(None).cast(named).alias("_o")))
    agree = _agree(F.col("_headers"), F.col("_o.headers"))
    status = F.when(F.col("_o").isNull(), "missing").when(agree, "resolved").when(~agree, "mismatch").otherwise("unverified")
    renewed = lambda k, _: k.isin(PERMITTED)
    fresh = F.map_filter("_headers", renewed)
    kept = F.map_filter(F.col("_o.headers"), lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    out = found.withColumn("_status", status)
    return out.select(
        F.col("record_id").alias("revisit_id"), F.col("_url").alias("url"), F.col("_key").alias("canonical_url"), F.col("_ts").alias("warc_date"),
        F.col("_o.id").alias("original_id"), F.col("_status").alias("status"),
        F.when(F.col("_status").isin("resolved", "unverified"), F.map_concat(kept, fresh)).alias("headers"),
    )


def with_payload(resolved: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """Resolved revisits with the payload columns of their originals, the others with nulls; a payload column whose name
    `resolved` has gets an underscore."""
    wanted = F.col("status").isin("resolved", "unverified")
    own, shown = spare(resolved, "_o"), [F.col(c).alias(spare(resolved, c)) for c in columns]
    originals = records.where("warc_type = 'response'").select(F.col("record_id").alias(own), *shown)
    some = resolved.where(wanted).join(originals, F.col("original_id") == F.col(own), "left").drop(own)
    return some.unionByName(resolved.where(~wanted), allowMissingColumns=True)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """An archive of the pages table: a response of each page, and a revisit of it at another time.

    Page p is fetched at hour p. Its revisit is 36 hours and (p mod 97) days later, every 11th one 30 minutes too early;
    every 7th has another ETag, every 5th only Last-Modified and every 13th no validator.
    """
    hour = F.col("page_id") * 3600
    p = lambda n: F.pmod(F.col("page_id"), F.lit(n))
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    modified = F.concat(F.lit("hour "), F.floor(F.col("page_id") / 24).cast("string"))
    response = pages.select(
        F.col("page_id").alias("record_id"), "url", F.timestamp_seconds(hour).alias("warc_date"), F.lit("response").alias("warc_type"),
        F.map_from_arrays(F.array(*map(F.lit, ("Content-Type", "ETag", "Last-Modified", "Cache-Control"))), F.array(F.lit("text/html"), etag, modified, F.concat(F.lit("max-age="), p(100).cast("string")))).alias("http_headers"),
        "html",
    )
    seen = F.when(p(7) == 0, F.lit('W/"other"')).otherwise(F.concat(F.lit("W/"), etag))
    every = F.array(F.lit("Date"), F.lit("Content-Length"), F.lit("Cache-Control"))
    values = F.array(F.col("page_id").cast("string"), F.lit("0"), F.lit("max-age=0"))
    headers = F.when(p(13) == 0, F.map_from_arrays(every, values)).when(p(5) == 0, F.map_from_arrays(F.concat(every, F.array(F.lit("Last-Modified"))), F.concat(values, F.array(modified)))).otherwise(
        F.map_from_arrays(F.concat(every, F.array(F.lit("etag"))), F.concat(values, F.array(seen)))
    )
    later = F.when(p(11) == 0, hour - 1800).otherwise(hour + 129600 + p(97) * 86400)
    revisit = pages.select(F.col("page_id").alias("record_id"), "url", F.timestamp_seconds(later).alias("warc_date"), F.lit("revisit").alias("warc_type"), headers.alias("http_headers"), F.lit(None).cast("string").alias("html"))
    return response.unionByName(revisit)
