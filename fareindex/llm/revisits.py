"""WARC: which earlier response a not-modified revisit stands for, and the headers it then has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ascii_lower, written

#: Headers that a not-modified answer must not change: those of the body, and those of one connection.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag", "keep-alive",
                "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = "^(utm_[^=]*|gclid|fbclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """One form for urls of one page: no scheme, fragment, default port, tracking parameters or closing slash; lower-case host, sorted
    parameters. A null url, or one without `://`, is null and stands for no page."""
    host = F.regexp_replace(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(url, "://[^?#]*[?]([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(url.contains("://"), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, replaced by those of the not-modified answer that it may change. Names compare without case; repeated ones stay."""
    empty = F.array().cast("array<struct<name:string,value:string>>")
    stored, fresh = F.coalesce(stored, empty), F.coalesce(fresh, empty)
    new = F.filter(fresh, lambda h: ~F.lower(h["name"]).isin(*KEPT_HEADERS))
    names = F.transform(new, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(stored, lambda h: ~F.array_contains(names, F.lower(h["name"]))), new)


def resolve(records: DataFrame) -> DataFrame:
    """Each not-modified revisit with the latest earlier full response of its canonical url.

    `records`: `record_id` (long, unique), `url`, `time` (seconds, long), `kind` ('response' or 'revisit', others play no part), `etag`,
    `last_modified` (both may be null) and `headers` (array of name, value). Gives a row for each revisit: `record_id`, `canonical`, `time`,
    `response_id` (null: none is earlier, or url or time is null), `status` and `headers`. Earlier means of a smaller time; of responses at one time the largest id is
    the latest. `status`: 'validated' (entity tags agree, weak or not, or where one is missing the dates do), 'mismatch', 'unchecked' (no
    validator on both sides) or 'no_response'. Only a validated revisit gets merged headers; the others keep their own.

    The records are dealt by ranges of (url, time), so a url that holds a third of them is spread over many tasks; each range finds its
    own latest responses, and the last one of each range is handed on to the ranges of the same url after it.
    """
    spark = records.sparkSession
    slim = records.filter(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url").cast("string")).alias("canonical"), F.col("time").cast("long").alias("time"),
        (F.col("kind") == "response").cast("int").alias("response"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.filter("canonical IS NOT NULL AND time IS NOT NULL").repartitionByRange(parts, "canonical", "time", "response", "record_id").withColumn("block", F.spark_partition_id())
    dealt = written(dealt, "captures")
    response = F.when(F.col("response") == 1, F.struct("time", "record_id"))
    # A revisit sorts before the responses of its own second, in a range and across ranges, so these are not earlier.
    before = Window.partitionBy("block", "canonical").orderBy("time", "response", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("own", F.last(response, ignorenulls=True).over(before)).filter("response = 0")
    ends = dealt.groupBy("canonical", "block").agg(F.max(response).alias("end"))
    over_blocks = Window.partitionBy("canonical").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Ranges follow one another, so only the first url of a block goes on from an earlier one: at most one row a block.
    handed = ends.withColumn("handed", F.last("end", ignorenulls=True).over(over_blocks)).filter("handed IS NOT NULL").select("canonical", "block", "handed")
    matched = (within.join(F.broadcast(handed), ["canonical", "block"], "left")
               .select("record_id", F.coalesce("own", "handed")["record_id"].alias("response_id")))
    stored = records.filter("kind = 'response'").select(F.col("record_id").cast("long").alias("response_id"), F.col("etag").alias("old_etag"),
                                                         F.col("last_modified").alias("old_date"), F.col("headers").alias("old_headers"))
    revisits = records.filter("kind = 'revisit'").select(F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url").cast("string")).alias("canonical"),
                                                         F.col("time").cast("long").alias("time"), "etag", "last_modified", "headers")
    both = revisits.join(matched, "record_id", "left").join(stored, "response_id", "left")
    tags, dates = F.col("etag").isNotNull() & F.col("old_etag").isNotNull(), F.col("last_modified").isNotNull() & F.col("old_date").isNotNull()
    same = F.when(tags, _weak(F.col("etag")) == _weak(F.col("old_etag"))).when(dates, F.col("last_modified") == F.col("old_date"))
    status = (F.when(F.col("response_id").isNull(), "no_response").when(same.isNull(), "unchecked").when(same, "validated").otherwise("mismatch"))
    return both.withColumn("status", status).select("record_id", "canonical", "time", "response_id", "status",
                                                    F.when(F.col("status") == "validated", merged_headers(F.col("old_headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"))
