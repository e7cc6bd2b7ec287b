"""Not-modified revisits of web archives, resolved to the latest earlier full response.

As-of join by canonical URL in two phases, so that one URL with very many
records is not one task's work: time is cut into equal spans (their number
follows the number of records); within a (URL, span) a running maximum finds
the latest earlier response, and only the last response of each (URL, span) is
carried on to the following spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: fixed values: header fields a not-modified answer may not change (they describe the stored payload or one connection)
KEPT_FIELDS = ("content-length", "content-encoding", "content-range", "content-type", "transfer-encoding", "connection", "set-cookie", "trailer")
ROWS_PER_SPAN = 1_000_000
MOST_SPANS = 100_000


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, default port and fragment dropped, an empty path made "/"; null without "://"."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(bare, "^([^:/?#]+://[^/?]*)", 1))
    tail = F.substring(bare, F.char_length(head) + 1, F.char_length(bare))
    host = F.regexp_replace(F.regexp_replace(head, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
    path = F.when(F.startswith(tail, F.lit("/")), tail).otherwise(F.concat(F.lit("/"), tail))
    return F.when(head != "", F.concat(host, path))


def weak(etag: Column) -> Column:
    """The opaque part of an entity tag."""
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored headers, with the permitted fields of the not-modified answer in their place."""
    stored, update = (F.coalesce(x, F.create_map().cast("map<string,string>")) for x in (stored, update))
    fresh = F.map_filter(update, lambda k, _: ~k.isin(*KEPT_FIELDS))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every revisit with the response that it stands for.

    records: record_id, url, ts (seconds), kind ("response" or "revisit"),
    status, etag, last_modified, digest, headers (map, lower-case names). A
    full response is a "response" with status 200. Result: record_id, canon,
    ts, outcome, response_id, digest, headers. outcome: "resolved"; "changed"
    if a validator (etag by weak comparison, else last_modified) or the digest
    of the revisit contradicts the latest earlier response; "missing" if there
    is none, or the url or time is null. Only a resolved revisit has a
    response_id, the response's digest and merged headers. Earlier means a
    smaller ts; of equal ts the larger record_id counts as later. Repeated
    revisits each get a row; other columns are ignored.
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("canon"), F.col("ts").cast("long").alias("ts"), "kind", "status", "etag",
                       "last_modified", "digest", "headers")
    low, high, n = r.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    spans = max(1, min(MOST_SPANS, n // ROWS_PER_SPAN))
    width = max(1, -(-((high or 0) - (low or 0) + 1) // spans))
    r = r.withColumn("span", F.floor((F.col("ts") - F.lit(low or 0)) / F.lit(width)))
    full = F.when((F.col("kind") == "response") & (F.col("status") == 200),
                  F.struct("ts", "record_id", "etag", "last_modified", "digest", F.to_json("headers").alias("fields")))
    known = r.where(F.col("canon").isNotNull() & F.col("ts").isNotNull()).withColumn("full", full)
    before = W.partitionBy("canon", "span").orderBy("ts").rangeBetween(W.unboundedPreceding, -1)
    seen = known.withColumn("near", F.max("full").over(before)).where("kind = 'revisit'").drop("full", "status")
    lasts = known.where("full is not null").groupBy("canon", "span").agg(F.max("full").alias("last"))
    spans_met = seen.select("canon", "span").distinct().join(lasts, ["canon", "span"], "full")
    earlier = W.partitionBy("canon").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    carried = spans_met.select("canon", "span", F.max("last").over(earlier).alias("far"))
    found = seen.join(carried, ["canon", "span"], "left").withColumn("r", F.coalesce("near", "far")).drop("near", "far", "span")
    lost = r.where((F.col("kind") == "revisit") & (F.col("canon").isNull() | F.col("ts").isNull())).drop("span", "status")
    every = found.unionByName(lost, allowMissingColumns=True)
    agrees = F.coalesce(
        F.when(F.col("etag").isNotNull() & F.col("r.etag").isNotNull(), weak(F.col("etag")) == weak(F.col("r.etag")))
        .when(F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull(), F.col("last_modified") == F.col("r.last_modified")), F.lit(True))
    agrees = agrees & F.coalesce(F.col("digest") == F.col("r.digest"), F.lit(True))
    outcome = F.when(F.col("r").isNull(), "missing").when(agrees, "resolved").otherwise("changed")
    stored = F.from_json("r.fields", "map<string,string>")
    return every.withColumn("outcome", outcome).select(
        "record_id", "canon", "ts", "outcome", F.when(F.col("outcome") == "resolved", F.col("r.record_id")).alias("response_id"),
        F.when(F.col("outcome") == "resolved", F.col("r.digest")).alias("digest"),
        F.when(F.col("outcome") == "resolved", merged_headers(stored, F.col("headers"))).alias("headers"))
