"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Sources share a budget by weight; a target stops at a multiple of its source's
size and what it leaves is shared by the others. The mix is made of blocks of
equal tokens. Highest quotients target / (2 k + 1) hand the blocks to sources,
and as the method never takes a block back when the house grows, a shard's
quotas are the seats of all shards up to it less those of the shards before.
Within a source the documents lie in seeded order on a circle of tokens; the
blocks of the quota follow each other from a seeded first block on, so most
documents are taken whole, and none more often than the circle is run through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C
from .fingerprint import words_of

#: weights by source in order, share of all tokens that the mix holds, times that a source is used at most
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: a block is this part of the smallest target, and never larger than BLOCK_TOKENS
BLOCK_PARTS, BLOCK_TOKENS = 128, 4096
#: copies of a row written by one step
COPIES = 4096

EVERY = (W.unboundedPreceding, W.unboundedFollowing)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target, block) from (source, source_size), one row per source.

    Target: weight times the level at which all targets together make up
    ``share`` of all sizes, or ``most`` times the size where that is less. The
    level is the largest of those found by taking the sources with the least
    room per weight as full, one after another.
    """
    named = W.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(named) - 1) % len(weights) + 1))
    t = t.withColumn("room", F.col("source_size") * F.lit(float(most)))
    full = W.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("room").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing))
    everywhere = W.partitionBy().rowsBetween(*EVERY)
    t = t.withColumn("budget", F.sum("source_size").over(everywhere) * F.lit(float(share)))
    t = t.withColumn("level", (F.col("budget") - before) / left).withColumn("level", F.max("level").over(everywhere))
    t = t.withColumn("target", F.least("room", F.col("level") * F.col("weight")))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everywhere)
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_TOKENS), F.floor(least / F.lit(float(BLOCK_PARTS)))))
    return t.select("source", "source_size", "weight", "target", F.coalesce(block, F.lit(1)).cast("long").alias("block"))


def shard_quotas(targets: DataFrame, shards: int, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(shard, source, first, blocks): blocks of every source in every shard; ``first``: those of earlier shards.

    Seats that the highest quotients surely give are counted by rounding; only
    those near the last quotient, at most two per source and two more, are
    written out and ranked. Ties go to the earlier source.
    """
    everywhere = W.partitionBy().rowsBetween(*EVERY)
    total = F.sum("source_size").over(everywhere) * F.lit(float(min(share, most)))
    t = targets.where("target > 0").withColumn("total", total)
    t = t.withColumn("n", F.count(F.lit(1)).over(everywhere)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    house = F.floor(F.floor(F.col("total") / F.col("block") + 0.5) * (F.col("shard") + 1) / F.lit(shards))
    t = t.withColumn("house", house)

    def rounded(seats: Column) -> Column:
        return F.floor(F.col("target") * seats / F.col("total") + 0.5)

    t = t.withColumn("sure", rounded(F.greatest(F.lit(0.0), F.col("house") - F.col("n") / 2.0 - 1.0)))
    t = t.withColumn("open", rounded(F.col("house") + F.col("n") / 2.0 + 1.0))
    t = t.withColumn("rest", F.col("house") - F.sum("sure").over(W.partitionBy("shard")))
    near = t.where("open > sure").withColumn("k", F.explode(F.expr("sequence(sure, open - 1)")))
    by_quotient = W.partitionBy("shard").orderBy(F.desc(F.col("target") / (2 * F.col("k") + 1)), F.col("source").asc_nulls_last(), "k")
    won = near.withColumn("place", F.row_number().over(by_quotient)).where("place <= rest")
    seats = (t.select("shard", "source", F.col("sure").alias("seats")).union(won.select("shard", "source", F.lit(1).cast("long").alias("seats")))
             .groupBy("shard", "source").agg(F.sum("seats").alias("seats")))
    held = F.coalesce(F.lag("seats").over(W.partitionBy("source").orderBy("shard")), F.lit(0))
    return seats.select("shard", "source", held.alias("first"), (F.col("seats") - held).alias("blocks"))


def _spans(passes: int) -> Column:
    """Parts of the document that the arcs cover: on the circle run through ``passes`` times from the first block on, it lies in two pieces a pass at most."""
    def spans(at: Column, place: Column, length: Column) -> Column:
        def span(arc: Column) -> Column:
            lo, hi = F.greatest(place, arc["lo"]), F.least(place + length, arc["hi"])
            return F.struct(arc["shard"].alias("shard"), (at + lo - place).alias("at"), (hi - lo).alias("length"))
        return F.transform("arcs", span)

    pieces = []
    for p in range(passes):
        turn = F.col("source_size") * p
        pieces.append((F.lit(0).cast("long"), F.col("place") + turn, F.col("head")))
        pieces.append((F.col("head"), turn, F.col("size") - F.col("head")))
    found = F.concat(*[spans(*q) for q in pieces])
    return F.filter(found, lambda s: s["length"] > 0)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 8,
                  weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """(id, source, size, source_size, target, taken, spans) for every row of ``docs``.

    size: words (runs without ASCII white space) of the text, 0 for a null one.
    taken: words of the document in the mix, repeats counted, at most ``most``
    times its size; spans: the parts taken, as (shard, at, length) in words.
    Sources are in code point order, a null source is one of its own and the
    last. Rows alike in source, id and size count as copies and follow each
    other; ids may be null. A source without words has target 0. Other columns
    are ignored; an empty table gives an empty result. The tables of sources
    and of order buckets are all that is ordered as a whole.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       F.size(words_of(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("size"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string")))
    grouped = C.materialize(slim.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("key", key), "mix-sizes")
    # as many order buckets as rows in a bucket: neither their table nor a bucket grows faster than the root of the input
    buckets = math.isqrt(grouped.count()) + 1
    high = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    lined = grouped.withColumn("bucket", F.shiftright(high * F.lit(buckets), 28))
    words = F.col("size") * F.col("copies")
    cells = lined.groupBy("source", "bucket").agg(F.sum(words).alias("held"))
    sources = C.materialize(source_targets(cells.groupBy("source").agg(F.sum("held").alias("source_size")), weights, share, most), "mix-sources")
    upto = F.sum("held").over(W.partitionBy("source").orderBy("bucket")) - F.col("held")
    quotas = shard_quotas(sources, shards, share, most).join(sources.select(F.col("source").alias("s"), "block", "source_size"), F.col("source").eqNullSafe(F.col("s")))
    most_tokens = F.floor(F.col("source_size") * F.lit(float(most)))
    arc = F.struct("shard", F.least(F.col("first") * F.col("block"), most_tokens).alias("lo"), F.least((F.col("first") + F.col("blocks")) * F.col("block"), most_tokens).alias("hi"))
    arcs = quotas.groupBy(F.col("source").alias("arc_source")).agg(F.array_sort(F.collect_list(arc)).alias("arcs"))
    first = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("first"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("long"),
                   F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("block")))) * F.col("block")
    sources = (sources.withColumn("origin", first).join(arcs, F.col("source").eqNullSafe(F.col("arc_source")), "left")
               .select(F.col("source").alias("own"), "source_size", "target", "origin", "arcs"))
    cells = (cells.withColumn("before", upto).join(sources, F.col("source").eqNullSafe(F.col("own")))
             .select("own", F.col("bucket").alias("cell"), "before", "source_size", "target", "origin", "arcs"))
    within = F.sum(words).over(W.partitionBy("source", "bucket").orderBy("key", F.col("id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, 0)) - words
    placed = (lined.withColumn("within", within)
              .join(cells, F.col("source").eqNullSafe(F.col("own")) & (F.col("bucket") == F.col("cell")))
              .select("id", "source", "size", "source_size", "target", "origin", "copies", "arcs", (F.col("before") + F.col("within")).alias("start")))
    chunk = F.expr(f"sequence(0L, copies - 1, {COPIES}L)")
    each = (placed.withColumn("chunk", F.explode(chunk))
            .withColumn("copy", F.explode(F.expr(f"sequence(chunk, least(copies, chunk + {COPIES}) - 1)")))
            .withColumn("place", F.pmod(F.col("start") + F.col("copy") * F.col("size") - F.col("origin"), F.greatest(F.lit(1), F.col("source_size"))))
            .withColumn("head", F.least(F.col("size"), F.col("source_size") - F.col("place")))
            .withColumn("arcs", F.coalesce("arcs", F.array().cast("array<struct<shard:int,lo:bigint,hi:bigint>>"))))
    each = each.withColumn("spans", _spans(-int(-most // 1)))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return each.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), "spans")
