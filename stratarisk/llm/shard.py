"""Sharding by sampled splitters: shards of near-equal bytes, equal texts together.

The key of a row is a digest of its text. A size-weighted sample of keys gives
the quantile boundaries of many ranges; exact counts per range follow, and
ranges over their share are subdivided: a key that holds a notable share by
itself becomes a range of its own, any other overfull range is split by its
keys, and a group of equal texts larger than a shard is split by document id.
Heavy groups are dealt to shards first (largest first); the ranges of the
other keys then fill what is left of each shard in key order.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

#: ranges per shard (at least), sampled keys per range, rows that one task numbers at most (about)
RANGES, SAMPLES, TASK_ROWS = 256, 16, 1_000_000


def _boundaries(slim: DataFrame, total: int, ranges: int) -> list[str]:
    """Quantile boundaries from a size-weighted sample of keys (about ``ranges * SAMPLES`` rows reach the driver)."""
    step = total / (ranges * SAMPLES)
    draw = (F.xxhash64("key", "doc_id", F.lit("splitter")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))
    got = sorted((r[0], max(float(r[1]), step)) for r in slim.where(draw < F.col("size") / F.lit(step)).select("key", "size").collect())
    out, run, share = [], 0.0, total / ranges
    for key, weight in got:
        run += weight
        if run >= share:
            out.append(key)
            run -= share * int(run / share)
    return sorted(set(out))


def _ranged(slim: DataFrame, bounds: list[str], heavy: dict[str, int]) -> DataFrame:
    """Adds the range number: heavy keys have ranges of their own after the others."""
    edges = np.array(bounds, "S32")
    own = {k.encode(): len(bounds) + 1 + i for k, i in heavy.items()}
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("key", pa.string()), ("range", pa.int32())])

    def run(batches):
        for x in batches:
            key = np.array(x.column(3).to_pylist(), "S32")
            at = np.searchsorted(edges, key, "right").astype(np.int32)
            if own:
                for i in np.flatnonzero(np.isin(key, np.array(list(own), "S32"))):
                    at[i] = own[key[i]]
            yield pa.RecordBatch.from_arrays([*(x.column(i) for i in range(4)), pa.array(at)], schema=schema)

    return slim.mapInArrow(run, "doc_id long, size long, text_crc32 long, key string, range int")


def _assign(cells: list, heavy_ranges: dict[int, bool], shards: int) -> dict[tuple[int, int], int]:
    """Shard of each (range, piece, bytes, rows). heavy_ranges: number -> whether its pieces may part."""
    target = sum(c[2] for c in cells) / shards
    load, out = [0] * shards, {}
    groups: dict = {}
    for r, p, size, _ in cells:
        if r in heavy_ranges:
            groups.setdefault((r, p if heavy_ranges[r] else -1), []).append((r, p, size))
    for g in sorted(groups.values(), key=lambda g: (-sum(x[2] for x in g), g[0])):
        s = min(range(shards), key=lambda i: (load[i], i))
        for r, p, size in g:
            out[(r, p)] = s
            load[s] += size
    light = sorted(c for c in cells if c[0] not in heavy_ranges)
    room = [max(0.0, target - x) for x in load]
    scale = sum(c[2] for c in light) / sum(room) if sum(room) else 0
    ends = np.cumsum(room) * scale
    run = 0
    for r, p, size, _ in light:
        out[(r, p)] = min(shards - 1, bisect.bisect_right(ends.tolist(), run + size / 2))
        run += size
    return out


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    size: UTF-8 bytes plus 1; a null text has no bytes (crc 0), like an empty
    one. law is "bytes": the shards' sizes are near equal. slot counts from 0
    within a shard, by key and id; rows alike in both are numbered in any
    order. Rows may repeat, ids may be null; other columns are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = C.materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                                     F.crc32(text).alias("text_crc32"), F.md5(text).alias("key")), "shard-slim")
    total, rows = slim.agg(F.sum("size"), F.count(F.lit(1))).first()
    out = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
    if not rows:
        return spark.createDataFrame([], out)
    ranges = max(shards * RANGES, rows // TASK_ROWS)
    least = total / (shards * 32)  # at most shards * 32 keys can hold that much
    groups = slim.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).where(F.col("bytes") > least).collect()
    heavy = {r["key"]: i for i, r in enumerate(sorted(groups, key=lambda r: r["key"]))}
    bounds = _boundaries(slim, total, ranges)
    parts, by_id, may_part = {}, [], {}
    for r in groups:
        n = len(bounds) + 1 + heavy[r["key"]]
        may_part[n] = r["bytes"] > total / shards
        parts[n] = max(math.ceil(r["rows"] / TASK_ROWS), min(r["rows"], 64 * math.ceil(r["bytes"] * shards / total)) if may_part[n] else 1)
        by_id.append(n)
    ranged = C.materialize(_ranged(slim, bounds, heavy), "shard-ranged")
    share = 2 * total / ranges
    for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > share).collect():
        if r["range"] not in parts:
            parts[r["range"]] = math.ceil(2 * r["bytes"] / share)
    # small by construction: at most one row per range
    split = spark.createDataFrame([(r, n, r in by_id) for r, n in parts.items()], "range int, parts int, by_id boolean")
    piece = F.when(F.col("parts").isNull(), 0).when(F.col("by_id"), F.pmod(F.xxhash64("doc_id", F.lit("part")), "parts")).otherwise(F.pmod(F.xxhash64("key"), "parts"))
    celled = ranged.join(F.broadcast(split), "range", "left").withColumn("piece", piece.cast("int"))
    cells = sorted((r["range"], r["piece"], r["bytes"], r["rows"]) for r in
                   celled.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect())
    where = _assign(cells, may_part, shards)
    next_slot, placed = [0] * shards, []
    for r, p, _, n in cells:
        s = where[(r, p)]
        placed.append((r, p, s, next_slot[s]))
        next_slot[s] += n
    placed = spark.createDataFrame(placed, "range int, piece int, shard int, first long")
    number = F.row_number().over(W.partitionBy("range", "piece").orderBy("key", "doc_id"))
    return (celled.withColumn("number", number).join(F.broadcast(placed), ["range", "piece"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("number") - 1).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
